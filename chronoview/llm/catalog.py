"""Registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers

from chronoview.llm import (
    common,
    exact,
    langid,
    mixing,
    neardup,
    negatives,
    packing,
    pages,
    pii,
    quality,
    quantize,
    scoring,
    suffixes,
    tokens,
)

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark, folder):
    return mixing.mix_report(common.documents(spark, folder))


def op2_personal_data(spark, folder):
    return pii.personal_data(common.documents(spark, folder))


def op3_language_id(spark, folder):
    return langid.identify(common.documents(spark, folder))


def op4_token_counts(spark, folder):
    return tokens.token_counts(common.documents(spark, folder), PIECES)


def op5_pack_sequences(spark, folder):
    return packing.pack(common.documents(spark, folder), WORDS)


def op6_quality_rules(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return quality.quality_report(common.documents(spark, folder), labels)


def op7_exact_dedup(spark, folder):
    return exact.exact_duplicates(common.documents(spark, folder))


def op8_main_text(spark, folder):
    table = common.prepare(spark).read.parquet(f"{folder}/pages.parquet")
    return pages.extract(table)


def op9_lm_scores(spark, folder):
    return scoring.language_model_scores(common.documents(spark, folder))


def op10_near_dedup(spark, folder):
    return neardup.near_duplicates(common.documents(spark, folder))


def op11_vector_codes(spark, folder):
    table = common.prepare(spark).read.parquet(f"{folder}/embeddings.parquet")
    return quantize.vector_codes(table)


def op12_hard_negatives(spark, folder):
    table = common.prepare(spark).read.parquet(f"{folder}/embeddings.parquet")
    return negatives.hard_negatives(negatives.relabelled(table))


def op13_repeated_passages(spark, folder):
    return suffixes.repeated_passages(common.documents(spark, folder))


def code_rounds(rounds: int) -> str:
    """The assignments and updates of op11, one after the other."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS (
  SELECT r, p, any_value(x) AS x, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c)
         + list_inner_product(c, c), 'e': e}}) AS best FROM parts JOIN book{k} USING (p) GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""book{k + 1} AS (
  SELECT p, e, coalesce(m, c) AS c FROM book{k} LEFT JOIN (
    SELECT p, e, list(floor(s / n) ORDER BY i) AS m FROM (
      SELECT p, best.e AS e, i, sum(x[i]) AS s, count(*) AS n
      FROM near{k}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS i) GROUP BY ALL)
    GROUP BY p, e) USING (p, e))""")
    return ",\n".join(steps)


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_personal_data, op3_language_id, op4_token_counts, op5_pack_sequences, op6_quality_rules, op7_exact_dedup,
    op8_main_text, op9_lm_scores, op10_near_dedup, op11_vector_codes, op12_hard_negatives,
    op13_repeated_passages)}
ORACLES: dict[str, str] = {"op1_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (1 + length(translate(coalesce(text, ''), '#*$%&|<>', '')))::DOUBLE
           / (1 + length(coalesce(text, ''))) AS weight,
         (('0x' || substr(md5('0:' || doc_id::VARCHAR), 1, 12))::BIGINT + 0.5::DOUBLE)
           / 281474976710656 AS uniform
  FROM documents),
keyed AS (SELECT doc_id, source, size, -ln(uniform) / weight AS key FROM sized),
sums AS (SELECT source, sum(size)::BIGINT AS source_size,
                row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
         FROM keyed GROUP BY source),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
                   source_size * 2.0::DOUBLE AS cap,
                   sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM sums),
levelled AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                       / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT source, source_size, least(cap, coalesce(
              max(CASE WHEN cap / weight > level THEN level END) OVER () * weight, cap)) AS target
            FROM levelled),
wanted AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
           FROM targets),
placed AS (SELECT k.*, w.source_size, w.target, w.epochs,
                  w.target - w.epochs * w.source_size AS rest,
                  sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.size, k.doc_id) AS filled,
                   sum(k.size) OVER same AS block,
                   row_number() OVER (PARTITION BY k.source, k.key, k.size, k.doc_id) AS nth
            FROM keyed k JOIN wanted w ON k.source IS NOT DISTINCT FROM w.source
            WINDOW same AS (PARTITION BY k.source, k.key, k.size, k.doc_id)),
marked AS (SELECT *, filled <= rest OR (filled - block <= rest
                     AND nth <= floor((rest - filled + block) / size)) AS inside FROM placed),
gaps AS (SELECT *, rest - coalesce(sum(CASE WHEN inside THEN size END)
                                   OVER (PARTITION BY source), 0) AS gap,
                row_number() OVER (PARTITION BY source, size, doc_id, inside) AS spare FROM marked),
picks AS (SELECT source, max((size, doc_id)) AS pick FROM gaps
          WHERE NOT inside AND size > 0 AND size <= gap GROUP BY source)
SELECT g.doc_id, g.size::BIGINT AS size, g.source_size, g.target,
       ((g.epochs + CASE WHEN g.inside OR coalesce((g.size, g.doc_id) = p.pick
                              AND g.spare <= floor(g.gap / g.size), false)
                         THEN 1 ELSE 0 END) * g.size)::BIGINT AS taken, g.source
FROM gaps g LEFT JOIN picks p ON g.source IS NOT DISTINCT FROM p.source""", "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same
         AND row_number() OVER (PARTITION BY coalesce(text, ''), doc_id) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op10_near_dedup": r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    END) AS s FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
           FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id,
       d.doc_id = min(other) AS kept
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id""",
    "op11_vector_codes": f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    = len(embedding) AND len(embedding) > 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r FROM kept),
parts AS (SELECT r, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x
          FROM numbered, (SELECT unnest(range(4)) AS p)),
book0 AS (SELECT p, r AS e, x AS c FROM parts WHERE r < 256),
{code_rounds(4)},
codes AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code,
                 sum(best.d)::BIGINT AS error FROM near4 GROUP BY r)
SELECT vec_id, label, code, error,
       sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ','
               ORDER BY p, e)) FROM book4) AS codebooks_sha256
FROM numbered JOIN codes USING (r)""",
    "op12_hard_negatives": """
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(embedding) > 0),
scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS id,
         a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s
  FROM kept a JOIN kept b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (
                PARTITION BY anchor ORDER BY s DESC, id, other) <= 5)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER best)::INTEGER AS rank,
       n.id AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
  AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s
WINDOW best AS (PARTITION BY p.anchor, p.other ORDER BY n.s DESC, n.id, n.other)
QUALIFY row_number() OVER best <= 3""",
    "op13_repeated_passages": """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h
               FROM documents),
passages AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s
             FROM texts, unnest(range(len(h) // 2 - 49)) AS t(i)),
firsts AS (SELECT s, min(doc_id) AS m FROM passages GROUP BY s),
hits AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS step
         FROM passages JOIN firsts USING (s) WHERE m < doc_id),
runs AS (SELECT r, i, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (
           PARTITION BY r ORDER BY i) AS run FROM hits),
spans AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY r, run),
pieces AS (SELECT *, substr(h, 2 * coalesce(lag(b) OVER own, 0) + 1,
                            2 * (a - coalesce(lag(b) OVER own, 0))) AS before
           FROM spans JOIN texts USING (r) WINDOW own AS (PARTITION BY r ORDER BY a)),
cut AS (SELECT r, sum(b - a) AS n, count(*) AS k, max(b) AS last,
               string_agg(before, '' ORDER BY a) AS kept FROM pieces GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed,
       coalesce(k, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END))
         AS kept_sha256
FROM texts LEFT JOIN cut USING (r)"""}
