"""The cohort data model expressed over the given tables, in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoview.functions import scalars as S
from chronoview.operators import cohort as C
from chronoview.operators import joins as J
from chronoview.plans.manifest import freeze_label_map
from chronoview.session import spread

# Half-open protocol of the order-based samples, and their eligibility thresholds.
RANGES = (
    ("train", "1995-01-01", "1998-01-01"),
    ("validation", "1998-01-01", "1999-01-01"),
    ("test", "1999-01-01", "2001-01-01"),
)
MIN_FILES, MIN_MONTHS = 250, 30
CLASSES = 10
VIEW_OFFSETS = (
    ("raw_byte", 11, 0), ("entropy", 11, 10), ("sbsmi", 11, 20),
    ("raw_byte", 22, 30), ("entropy", 22, 40), ("sbsmi", 22, 50),
)


class Tables:
    """Frames over one scale-factor folder; nothing runs until a query uses them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """A table for heavy per-row work, over all cores even when it is one small file."""
        return spread(self.read(name), key)

    @cached_property
    def order_rows(self) -> DataFrame:
        """Orders beside their customer's segment and nation."""
        nation = self.read("nation").select("n_nationkey", "n_name")
        customer = self.read("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        return (self.read("orders")
                .join(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")),
                      F.col("o_custkey") == F.col("c_custkey"))
                .withColumn("key_sha", F.sha2(F.col("o_orderkey").cast("string"), 256)))

    @cached_property
    def samples(self) -> DataFrame:
        """Clean samples: sha, family, ts, month, split."""
        return self._samples(self.order_rows)

    def _samples(self, order_rows: DataFrame) -> DataFrame:
        ts = F.col("o_orderdate").cast("timestamp")
        return order_rows.select(
            F.col("key_sha").alias("sha"), F.col("n_name").alias("family"), ts.alias("ts"),
            S.month_label(ts).alias("month"), S.assign_split(ts, RANGES).alias("split"),
            "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")

    @cached_property
    def raw_metadata(self) -> DataFrame:
        """The same samples as dirty text: odd ids, mixed timestamps, blank families."""
        ts = F.col("o_orderdate").cast("timestamp")
        formats = {"1-URGENT": "yyyy-MM-dd HH:mm:ss", "2-HIGH": "MM/dd/yyyy",
                   "3-MEDIUM": "yyyy-MM-dd'T'HH:mm:ss'Z'", "4-NOT SPECIFIED": "yyyy/MM/dd"}
        text = F.when(F.col("o_totalprice") < 2000, F.lit("not a date"))
        for priority, fmt in formats.items():
            text = text.when(F.col("o_orderpriority") == priority, F.date_format(ts, fmt))
        sha = (F.when(F.col("o_totalprice") > 495000,
                      F.concat(F.lit("bad-"), F.col("o_orderkey").cast("string")))
               .when(F.col("o_orderpriority") == "5-LOW",
                     F.concat(F.lit("  "), F.upper("key_sha"), F.lit(" ")))
               .otherwise(F.col("key_sha")))
        family = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("  ")).otherwise(
            F.concat(F.lit(" "), F.col("n_name")))
        return self.order_rows.select(
            sha.alias("sha"), text.otherwise(F.date_format(ts, "yyyy-MM-dd")).alias("timestamp"),
            family.alias("family"), "o_orderkey")

    @cached_property
    def train(self) -> DataFrame:
        return self._samples(self.order_rows.where(
            S.in_splits(F.col("o_orderdate"), ["train"], RANGES)))

    @cached_property
    def support(self) -> DataFrame:
        return C.family_support(self.train, MIN_FILES, MIN_MONTHS)

    @cached_property
    def label_map(self) -> DataFrame:
        return freeze_label_map(self.train, MIN_FILES, MIN_MONTHS)

    @cached_property
    def pool(self) -> DataFrame:
        """All samples of the eligible families, whatever their date."""
        return J.attach_class_id(self.samples, self.label_map).select(
            "sha", "family", "class_id")

    @cached_property
    def manifest(self) -> DataFrame:
        """Eligible samples inside the protocol with class ids (families keep their case)."""
        known = self.samples.where(F.col("split").isin("train", "validation", "test"))
        return J.attach_class_id(known, self.label_map).select(
            "sha", "family", "class_id", "split", "month",
            S.iso_utc(F.col("ts")).alias("timestamp"), "ts", "o_totalprice")

    @cached_property
    def blobs(self) -> DataFrame:
        """Documents as binary samples."""
        return self.as_blobs(self.spread("documents", "doc_id"))

    @staticmethod
    def as_blobs(documents: DataFrame) -> DataFrame:
        day = F.date_add(F.lit("2019-08-01").cast("date"),
                         F.pmod(F.col("doc_id"), F.lit(425)).cast("int"))
        ts = day.cast("timestamp")
        sha = F.sha2(F.col("doc_id").cast("string"), 256)
        return documents.select(
            sha.alias("sha"), "doc_id", F.col("source").alias("family"),
            S.assign_split(ts).alias("split"), S.month_label(ts).alias("month"),
            S.iso_utc(ts).alias("timestamp"),
            F.concat(F.lit("altered/"), sha, F.lit(".exe")).alias("member"),
            F.encode(F.col("text"), "UTF-8").alias("content"))

    @cached_property
    def blob_manifest(self) -> DataFrame:
        """Manifest of the documents; the class id is the number in the source name."""
        return self.blobs.select(
            "sha", "family", F.regexp_extract("family", r"(\d+)", 1).cast("int").alias("class_id"),
            "split", "month", "timestamp")

    @cached_property
    def archive_index(self) -> DataFrame:
        return self.blobs.select("member", "sha", F.octet_length("content").cast("bigint")
                                 .alias("size"))

    @cached_property
    def predictions(self) -> DataFrame:
        """Two seeds of three ten-class views cut from the embedding dimensions."""
        models = F.explode(F.array(*(
            F.struct(F.lit(v).alias("view"), F.lit(s).alias("seed"), F.lit(o).alias("off"))
            for v, s, o in VIEW_OFFSETS)))
        rows = self.read("embeddings").withColumn("m", models)
        bonus = F.pmod(F.col("vec_id"), F.lit(3)) != 0
        logits = F.transform(
            F.slice("embedding", F.col("m.off") + 1, F.lit(CLASSES)),
            lambda x, i: x.cast("double") * 10
            + F.when(bonus & (i == F.col("label")), 4.0).otherwise(0.0))
        return rows.select(
            F.col("m.view").alias("view"), F.col("m.seed").alias("seed"),
            F.when(F.pmod(F.col("vec_id"), F.lit(2)) == 0, "2020-02").otherwise("2020-03")
            .alias("month"),
            F.sha2(F.col("vec_id").cast("string"), 256).alias("sha"), "label",
            logits.alias("logits"))

    @cached_property
    def fixed_temperatures(self) -> DataFrame:
        """A temperature per model that depends on nothing but its name and seed."""
        return self.predictions.select("view", "seed").distinct().withColumn(
            "temperature", F.lit(0.5) + F.length("view") / F.lit(8.0)
            + F.col("seed") / F.lit(44.0))

    @cached_property
    def history(self) -> DataFrame:
        """Training history: one metric per (view, seed, epoch)."""
        return self.read("events").groupBy(
            F.col("event_type").alias("view"), F.pmod(F.col("user_id"), F.lit(3)).alias("seed"),
            F.dayofmonth("ts").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("metric"))


# -- the same frames in SQL ------------------------------------------------------------

ORDER_ROWS = """order_rows AS (
  SELECT o.*, n_name, c_mktsegment, sha256(CAST(o_orderkey AS VARCHAR)) AS key_sha
  FROM orders o JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey)"""

SPLIT_CASE = """CASE WHEN {ts} IS NULL THEN 'invalid'
  WHEN {ts} >= TIMESTAMP '1995-01-01' AND {ts} < TIMESTAMP '1998-01-01' THEN 'train'
  WHEN {ts} >= TIMESTAMP '1998-01-01' AND {ts} < TIMESTAMP '1999-01-01' THEN 'validation'
  WHEN {ts} >= TIMESTAMP '1999-01-01' AND {ts} < TIMESTAMP '2001-01-01' THEN 'test'
  ELSE 'outside_protocol' END"""

SAMPLES = ORDER_ROWS + """, samples AS (
  SELECT key_sha AS sha, n_name AS family, o_orderdate AS ts,
    strftime(o_orderdate, '%Y-%m') AS month, """ + SPLIT_CASE.format(ts="o_orderdate") + """ AS split,
    o_orderkey, o_totalprice, o_orderpriority, o_orderstatus
  FROM order_rows)"""

SUPPORT = SAMPLES + """, support AS (
  SELECT family, count(DISTINCT sha) AS n_files, count(DISTINCT month) AS n_months,
    count(DISTINCT sha) >= 250 AND count(DISTINCT month) >= 30 AS eligible
  FROM samples WHERE split = 'train' GROUP BY family)"""

LABEL_MAP = SUPPORT + """, label_map AS (
  SELECT family, CAST(row_number() OVER (ORDER BY family) - 1 AS INTEGER) AS class_id,
    n_files, n_months FROM support WHERE eligible)"""

ISO_UTC = "strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"

MANIFEST = LABEL_MAP + """, manifest AS (
  SELECT sha, family, class_id, split, month, """ + ISO_UTC.format(ts="ts") + """ AS timestamp, ts,
    o_totalprice
  FROM samples JOIN label_map USING (family) WHERE split IN ('train', 'validation', 'test'))"""

RAW_METADATA = ORDER_ROWS + """, raw_metadata AS (
  SELECT CASE WHEN o_totalprice > 495000 THEN 'bad-' || CAST(o_orderkey AS VARCHAR)
      WHEN o_orderpriority = '5-LOW' THEN '  ' || upper(key_sha) || ' '
      ELSE key_sha END AS sha,
    CASE WHEN o_totalprice < 2000 THEN 'not a date'
      WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
      WHEN o_orderpriority = '2-HIGH' THEN strftime(o_orderdate, '%m/%d/%Y')
      WHEN o_orderpriority = '3-MEDIUM' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')
      WHEN o_orderpriority = '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%Y/%m/%d')
      ELSE strftime(o_orderdate, '%Y-%m-%d') END AS timestamp,
    CASE WHEN c_mktsegment = 'BUILDING' THEN '  ' ELSE ' ' || n_name END AS family, o_orderkey,
    CASE WHEN o_totalprice < 2000 THEN NULL
      WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN date_trunc('second', o_orderdate)
      ELSE date_trunc('day', o_orderdate) END AS parsed, o_orderpriority
  FROM order_rows)"""

STANDARD = RAW_METADATA + """, standard AS (
  SELECT lower(trim(sha)) AS sample_id,
    CASE WHEN regexp_full_match(lower(trim(sha)), '[0-9a-f]{64}') THEN lower(trim(sha)) END AS sha256,
    regexp_full_match(lower(trim(sha)), '[0-9a-f]{64}') AS is_valid_sha256,
    parsed AS ts, strftime(parsed, '%Y-%m') AS month, nullif(trim(family), '') AS family,
    nullif(trim(family), '') IS NOT NULL AS is_malware,
    """ + SPLIT_CASE.format(ts="parsed") + """ AS split
  FROM raw_metadata)"""

BLOB_SPLIT = """CASE WHEN ts < TIMESTAMP '2020-02-01' THEN 'train'
  WHEN ts < TIMESTAMP '2020-04-01' THEN 'validation'
  WHEN ts < TIMESTAMP '2020-10-01' THEN 'test' ELSE 'outside_protocol' END"""

BLOBS = """dated AS (
  SELECT *, CAST(DATE '2019-08-01' + CAST(doc_id % 425 AS INTEGER) AS TIMESTAMP) AS ts
  FROM documents), blobs AS (
  SELECT sha256(CAST(doc_id AS VARCHAR)) AS sha, doc_id, source AS family,
    """ + BLOB_SPLIT + """ AS split, strftime(ts, '%Y-%m') AS month,
    """ + ISO_UTC.format(ts="ts") + """ AS timestamp,
    'altered/' || sha256(CAST(doc_id AS VARCHAR)) || '.exe' AS member,
    encode(text) AS content, sha256(text) AS content_sha256, octet_length(encode(text)) AS size
  FROM dated)"""

BYTES = BLOBS + """, hexed AS (
  SELECT sha, doc_id, size AS n, regexp_extract_all(hex(content), '..') AS pairs FROM blobs),
bytes AS (
  SELECT sha, n, pos, CAST('0x' || h AS INTEGER) AS v FROM (
    SELECT sha, n, unnest(pairs) AS h, unnest(range(0, n)) AS pos FROM hexed))"""

STATES = BYTES + """, neighbours AS (
  SELECT sha, n, pos, v, lead(v, 1, 0) OVER (PARTITION BY sha ORDER BY pos) AS nv FROM bytes),
states AS (
  SELECT sha, (8 * pos + off) // 6 AS pos,
    ((v * 256 + nv) >> CAST(16 - off - least(6, 8 * n - 8 * pos - off) AS INTEGER))
      & ((1 << CAST(least(6, 8 * n - 8 * pos - off) AS INTEGER)) - 1) AS state
  FROM neighbours JOIN (VALUES (0, 0), (0, 6), (1, 4), (2, 2)) AS o(m, off) ON pos % 3 = m)"""

TRANSITIONS = STATES + """, transitions AS (
  SELECT * FROM (SELECT sha, pos, lag(state) OVER (PARTITION BY sha ORDER BY pos) AS prev,
    state AS cur FROM states) WHERE prev IS NOT NULL),
counted AS (SELECT sha, prev, cur, count(*) AS n FROM transitions GROUP BY ALL),
pixels AS (
  SELECT sha, prev, cur, n, n / sum(n) OVER (PARTITION BY sha, prev) AS p,
    CAST(floor(n / sum(n) OVER (PARTITION BY sha, prev) * 255) AS INTEGER) AS pixel
  FROM counted)"""

WINDOWS = BYTES + """, block_counts AS (
  SELECT sha, n, pos // 128 AS block, v, count(*) AS k FROM bytes GROUP BY ALL),
window_counts AS (
  SELECT sha, w, v, sum(k) AS k FROM (
    SELECT sha, n, v, k, block - d AS w FROM block_counts, (VALUES (0), (1)) AS s(d))
  WHERE w >= 0 AND w < greatest(1, CAST(ceil(n / 128.0) AS BIGINT) - 1) GROUP BY ALL),
windows AS (
  SELECT sha, w, least(greatest((log2(sum(k)) - sum(k * log2(k)) / sum(k)) / 8, 0), 1) AS h
  FROM window_counts GROUP BY ALL)"""

BLOCK_MEANS = WINDOWS + """, block_means AS (
  SELECT sha, block, avg(h) AS e FROM (
    SELECT sha, w + d AS block, h FROM windows, (VALUES (0), (1)) AS s(d))
  JOIN blobs USING (sha) WHERE block < CAST(ceil(size / 128.0) AS BIGINT)
  GROUP BY ALL)"""

PREDICTIONS = """models AS (
  SELECT * FROM (VALUES ('raw_byte', 11, 0), ('entropy', 11, 10), ('sbsmi', 11, 20),
    ('raw_byte', 22, 30), ('entropy', 22, 40), ('sbsmi', 22, 50)) AS m(view, seed, off)),
logits AS (
  SELECT view, seed, CASE WHEN vec_id % 2 = 0 THEN '2020-02' ELSE '2020-03' END AS month,
    sha256(CAST(vec_id AS VARCHAR)) AS sha, label, c,
    CAST(embedding[off + c + 1] AS DOUBLE) * 10
      + CASE WHEN c = label AND vec_id % 3 <> 0 THEN 4 ELSE 0 END AS z
  FROM embeddings, models, (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS c) AS classes)"""


def log_probabilities(source: str, target: str, temperature: str = "1.0") -> str:
    """SQL of log softmax(z / T) over the long logits."""
    return f"""{target} AS (
  SELECT view, seed, month, sha, label, c, z,
    t - ln(sum(exp(t)) OVER (PARTITION BY view, seed, month, sha)) AS lp
  FROM (SELECT *, z / ({temperature}) - max(z / ({temperature}))
          OVER (PARTITION BY view, seed, month, sha) AS t FROM {source}))"""


def scored(source: str, target: str, keys: str = "view, seed, month") -> str:
    """SQL of the per-sample scores over long log-probabilities (first maximum wins)."""
    return f"""{target} AS (
  SELECT {keys}, sha, label, min(CASE WHEN lp = top THEN c END) AS predicted,
    max(exp(lp)) AS confidence, max(CASE WHEN c = label THEN exp(lp) END) AS p_true,
    max(CASE WHEN c = label THEN -lp END) AS nll,
    greatest(0, sum(exp(lp) * exp(lp)) - 2 * max(CASE WHEN c = label THEN exp(lp) END) + 1) AS brier
  FROM (SELECT *, max(lp) OVER (PARTITION BY {keys}, sha) AS top FROM {source})
  GROUP BY {keys}, sha, label)"""


SCORED = PREDICTIONS + ", " + log_probabilities("logits", "lp") + ", " + scored("lp", "scored")
FIXED_T = "0.5 + length(view) / 8.0 + seed / 44.0"


def report(source: str, target: str, keys: str = "view, seed, month") -> str:
    """SQL of the scalar report of scored samples, fixed class count 10."""
    on = f"USING ({keys})"
    p = target
    return f"""{p}_cells AS (SELECT {keys}, label, predicted, count(*) AS n FROM {source}
    GROUP BY {keys}, label, predicted),
{p}_true AS (SELECT {keys}, label AS class_id, sum(n) AS support,
    sum(CASE WHEN label = predicted THEN n ELSE 0 END) AS tp FROM {p}_cells GROUP BY {keys}, label),
{p}_pred AS (SELECT {keys}, predicted AS class_id, sum(n) AS predicted_count
    FROM {p}_cells GROUP BY {keys}, predicted),
{p}_rates AS (SELECT {keys}, class_id, coalesce(support, 0) AS support,
    coalesce(predicted_count, 0) AS predicted_count, coalesce(tp, 0) AS tp,
    CASE WHEN predicted_count > 0 THEN coalesce(tp, 0) / predicted_count END AS p,
    CASE WHEN support > 0 THEN tp / support END AS r,
    2 * coalesce(tp, 0) / (coalesce(support, 0) + coalesce(predicted_count, 0)) AS f
  FROM {p}_true FULL JOIN {p}_pred USING ({keys}, class_id)),
{p}_avg AS (SELECT {keys}, CAST(sum(support) AS BIGINT) AS n_samples,
    count(*) FILTER (support > 0) AS n_supported_classes, sum(tp) / sum(support) AS accuracy,
    avg(coalesce(p, 0)) FILTER (support > 0) AS macro_precision_supported,
    sum(coalesce(p, 0)) / 10 AS macro_precision_fixed,
    sum(coalesce(p, 0) * support) / sum(support) AS weighted_precision,
    avg(coalesce(r, 0)) FILTER (support > 0) AS macro_recall_supported,
    sum(coalesce(r, 0)) / 10 AS macro_recall_fixed,
    sum(coalesce(r, 0) * support) / sum(support) AS weighted_recall,
    avg(coalesce(f, 0)) FILTER (support > 0) AS macro_f1_supported,
    sum(coalesce(f, 0)) / 10 AS macro_f1_fixed,
    sum(coalesce(f, 0) * support) / sum(support) AS weighted_f1,
    avg(r) FILTER (support > 0) AS balanced_accuracy FROM {p}_rates GROUP BY {keys}),
{p}_bins AS (SELECT {keys}, least(CAST(floor(confidence * 15) AS INTEGER), 14) AS bin,
    count(*) AS count, avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END) AS accuracy,
    avg(confidence) AS confidence FROM {source} GROUP BY ALL),
{p}_ece AS (SELECT {keys}, sum(count * abs(accuracy - confidence)) / sum(count) AS ece
    FROM {p}_bins GROUP BY {keys}),
{p}_loss AS (SELECT {keys}, avg(nll) AS nll, avg(brier) AS brier, avg(confidence) AS mean_confidence
    FROM {source} GROUP BY {keys}),
{p} AS (SELECT * FROM {p}_avg JOIN {p}_loss {on} JOIN {p}_ece {on})"""


HISTORY = """history AS (
  SELECT event_type AS view, user_id % 3 AS seed, day(ts) AS epoch, round(avg(value), 6) AS metric
  FROM events GROUP BY ALL)"""
