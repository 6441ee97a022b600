"""Cohort queries: sources, scalars, selection, joins, support, folds, validation, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoview.catalog import tables as Q
from chronoview.catalog.registry import query
from chronoview.catalog.tables import MIN_FILES, MIN_MONTHS, RANGES, Tables
from chronoview.functions import scalars as S
from chronoview.operators import cohort as C
from chronoview.operators import folds as D
from chronoview.operators import joins as J
from chronoview.operators import names as N
from chronoview.operators import provenance as P
from chronoview.operators import selection as L
from chronoview.operators import validate as V
from chronoview.plans import manifest as M
from chronoview.session import freeze, scratch_path, staged
from chronoview.sources import binaries as B
from chronoview.sources import sinks as W
from chronoview.sources import tables as T

TRAIN_START, TRAIN_STOP = RANGES[0][1], RANGES[0][2]


def sql(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


# -- sources and sinks ------------------------------------------------------------------

@query("a1_scan_metadata", sql(Q.RAW_METADATA, """
SELECT sha, timestamp, family FROM raw_metadata"""))
def _(t: Tables):
    path = scratch_path(t.spark, "metadata")
    W.write_contract_csv(t.raw_metadata, path, ["sha", "timestamp", "family"])
    return T.scan_metadata(t.spark, path)


@query("a2_resolve_columns", sql(Q.SAMPLES, """
SELECT family, count(*) AS n, count(DISTINCT sha) AS n_ids FROM samples GROUP BY family"""))
def _(t: Tables):
    renamed = t.samples.withColumnsRenamed({"sha": "sample_id", "family": "family_norm"})
    return T.resolve_columns(renamed).groupBy("family").agg(
        F.count("*").alias("n"), F.count_distinct("sha").alias("n_ids"))


@query("a3_scan_contract_csv", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer""")
def _(t: Tables):
    path = scratch_path(t.spark, "contract")
    W.write_contract_csv(t.read("customer"), path, ["c_custkey", "c_name", "c_mktsegment"])
    return T.scan_contract_csv(t.spark, path, {"c_custkey", "c_name"})


@query("a4_load_label_map", sql(Q.LABEL_MAP, """
SELECT lower(family) AS family, class_id FROM label_map"""))
def _(t: Tables):
    path = scratch_path(t.spark, "label-map")
    W.write_contract_csv(t.label_map, path, ["family", "class_id"], ["class_id"])
    return T.load_label_map(t.spark, path)


@query("a5_load_manifest", sql(Q.MANIFEST, """
SELECT sha, lower(family) AS family, class_id, split, month, timestamp,
  CAST(floor(o_totalprice) AS BIGINT) AS file_size, CAST(NULL AS VARCHAR) AS zip_crc32
FROM manifest"""))
def _(t: Tables):
    path = scratch_path(t.spark, "manifest")
    rows = t.manifest.withColumn("file_size", F.floor("o_totalprice")) \
        .withColumn("zip_crc32", F.lit(""))
    W.write_contract_csv(rows, path, T.MANIFEST_COLUMNS)
    label_map = t.label_map.withColumn("family", F.lower("family"))
    return T.load_manifest(t.spark, path, label_map, RANGES)


@query("a6_scan_binary_folder")
def _(t: Tables):
    listing = B.scan_binary_folder(t.spark, t.folder, content=False)
    return listing.select(S.base_name(F.col("member")).alias("name"), "size")


@query("a10_scan_json_records", sql(Q.HISTORY, "SELECT * FROM history"))
def _(t: Tables):
    path = scratch_path(t.spark, "history")
    W.write_json_record(t.history, path)
    return T.scan_json_records(t.spark, path,
                               "view string, seed bigint, epoch int, metric double") \
        .withColumn("epoch", F.col("epoch").cast("bigint"))


@query("a12_write_contract_csv", sql(Q.SUPPORT, """
SELECT family, CAST(n_files AS VARCHAR) AS n_files, CAST(n_months AS VARCHAR) AS n_months
FROM support"""))
def _(t: Tables):
    path = scratch_path(t.spark, "support")
    W.write_contract_csv(t.support, path, ["family", "n_files", "n_months"],
                         [F.desc("n_files"), F.col("family")])
    return T.scan_contract_csv(t.spark, path)


@query("a13_write_json_record", sql(Q.SUPPORT, """
SELECT family, n_files, n_months, eligible FROM support"""))
def _(t: Tables):
    path = scratch_path(t.spark, "support-json")
    W.write_json_record(t.support, path)
    return T.scan_json_records(t.spark, path,
                               "family string, n_files bigint, n_months bigint, eligible boolean")


@query("a16_refuse_clobber", """
SELECT 'input:nation' AS name UNION ALL SELECT 'setting:k' AS name""")
def _(t: Tables):
    first = P.run_identity({"k": 10, "metric": "f1"}, {"nation": t.read("nation")})
    other = P.run_identity({"k": 5, "metric": "f1"}, {"nation": t.read("nation").where(
        F.col("n_regionkey") > 0)})
    return P.identity_conflicts(P.identity_rows(t.spark, first),
                                P.identity_rows(t.spark, other)).select("name")


# -- scalar functions -------------------------------------------------------------------

@query("b1_normalize_id", sql(Q.RAW_METADATA, """
SELECT o_orderkey, lower(trim(sha)) AS sample_id FROM raw_metadata"""))
def _(t: Tables):
    return t.raw_metadata.select("o_orderkey", S.normalize_id(F.col("sha")).alias("sample_id"))


@query("b2_is_sha256", sql(Q.STANDARD, """
SELECT sample_id, is_valid_sha256, sha256 FROM standard"""))
def _(t: Tables):
    return t.raw_metadata.select(
        S.normalize_id(F.col("sha")).alias("sample_id"),
        S.is_sha256(F.col("sha")).alias("is_valid_sha256"),
        S.valid_sha_or_null(F.col("sha")).alias("sha256"))


@query("b3_normalize_family", sql(Q.RAW_METADATA, """
SELECT o_orderkey, nullif(trim(family), '') AS family, lower(nullif(trim(family), '')) AS family_norm,
  nullif(trim(family), '') IS NOT NULL AS is_malware FROM raw_metadata"""))
def _(t: Tables):
    family = F.col("family")
    return t.raw_metadata.select(
        "o_orderkey", S.normalize_family(family).alias("family"),
        S.normalize_family(family, lower=True).alias("family_norm"),
        S.is_malware(family).alias("is_malware"))


@query("b4_parse_mixed_timestamp", sql(Q.RAW_METADATA, """
SELECT o_orderkey, timestamp, """ + Q.ISO_UTC.format(ts="parsed") + """ AS parsed
FROM raw_metadata"""))
def _(t: Tables):
    return t.raw_metadata.select(
        "o_orderkey", "timestamp",
        S.iso_utc(S.parse_mixed_timestamp(F.col("timestamp"))).alias("parsed"))


@query("b5_parse_iso_timestamp", sql(Q.RAW_METADATA, """
SELECT o_orderkey, strftime(iso, '%Y-%m-%d') AS day, strftime(iso, '%Y-%m') AS month,
  iso IS NULL AS invalid
FROM (SELECT o_orderkey, CASE WHEN o_orderpriority NOT IN ('2-HIGH', '4-NOT SPECIFIED')
  THEN parsed END AS iso FROM raw_metadata)"""))
def _(t: Tables):
    ts = S.parse_iso_timestamp(F.col("timestamp"))
    return t.raw_metadata.select(
        "o_orderkey", S.day_label(ts).alias("day"), S.month_label(ts).alias("month"),
        ts.isNull().alias("invalid"))


@query("b6_time_labels", sql(Q.SAMPLES, """
SELECT sha, strftime(ts, '%Y-%m') AS month, CAST(year(ts) AS INTEGER) AS year,
  strftime(ts, '%Y-%m-%d') AS day, """ + Q.ISO_UTC.format(ts="ts") + """ AS iso_utc
FROM samples"""))
def _(t: Tables):
    ts = F.col("ts")
    return t.samples.select("sha", S.month_label(ts).alias("month"), F.year(ts).alias("year"),
                            S.day_label(ts).alias("day"), S.iso_utc(ts).alias("iso_utc"))


@query("b7_assign_split", sql(Q.STANDARD, """
SELECT split, count(*) AS n, count(DISTINCT sample_id) AS n_ids FROM standard GROUP BY split"""))
def _(t: Tables):
    return C.standardize(t.raw_metadata, RANGES).groupBy("split").agg(
        F.count("*").alias("n"), F.count_distinct("sample_id").alias("n_ids"))


@query("b8_normalize_split", """
SELECT event_type AS raw, CASE event_type WHEN 'click' THEN 'train' WHEN 'view' THEN 'test'
  WHEN 'error' THEN 'validation' END AS split, count(*) AS n FROM events GROUP BY ALL""")
def _(t: Tables):
    text = (F.when(F.col("event_type") == "click", " Train ")
            .when(F.col("event_type") == "view", "FUTURE_TEST")
            .when(F.col("event_type") == "error", "validation").otherwise("holdout"))
    return (t.read("events").select(F.col("event_type").alias("raw"),
                                    S.normalize_split(text).alias("split"))
            .groupBy("raw", "split").agg(F.count("*").alias("n")))


@query("b9_integer_column", """
SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN o_orderkey
  WHEN '2-HIGH' THEN CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(o_totalprice AS BIGINT) END
  WHEN '3-MEDIUM' THEN NULL WHEN '4-NOT SPECIFIED' THEN o_orderkey END AS VARCHAR) AS value FROM orders""")
def _(t: Tables):
    key = F.col("o_orderkey").cast("string")
    text = (F.when(F.col("o_orderpriority") == "1-URGENT", key)
            .when(F.col("o_orderpriority") == "2-HIGH", F.col("o_totalprice").cast("string"))
            .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit("-1"), key))
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(key, F.lit(".0")))
            .otherwise("true"))
    return t.read("orders").select("o_orderkey", S.integer_or_null(text).cast("string")
                                   .alias("value"))


@query("b10_sha_from_filename", r"""
SELECT page_id, regexp_replace(lower(regexp_extract(replace(url, '\', '/'), '([^/]*)$', 1)),
  '\.exe$', '') AS name FROM pages""")
def _(t: Tables):
    return t.read("pages").select("page_id", S.sha_from_filename(F.col("url")).alias("name"))


@query("b11_resolve_path", r"""
SELECT page_id, CASE WHEN contains(url, '?') THEN NULL
  ELSE 'root/' || regexp_replace(url, '^https?://', '') END AS path,
  NOT contains(url, '?') AS safe FROM pages""")
def _(t: Tables):
    relative = F.regexp_replace("url", "^https?://", "")
    path = F.when(F.contains("url", F.lit("?")), F.concat(F.lit("../"), relative)) \
        .otherwise(relative)
    return t.read("pages").select("page_id", S.resolve_path("root/", path).alias("path"),
                                  S.is_safe_relative(path).alias("safe"))


@query("b12_image_path", sql(Q.SAMPLES, """
SELECT sha, family || '/' || sha || '.png' AS family_path,
  split || '/' || month || '/sbsmi/' || sha || '.png' AS sbsmi_path,
  split || '/' || month || '/entropy/' || sha || '.npy' AS entropy_path FROM samples"""))
def _(t: Tables):
    def view(name: str):
        return S.view_path(F.col("split"), F.col("month"), F.lit(name), F.col("sha"))
    return t.samples.select(
        "sha", S.family_image_path(F.col("family"), F.col("sha")).alias("family_path"),
        view("sbsmi").alias("sbsmi_path"), view("entropy").alias("entropy_path"))


@query("b13_content_fingerprint", sql(Q.BLOBS, """
SELECT sha, content_sha256, CAST(size AS BIGINT) AS content_size FROM blobs"""))
def _(t: Tables):
    prints = S.content_fingerprint(F.col("content"))
    return t.blobs.select("sha", prints["content_sha256"].alias("content_sha256"),
                          prints["content_size"].alias("content_size"))


@query("b14_canonical_hash", sql(Q.SAMPLES, """
SELECT sha, sha256('{"family":"' || family || '","month":"' || month || '","sha":"' || sha || '"}')
  AS record_hash FROM samples"""))
def _(t: Tables):
    return t.samples.select("sha", S.canonical_hash("sha", "month", "family")
                            .alias("record_hash"))


@query("b15_scale_pixels", """
SELECT vec_id, CAST(sum(p) AS BIGINT) AS preview_sum, round(sum(p / 255.0), 6) AS unit_sum FROM (
  SELECT vec_id, floor(least(greatest(CAST(unnest(embedding) AS DOUBLE) * 255, 0), 255)) AS p
  FROM embeddings) GROUP BY vec_id""")
def _(t: Tables):
    total = t.read("embeddings").select(
        "vec_id", S.preview_pixels(F.col("embedding")).alias("p"))
    return total.select(
        "vec_id", F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x)
        .alias("preview_sum"),
        F.round(F.aggregate(S.unit_pixels(F.col("p")), F.lit(0.0), lambda a, x: a + x), 6)
        .alias("unit_sum"))


def _horner(n: int) -> str:
    rest = "CAST(0 AS BIGINT)"
    for word in range(8):
        rest = (f"(({rest}) * {(1 << 32) % n} + CAST('0x' || substr(sha, {8 * word + 1}, 8) "
                f"AS BIGINT)) % {n}")
    return rest


@query("b16_hex_mod", sql(Q.SAMPLES, f"SELECT sha, {_horner(7)} AS shard FROM samples"))
def _(t: Tables):
    return t.samples.select("sha", S.hex_mod(F.col("sha"), 7).alias("shard"))


@query("b19_round_pct", """
SELECT n_name AS family, cur, ref, cur - ref AS difference,
  round((cur - ref) * 100.0 / ref, 2) AS percent_difference FROM (
  SELECT n_name, count(*) AS cur, count(*) FILTER (o_orderstatus <> 'P') AS ref
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_name)""")
def _(t: Tables):
    counts = t.samples.groupBy("family").agg(
        F.count("*").alias("cur"), F.count_if(F.col("o_orderstatus") != "P").alias("ref"))
    return counts.select("family", "cur", "ref", (F.col("cur") - F.col("ref"))
                         .alias("difference"),
                         S.percent_difference(F.col("cur"), F.col("ref"))
                         .alias("percent_difference"))


@query("b22_standard_manifest", sql(Q.STANDARD, """
SELECT sample_id, sha256, is_valid_sha256, """ + Q.ISO_UTC.format(ts="ts") + """ AS timestamp, month,
  family, split, false AS binary_available
FROM standard WHERE is_malware AND split IN ('train', 'validation', 'test')"""))
def _(t: Tables):
    malware = C.malware_manifest(C.standardize(t.raw_metadata, RANGES))
    return malware.withColumn("timestamp", S.iso_utc(F.col("timestamp"))).drop("is_malware")


@query("b22_standard_manifest_problems", sql(Q.STANDARD, """
SELECT count(*) FILTER (is_malware AND ts IS NULL) AS null_timestamps,
  count(*) FILTER (is_malware AND sha256 IS NULL) AS null_sha256,
  count(*) FILTER (is_malware AND split NOT IN ('train', 'validation', 'test')) AS outside_splits
FROM standard"""))
def _(t: Tables):
    return C.malware_manifest_problems(C.standardize(t.raw_metadata, RANGES))


# -- selection --------------------------------------------------------------------------

@query("c1_filter_eligible", sql(Q.LABEL_MAP, """
SELECT sha, family, split, month FROM samples WHERE family IN (SELECT family FROM label_map)"""))
def _(t: Tables):
    return L.filter_eligible(t.samples, t.label_map).select("sha", "family", "split", "month")


NAMES = ("nation_2", "nation_3", "nation_11", "nation_17", "nation_24")


@query("c2_filter_candidates", sql(Q.STANDARD, f"""
SELECT sha256, month, family FROM standard
WHERE is_valid_sha256 AND lower(family) IN {NAMES}"""))
def _(t: Tables):
    return L.filter_candidates(C.standardize(t.raw_metadata, RANGES), NAMES).select(
        "sha256", "month", "family")


@query("c3_select_rows", sql(Q.MANIFEST, f"""
SELECT sha, split, month FROM (
  SELECT sha, split, month, row_number() OVER (PARTITION BY split ORDER BY month, sha) AS n
  FROM manifest WHERE split IN ('train', 'validation') AND {_horner(4)} = 1) WHERE n <= 40"""))
def _(t: Tables):
    return L.select_rows(t.manifest, ["train", "validation"], limit=40, shard_id=1,
                         num_shards=4).select("sha", "split", "month")


@query("c3_select_rows_large_limit", sql(Q.MANIFEST, """
SELECT sha, split, month FROM (
  SELECT sha, split, month, row_number() OVER (PARTITION BY split ORDER BY month, sha) AS n
  FROM manifest) WHERE n <= 1500"""))
def _(t: Tables):
    return L.select_rows(t.manifest, S.SPLIT_ORDER, limit=1500).select("sha", "split", "month")


@query("c4_sample_per_family", sql(Q.LABEL_MAP, """
SELECT family, sha FROM (SELECT family, sha, row_number() OVER (
  PARTITION BY family ORDER BY sha256('42:' || sha), sha) AS n FROM samples) WHERE n <= 10"""))
def _(t: Tables):
    return L.sample_per_family(t.samples, 10, 42).select("family", "sha")


@query("c4_short_families", sql(Q.SAMPLES, """
SELECT f.family, count(s.sha) AS available FROM (VALUES ('NATION_2'), ('NATION_7'), ('ATLANTIS')) AS f(family)
LEFT JOIN samples s ON s.family = f.family GROUP BY f.family HAVING count(s.sha) < 600"""))
def _(t: Tables):
    return L.short_families(t.samples, ["NATION_2", "NATION_7", "ATLANTIS"], 600)


@query("c5_select_training_samples", sql(Q.SAMPLES, """
SELECT sha, family, month FROM samples WHERE split = 'train'"""))
def _(t: Tables):
    rows = t.samples.withColumn("timestamp", F.col("ts"))
    return L.select_training(rows, TRAIN_START, TRAIN_STOP).select("sha", "family", "month")


@query("c5_training_label_conflicts", sql(Q.SAMPLES, """
SELECT sha, 'train_label_disagrees' AS rule FROM samples
WHERE (split = 'train' AND o_orderpriority <> '1-URGENT') <> (split = 'train')"""))
def _(t: Tables):
    labelled = t.samples.withColumn("timestamp", F.col("ts")).withColumn("split", F.when(
        (F.col("split") == "train") & (F.col("o_orderpriority") == "1-URGENT"), "future_test")
        .otherwise(F.col("split")))
    return L.training_label_conflicts(labelled, TRAIN_START, TRAIN_STOP)


@query("c6_first_n_available", sql(Q.BLOBS, """
SELECT sha, member, CAST(size AS BIGINT) AS size FROM blobs
WHERE split = 'train' AND size > 0 AND size <= 4000 ORDER BY sha LIMIT 25"""))
def _(t: Tables):
    train = t.blob_manifest.where(F.col("split") == "train").select("sha")
    return L.first_n_available(train, t.archive_index, 25, 4000).select("sha", "member", "size")


@query("c7_guard_future", sql(Q.SAMPLES, """
SELECT test_rows, other_rows, unnest(['future_test_mixed_with_other_splits',
  'future_test_without_frozen_config']) AS rule
FROM (SELECT count(*) FILTER (split = 'test') AS test_rows,
  count(*) FILTER (split <> 'test') AS other_rows FROM samples)
WHERE test_rows > 0 AND other_rows > 0"""))
def _(t: Tables):
    return L.guard_future(t.samples, None, "config")


@query("c8_pilot_split", sql(Q.SAMPLES, """
SELECT CASE WHEN month <= '1997-09' THEN 'fit' ELSE 'holdout' END AS part, month, count(*) AS n
FROM samples WHERE split = 'train' GROUP BY ALL"""))
def _(t: Tables):
    fit, holdout = L.pilot_split(t.train, "1997-09", ["1997-10", "1997-11", "1997-12"])
    both = fit.withColumn("part", F.lit("fit")).unionByName(
        holdout.withColumn("part", F.lit("holdout")))
    return both.groupBy("part", "month").agg(F.count("*").alias("n"))


@query("c8_pilot_month_problems", sql(Q.SAMPLES, """
SELECT coalesce(e.month, s.month) AS month,
  CASE WHEN s.month IS NULL THEN 'missing_month' ELSE 'unexpected_month' END AS rule
FROM (VALUES ('1997-11'), ('1997-12'), ('1998-01')) AS e(month) FULL JOIN (
  SELECT DISTINCT month FROM samples WHERE split = 'train' AND month > '1997-09') s
  ON e.month = s.month WHERE e.month IS NULL OR s.month IS NULL"""))
def _(t: Tables):
    _, holdout = L.pilot_split(t.train, "1997-09", ["1997-11", "1997-12", "1998-01"])
    return L.pilot_month_problems(holdout, ["1997-11", "1997-12", "1998-01"])


@query("c9_skip_completed", sql(Q.SAMPLES, """
SELECT sha, modality FROM samples, (VALUES ('raw_byte'), ('sbsmi')) AS m(modality)
WHERE NOT (modality = 'sbsmi' AND o_orderstatus IN ('F', 'O'))"""))
def _(t: Tables):
    todo = t.samples.select("sha", F.explode(F.array(F.lit("raw_byte"), F.lit("sbsmi")))
                            .alias("modality"))
    log = t.samples.select("sha", F.lit("sbsmi").alias("modality"), F.when(
        F.col("o_orderstatus") == "F", "CREATED").when(
        F.col("o_orderstatus") == "O", "skipped").otherwise("ERROR").alias("status"))
    return L.skip_completed(todo, log)


@query("c10_invalid_examples", sql(Q.RAW_METADATA, """
SELECT sha, timestamp, family, concat_ws('+', CASE WHEN sha LIKE 'bad-%' THEN 'id' END,
  CASE WHEN parsed IS NULL THEN 'timestamp' END) AS problem
FROM raw_metadata WHERE sha LIKE 'bad-%' OR parsed IS NULL
ORDER BY lower(trim(sha)), sha LIMIT 10"""))
def _(t: Tables):
    return L.invalid_examples(t.raw_metadata, 10)


# -- joins ------------------------------------------------------------------------------

@query("d1_attach_class_id", sql(Q.LABEL_MAP, """
SELECT sha, family, class_id FROM samples JOIN label_map USING (family)"""))
def _(t: Tables):
    return J.attach_class_id(t.samples, t.label_map).select("sha", "family", "class_id")


INDEX_SQL = """, size_index AS (
  SELECT sha, CAST(floor(o_totalprice) AS BIGINT) AS file_size, substr(sha, 1, 8) AS zip_crc32
  FROM samples WHERE o_orderstatus <> 'P')"""


def _size_index(t: Tables):
    return t.samples.where(F.col("o_orderstatus") != "P").select(
        "sha", F.floor("o_totalprice").alias("file_size"),
        F.substring("sha", 1, 8).alias("zip_crc32"))


@query("d2_attach_index", sql(Q.SAMPLES + INDEX_SQL, """
SELECT s.sha, family, CAST(file_size AS VARCHAR) AS file_size, zip_crc32 FROM samples s LEFT JOIN size_index i ON s.sha = i.sha"""))
def _(t: Tables):
    return J.attach_index(t.samples, _size_index(t)).select(
        "sha", "family", F.col("file_size").cast("string").alias("file_size"), "zip_crc32")


SOURCES_SQL = """, wanted AS (SELECT sha256(CAST(c_custkey AS VARCHAR)) AS sha FROM customer),
members AS (SELECT sha256(CAST(o_custkey AS VARCHAR)) AS sha,
  'orders/' || CAST(o_orderkey AS VARCHAR) AS member, o_orderkey AS size FROM orders)"""


def _sources(t: Tables):
    wanted = t.read("customer").select(F.sha2(F.col("c_custkey").cast("string"), 256)
                                       .alias("sha"))
    members = t.read("orders").select(
        F.sha2(F.col("o_custkey").cast("string"), 256).alias("sha"),
        F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("member"),
        F.col("o_orderkey").alias("size"))
    return wanted, members


@query("d3_match_sources", sql(Q.ORDER_ROWS + SOURCES_SQL, """
SELECT w.sha, count(member) AS matches, CASE count(member) WHEN 0 THEN 'missing' WHEN 1 THEN 'matched'
  ELSE 'ambiguous' END AS status, CASE count(member) WHEN 1 THEN min(member) END AS member,
  CAST(CASE count(member) WHEN 1 THEN min(size) END AS VARCHAR) AS size
FROM wanted w LEFT JOIN members m ON w.sha = m.sha GROUP BY w.sha"""))
def _(t: Tables):
    return J.match_sources(*_sources(t)).withColumn("size", F.col("size").cast("string"))


@query("d3_match_candidates", sql(Q.ORDER_ROWS + SOURCES_SQL, """
SELECT w.sha, CASE WHEN n IS NULL THEN 'missing' ELSE 'ambiguous' END AS status,
  coalesce(n, 0) AS matches, member
FROM wanted w LEFT JOIN (SELECT sha, count(*) AS n FROM members GROUP BY sha) c ON w.sha = c.sha
LEFT JOIN members m ON w.sha = m.sha WHERE n IS NULL OR n <> 1"""))
def _(t: Tables):
    return J.match_candidates(*_sources(t))


@query("d4_range_split_join", sql(Q.SAMPLES, """
SELECT sha, split FROM samples"""))
def _(t: Tables):
    ranges = t.spark.createDataFrame(list(RANGES), "split string, start string, stop string")
    return J.range_split_join(t.samples.drop("split"), ranges).select("sha", "split")


def _id_sets(t: Tables):
    rows = t.samples
    return {"metadata": rows.where(F.col("o_orderstatus") != "P"),
            "archive": rows.where(F.col("o_orderpriority") != "5-LOW"),
            "disarmed": rows.where(F.col("o_totalprice") < 400000)}


@query("d5_id_cross_check", sql(Q.SAMPLES + """, held AS (
  SELECT sha, o_orderstatus <> 'P' AS metadata, o_orderpriority <> '5-LOW' AS archive,
    o_totalprice < 400000 AS disarmed FROM samples)""", """
SELECT count(*) FILTER (metadata) AS metadata_ids, count(*) FILTER (archive) AS archive_ids,
  count(*) FILTER (disarmed) AS disarmed_ids,
  count(*) FILTER (metadata AND NOT archive) AS metadata_missing_from_archive,
  count(*) FILTER (metadata AND NOT disarmed) AS metadata_missing_from_disarmed,
  count(*) FILTER (archive AND NOT metadata) AS archive_missing_from_metadata,
  count(*) FILTER (archive AND NOT disarmed) AS archive_missing_from_disarmed,
  count(*) FILTER (disarmed AND NOT metadata) AS disarmed_missing_from_metadata,
  count(*) FILTER (disarmed AND NOT archive) AS disarmed_missing_from_archive FROM held"""))
def _(t: Tables):
    return J.id_cross_check(_id_sets(t))


@query("d9_split_fold", sql(Q.LABEL_MAP, """
SELECT CAST(0 AS BIGINT) AS overlap, count(*) AS total FROM samples JOIN label_map USING (family)"""))
def _(t: Tables):
    train, test = J.split_fold(staged(_folds(t), "folds"), 3)
    both = train.select(F.lit(1).alias("one")).unionByName(test.select(F.lit(1).alias("one")))
    return J.overlap(train, test).agg(F.count("*").alias("overlap")).select(
        "overlap", both.agg(F.count("*")).scalar().alias("total"))


@query("d10_similar_names")
def _(t: Tables):
    support = t.read("part").groupBy(F.col("p_name").alias("family")).agg(
        F.count("*").alias("support"))
    return N.similar_names(support, 0.80)


@query("d11_densify", sql(Q.SAMPLES, """
SELECT f.family, m.split, count(s.sha) AS n
FROM (VALUES ('NATION_2'), ('NATION_7'), ('ATLANTIS')) AS f(family),
  (VALUES ('train'), ('validation'), ('test'), ('invalid')) AS m(split)
LEFT JOIN samples s ON s.family = f.family AND s.split = m.split GROUP BY ALL"""))
def _(t: Tables):
    cells = C.counts_by(t.samples, "family", "split")
    return C.densify(cells, ["NATION_2", "NATION_7", "ATLANTIS"], "family",
                     ["train", "validation", "test", "invalid"], "split", "n")


@query("d12_compare_expected", sql(Q.SAMPLES + """, joined AS (
  SELECT coalesce(e.family, c.family) AS family, coalesce(expected, 0) AS expected,
    coalesce(current, 0) AS current
  FROM (SELECT family, count(*) AS expected FROM samples WHERE split = 'train' GROUP BY family) e
  FULL JOIN (SELECT family, count(DISTINCT sha) AS current FROM samples
    WHERE split = 'test' AND o_orderpriority <> '5-LOW' GROUP BY family) c ON e.family = c.family)""", """
SELECT coalesce(family, 'TOTAL') AS family, CAST(sum(expected) AS BIGINT) AS expected,
  CAST(sum(current) AS BIGINT) AS current, CAST(sum(current) - sum(expected) AS BIGINT) AS difference,
  CASE WHEN sum(expected) <> 0 THEN
    round((sum(current) - sum(expected)) * 100.0 / sum(expected), 2) END AS percent_difference
FROM joined GROUP BY ROLLUP (family)"""))
def _(t: Tables):
    expected = C.counts_by(t.train, "family", name="expected")
    current = C.distinct_files(t.samples.where(
        (F.col("split") == "test") & (F.col("o_orderpriority") != "5-LOW")), "family",
        name="current")
    return C.compare_expected(expected, current)


@query("d13_log_covers_cohort", sql(Q.SAMPLES, """
SELECT sha, CASE WHEN o_orderpriority = '5-LOW' THEN 'not_logged'
  WHEN o_orderstatus = 'P' THEN 'not_in_cohort' WHEN o_orderpriority = '2-HIGH' THEN 'logged_more_than_once'
  WHEN o_totalprice > 480000 THEN 'columns_differ' END AS rule
FROM samples WHERE NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'P') AND (
  o_orderpriority IN ('5-LOW', '2-HIGH') OR o_orderstatus = 'P' OR o_totalprice > 480000)"""))
def _(t: Tables):
    rows = t.samples.withColumn("path", F.concat_ws("/", "family", "sha"))
    cohort = rows.where(F.col("o_orderstatus") != "P")
    copies = F.when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(1)
    log = rows.where(F.col("o_orderpriority") != "5-LOW").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), copies))).withColumn("family", F.when(
            F.col("o_totalprice") > 480000, "OTHER").otherwise(F.col("family")))
    return J.log_coverage(log, cohort)


@query("d14_build_manifest", sql(Q.LABEL_MAP + INDEX_SQL, """
SELECT s.sha, lower(family) AS family, class_id, split, month,
  """ + Q.ISO_UTC.format(ts="ts") + """ AS timestamp,
  CAST(file_size AS VARCHAR) AS file_size, zip_crc32
FROM samples s JOIN label_map USING (family) LEFT JOIN size_index i ON s.sha = i.sha
WHERE split IN ('train', 'validation', 'test')"""))
def _(t: Tables):
    metadata = t.samples.select(
        F.col("sha").alias("sha256"), F.concat(F.lit(" "), "family").alias("family_norm"),
        F.date_format("ts", "MM/dd/yyyy HH:mm:ss").alias("timestamp"))
    label_map = freeze(t.label_map.withColumn("family", F.lower("family")))
    rows = M.build_manifest(metadata, label_map, _size_index(t), RANGES)
    return rows.withColumn("file_size", F.col("file_size").cast("string"))


# -- aggregates -------------------------------------------------------------------------

@query("e1_metadata_audit", sql(Q.STANDARD, f"""
SELECT count(*) AS metadata_rows, count(DISTINCT sample_id) AS unique_sample_ids,
  count(*) - count(DISTINCT sample_id) AS duplicate_id_rows,
  count(*) FILTER (is_malware) AS malware_rows, count(*) FILTER (NOT is_malware) AS benign_rows,
  count(*) FILTER (NOT is_valid_sha256) AS nonstandard_ids_all,
  count(*) FILTER (NOT is_valid_sha256 AND is_malware) AS nonstandard_ids_malware,
  count(*) FILTER (NOT is_valid_sha256 AND NOT is_malware) AS nonstandard_ids_benign,
  count(*) FILTER (ts IS NULL) AS invalid_timestamps_all,
  count(*) FILTER (ts IS NULL AND is_malware) AS invalid_timestamps_malware,
  count(*) FILTER (ts IS NULL AND NOT is_malware) AS invalid_timestamps_benign,
  {Q.ISO_UTC.format(ts="min(ts)")} AS earliest_timestamp,
  {Q.ISO_UTC.format(ts="max(ts)")} AS latest_timestamp,
  {Q.ISO_UTC.format(ts="min(ts) FILTER (is_malware)")} AS earliest_malware_timestamp,
  {Q.ISO_UTC.format(ts="max(ts) FILTER (is_malware)")} AS latest_malware_timestamp
FROM standard"""))
def _(t: Tables):
    return C.metadata_audit(C.standardize(t.raw_metadata, RANGES))


@query("e2_monthly_counts", sql(Q.STANDARD, """
SELECT month, count(*) AS n FROM standard WHERE is_malware GROUP BY month"""))
def _(t: Tables):
    return C.counts_by(C.standardize(t.raw_metadata, RANGES).where("is_malware"), "month")


@query("e2_split_counts", sql(Q.STANDARD, """
SELECT split, is_malware, count(*) AS n FROM standard GROUP BY ALL"""))
def _(t: Tables):
    return C.counts_by(C.standardize(t.raw_metadata, RANGES), "split", "is_malware")


@query("e3_family_support", sql(Q.SUPPORT, "SELECT * FROM support"))
def _(t: Tables):
    return t.support


@query("e4_family_support_all", sql(Q.SAMPLES, """
SELECT family, count(DISTINCT sha) AS support FROM samples GROUP BY family"""))
def _(t: Tables):
    return C.distinct_files(t.samples, "family", name="support")


@query("e5_coverage_summary", sql(Q.SUPPORT, """
SELECT count(*) AS training_families, count(*) FILTER (eligible) AS eligible_families,
  count(*) FILTER (NOT eligible) AS excluded_families,
  CAST(sum(n_files) AS BIGINT) AS training_files,
  CAST(coalesce(sum(n_files) FILTER (eligible), 0) AS BIGINT) AS eligible_files,
  CAST(coalesce(sum(n_files) FILTER (NOT eligible), 0) AS BIGINT) AS excluded_files,
  round(100.0 * coalesce(sum(n_files) FILTER (eligible), 0) / sum(n_files), 4) AS coverage_percent
FROM support"""))
def _(t: Tables):
    return C.coverage_summary(t.support)


@query("e6_support_histogram", sql(Q.SUPPORT, """
SELECT n_months, count(*) AS n_families FROM support WHERE eligible GROUP BY n_months"""))
def _(t: Tables):
    return C.support_histogram(t.support)


PIVOT = ("NATION_2", "NATION_3", "NATION_11", "NATION_17")


def _pivot_sql(period: str) -> str:
    columns = ", ".join(f"count(DISTINCT sha) FILTER (family = '{f}') AS \"{f}\"" for f in PIVOT)
    return f"""SELECT {period}, {columns}, count(DISTINCT sha) AS "TOTAL"
FROM (SELECT *, CAST(year(ts) AS INTEGER) AS year FROM samples) WHERE family IN {PIVOT}
GROUP BY {period}"""


@query("e7_pivot_counts_month", sql(Q.SAMPLES, _pivot_sql("month")))
def _(t: Tables):
    return C.pivot_counts(t.samples, "month", PIVOT)


@query("e7_pivot_counts_year", sql(Q.SAMPLES, _pivot_sql("year")))
def _(t: Tables):
    return C.pivot_counts(t.samples.withColumn("year", F.year("ts")), "year", PIVOT)


@query("e8_grouping_total", sql(Q.SAMPLES, """
SELECT coalesce(family, 'TOTAL') AS family, coalesce(split, 'TOTAL') AS split,
  count(DISTINCT sha) AS n_files FROM samples GROUP BY ROLLUP (family, split)"""))
def _(t: Tables):
    return C.grouping_totals(t.samples, "family", "split")


@query("e9_peak_period", sql(Q.SAMPLES, """
SELECT family, month AS peak_month, n AS peak_files FROM (
  SELECT family, month, n, row_number() OVER (PARTITION BY family ORDER BY n DESC, month) AS r
  FROM (SELECT family, month, count(DISTINCT sha) AS n FROM samples GROUP BY ALL)) WHERE r = 1"""))
def _(t: Tables):
    return C.peak_period(t.samples)


@query("e10_archive_inventory", sql(Q.BLOBS, """
SELECT count(*) AS members, CAST(sum(size) AS BIGINT) AS uncompressed_bytes,
  count(*) - count(DISTINCT member) AS duplicate_paths, count(*) AS sha_like_names,
  0 AS other_names FROM blobs"""))
def _(t: Tables):
    return C.archive_inventory(t.archive_index).withColumn(
        "other_names", F.col("other_names").cast("int"))


@query("e11_status_counts", sql(Q.SAMPLES, """
SELECT family, split, count(*) FILTER (o_orderstatus = 'F') AS "CREATED",
  count(*) FILTER (o_orderstatus = 'O') AS "VERIFIED",
  count(*) FILTER (o_orderstatus = 'P') AS "ERROR" FROM samples GROUP BY family, split"""))
def _(t: Tables):
    status = F.when(F.col("o_orderstatus") == "F", "CREATED").when(
        F.col("o_orderstatus") == "O", "VERIFIED").otherwise("ERROR")
    return C.status_counts(t.samples.withColumn("status", status), ["family", "split"],
                           ["CREATED", "VERIFIED", "ERROR"])


def _folds(t: Tables, k: int = 10, seed: int = 42):
    return D.stratified_folds(t.pool, k, seed)


FOLDS = Q.LABEL_MAP + """, pool AS (
  SELECT sha, family, class_id FROM samples JOIN label_map USING (family)),
sizes AS (SELECT class_id, min(sha) AS first_sha, count(*) AS size FROM pool GROUP BY class_id),
offsets AS (SELECT class_id, coalesce(sum(size) OVER (
    ORDER BY first_sha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM sizes),
seeds AS (SELECT CAST(unnest(range(42, 52)) AS INTEGER) AS seed),
folds AS (
  SELECT seed, sha, family, class_id, CAST((off + row_number() OVER (PARTITION BY seed, class_id
    ORDER BY sha256(CAST(seed AS VARCHAR) || ':' || sha), sha) - 1) % 10 AS INTEGER) AS test_fold
  FROM pool JOIN offsets USING (class_id), seeds)"""


@query("e23_fold_crosstab", sql(FOLDS, """
SELECT test_fold, """ + ", ".join(
    f"count(*) FILTER (class_id = {c}) AS \"{c}\"" for c in range(25)) + """
FROM folds WHERE seed = 42 GROUP BY test_fold"""))
def _(t: Tables):
    return D.fold_crosstab(_folds(t), 10, list(range(25)))


CONTENTS = Q.BLOBS + """, placed AS (
  SELECT content_sha256, sha, split, month, row_number() OVER (PARTITION BY content_sha256
    ORDER BY list_position(['train', 'validation', 'test', 'outside_protocol'], split), month, sha) AS r
  FROM blobs)"""
BLOB_ORDER = (*S.SPLIT_ORDER, "outside_protocol")


def _contents(t: Tables):
    """Hashed once: everything after reads the narrow table, not the contents."""
    return staged(t.blobs.select(F.sha2("content", 256).alias("content_sha256"), "sha", "split",
                                 "month"), "contents")


@query("e24_cross_split_duplicates", sql(CONTENTS, """
SELECT p.content_sha256, o.sha AS owner_sha, p.sha, o.split AS owner_split, p.split
FROM placed p JOIN placed o ON p.content_sha256 = o.content_sha256 AND o.r = 1
WHERE p.split <> o.split AND p.sha <> o.sha"""))
def _(t: Tables):
    return C.cross_split_duplicates(_contents(t), BLOB_ORDER)


RECORDS = Q.SAMPLES + """, records AS (
  SELECT sha, sha256('{"family":"' || family || '","month":"' || month || '","sha":"' || sha
    || '","split":"' || split || '"}') AS h FROM samples)"""


def _word_sums(kind: str = "HUGEINT") -> str:
    return ", ".join(f"sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS {kind})) AS w{i}"
                     for i in range(8))


def _word_texts() -> str:
    return ", ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS HUGEINT)) AS VARCHAR) AS w{i}"
                     for i in range(8))


@query("e25_dataset_hash", sql(RECORDS + f""", folded AS (
  SELECT substr(sha256(h), 1, 3) AS bucket, count(*) AS n, {_word_sums()} FROM records GROUP BY 1)""", """
SELECT CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(line, chr(10) ORDER BY line)) AS dataset_hash
FROM (SELECT n, concat_ws(',', bucket, n, w0, w1, w2, w3, w4, w5, w6, w7) AS line FROM folded)"""))
def _(t: Tables):
    return C.dataset_hash(t.samples, ["sha", "family", "month", "split"])


@query("e25_prefix_tree", sql(RECORDS, " UNION ALL ".join(f"""
SELECT {k} AS level, substr(sha, 1, {k}) AS prefix, count(*) AS n, {_word_texts()}
FROM records GROUP BY substr(sha, 1, {k})""" for k in range(4))))
def _(t: Tables):
    tree = C.prefix_tree(t.samples, ["sha", "family", "month", "split"])
    return tree.select("level", "prefix", "n", *(F.col(f"w{i}").cast("string").alias(f"w{i}")
                                                 for i in range(8)))


@query("e25_changed_rows", sql(Q.SAMPLES, """
SELECT sha, CASE WHEN o_orderkey % 1999 = 0 THEN 'removed' WHEN o_orderkey % 1999 = 1 THEN 'changed'
  END AS change FROM samples WHERE o_orderkey % 1999 < 2"""))
def _(t: Tables):
    """Two manifests that differ in few rows, compared from their trees."""
    columns = ["sha", "family", "month", "split"]
    key = F.col("o_orderkey") % 1999
    other = t.samples.where(key != 0).withColumn("month", F.when(
        key == 1, F.lit("1990-01")).otherwise(F.col("month")))
    trees = [staged(C.prefix_tree(x, columns), "tree") for x in (t.samples, other)]
    return C.changed_rows(t.samples, other, C.differing_prefixes(*trees), columns)


@query("e25_fold_sizes", sql(FOLDS, """
SELECT test_fold, count(*) AS n FROM folds WHERE seed = 42 GROUP BY test_fold"""))
def _(t: Tables):
    return C.fold_sizes(_folds(t))


# -- windows, order, sets ---------------------------------------------------------------

@query("f1_class_ids_by_name", sql(Q.LABEL_MAP, "SELECT * FROM label_map"))
def _(t: Tables):
    return C.eligible_label_map(t.support).select("family", "class_id", "n_files", "n_months")


@query("f2_stratified_folds", sql(FOLDS, """
SELECT sha, family, class_id, test_fold FROM folds WHERE seed = 42"""))
def _(t: Tables):
    return _folds(t).select("sha", "family", "class_id", "test_fold")


@query("f3_repeated_folds", sql(FOLDS, """
SELECT seed, test_fold, class_id, count(*) AS n, min(sha) AS first_sha FROM folds GROUP BY ALL"""))
def _(t: Tables):
    return D.repeated_folds(t.pool).groupBy("seed", "test_fold", "class_id").agg(
        F.count("*").alias("n"), F.min("sha").alias("first_sha"))


@query("f7_running_first_owner", sql(CONTENTS, """
SELECT content_sha256, max(CASE WHEN r = 1 THEN sha END) AS owner_sha, count(*) AS holders
FROM placed GROUP BY content_sha256"""))
def _(t: Tables):
    return C.first_owner(_contents(t), BLOB_ORDER)


@query("g1_rank_support", sql(Q.SUPPORT, """
(SELECT family, n_files, n_months, eligible, 'lowest_eligible' AS kind FROM support
  WHERE eligible ORDER BY n_files, n_months, family LIMIT 15)
UNION ALL
(SELECT family, n_files, n_months, eligible, 'highest_excluded' AS kind FROM support
  WHERE NOT eligible ORDER BY n_files DESC, n_months DESC, family LIMIT 15)"""))
def _(t: Tables):
    return C.borderline_families(t.support)


@query("g2_rank_months", sql(Q.SAMPLES, """
SELECT month, count(DISTINCT sha) AS n_files FROM samples GROUP BY month
ORDER BY n_files DESC, month LIMIT 12"""))
def _(t: Tables):
    return C.rank_periods(t.samples, top=12)


@query("g3_canonical_order", sql(Q.SAMPLES, """
SELECT sha, split, month FROM samples
ORDER BY list_position(['train', 'validation', 'test'], split), month, sha"""))
def _(t: Tables):
    return T.canonical_order(t.samples).select("sha", "split", "month")


@query("h1_id_difference", sql(Q.SAMPLES, """
SELECT sha, 'only_in_first' AS kind FROM samples
WHERE o_orderstatus <> 'P' AND NOT o_orderpriority <> '5-LOW'
UNION ALL SELECT sha, 'in_both' FROM samples
WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'"""))
def _(t: Tables):
    sets = _id_sets(t)
    left, right = sets["metadata"], sets["archive"]
    return J.id_difference(left, right).withColumn("kind", F.lit("only_in_first")).unionByName(
        J.id_intersection(left, right).withColumn("kind", F.lit("in_both")))


@query("h3_set_equal", sql(Q.SAMPLES, """
SELECT sha, CASE WHEN o_orderstatus <> 'P' THEN 'missing' ELSE 'unexpected' END AS problem
FROM samples WHERE (o_orderstatus <> 'P') <> (o_orderpriority <> '5-LOW')"""))
def _(t: Tables):
    sets = _id_sets(t)
    return J.set_equal(sets["metadata"], sets["archive"], ["sha"])


# -- validation -------------------------------------------------------------------------

@query("v1_check_ids", """
SELECT subject, CASE WHEN subject IS NULL THEN 'id_null' WHEN subject = '' THEN 'id_blank'
  ELSE 'id_repeated' END AS rule FROM (
  SELECT nullif(lower(trim(url)), '') AS subject, count(*) AS n FROM (
    SELECT regexp_replace(url, '[0-9?#].*$', '') AS url FROM pages) GROUP BY 1)
WHERE subject IS NULL OR n > 1""")
def _(t: Tables):
    ids = t.read("pages").select(F.upper(F.regexp_replace("url", "[0-9?#].*$", "")).alias("sha"))
    return V.check_ids(ids)


@query("v2_check_bijection", sql(Q.SAMPLES, """
SELECT family AS subject, 'family_has_several_class_id' AS rule FROM samples
GROUP BY family HAVING count(DISTINCT year(ts)) > 1
UNION ALL SELECT CAST(year(ts) AS VARCHAR), 'class_id_has_several_family' FROM samples
GROUP BY year(ts) HAVING count(DISTINCT family) > 1"""))
def _(t: Tables):
    return V.check_bijection(t.samples.select("family", F.year("ts").alias("class_id")))


@query("v2_check_label_map", """
WITH shown AS (SELECT CASE WHEN n_nationkey % 7 = 0 THEN 'Same' ELSE n_name END AS family,
  CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey // 2 END AS class_id FROM nation)
SELECT lower(family) AS subject, 'family_repeated' AS rule FROM shown GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT CAST(class_id AS VARCHAR), 'class_id_repeated' FROM shown
WHERE class_id IS NOT NULL GROUP BY class_id HAVING count(*) > 1
UNION ALL SELECT lower(family), 'class_id_not_integer' FROM shown WHERE class_id IS NULL
UNION ALL SELECT 'map', 'class_ids_not_contiguous' FROM shown
HAVING min(class_id) <> 0 OR max(class_id) + 1 <> count(DISTINCT class_id)
UNION ALL SELECT 'map', 'wrong_number_of_classes' FROM shown HAVING count(*) <> 24""")
def _(t: Tables):
    """A map with repeated families and ids, ids that are no numbers, gaps, and a row too many."""
    key = F.col("n_nationkey")
    shown = t.read("nation").select(
        F.when(key % 7 == 0, F.lit("Same")).otherwise(F.col("n_name")).alias("family"),
        F.when(key % 5 == 0, F.lit("x")).otherwise(F.floor(key / 2).cast("string"))
        .alias("class_id"))
    return V.check_label_map(shown, 24)


@query("v3_check_manifest", sql(Q.MANIFEST, """
SELECT sha AS subject, unnest(list_filter([
  CASE WHEN o_totalprice > 490000 THEN 'class_map' END,
  CASE WHEN o_totalprice < 5000 THEN 'unknown_split' END,
  CASE WHEN o_totalprice >= 5000 AND o_totalprice < 10000 AND split <> 'test' THEN 'date_outside_split' END,
  CASE WHEN o_totalprice > 480000 AND o_totalprice < 485000 THEN 'month_mismatch' END,
  CASE WHEN o_totalprice >= 10000 AND o_totalprice < 15000 THEN 'file_size' END,
  CASE WHEN o_totalprice >= 15000 AND o_totalprice < 20000 THEN 'zip_crc32' END],
  lambda x: x IS NOT NULL)) AS rule FROM manifest"""))
def _(t: Tables):
    price = F.col("o_totalprice")
    dirty = t.manifest.select(
        "sha", F.lower("family").alias("family"),
        F.when(price > 490000, F.col("class_id") + 1).otherwise(F.col("class_id"))
        .cast("string").alias("class_id"),
        F.when(price < 5000, "holdout").when(price < 10000, "future_test")
        .otherwise(F.col("split")).alias("split"),
        F.when((price > 480000) & (price < 485000), "1990-01").otherwise(F.col("month"))
        .alias("month"), "timestamp",
        F.when((price >= 10000) & (price < 15000), "0").otherwise("12").alias("file_size"),
        F.when((price >= 15000) & (price < 20000), "xyz").otherwise("00ff00FF")
        .alias("zip_crc32"))
    label_map = t.label_map.withColumn("family", F.lower("family"))
    return V.check_manifest(dirty, label_map, RANGES)


@query("v4_check_folds", sql(FOLDS + """, cells AS (
  SELECT test_fold + CASE WHEN class_id = 2 AND test_fold = 9 THEN 1 ELSE 0 END AS test_fold,
    class_id, count(*) AS n FROM folds WHERE seed = 42 GROUP BY ALL)""", """
SELECT CAST(test_fold AS VARCHAR) AS subject, 'fold_outside_range' AS rule FROM cells WHERE test_fold > 9
UNION ALL SELECT CAST(class_id AS VARCHAR), 'class_not_balanced' FROM cells GROUP BY class_id
HAVING max(n) - min(n) > 1"""))
def _(t: Tables):
    moved = F.when((F.col("class_id") == 2) & (F.col("test_fold") == 9), F.col("test_fold") + 1) \
        .otherwise(F.col("test_fold"))
    return D.check_folds(_folds(t).withColumn("test_fold", moved), 10)


@query("v4_fold_partition", sql(FOLDS, """
SELECT test_fold, count(*) AS test_samples,
  (SELECT count(*) FROM pool) - count(*) AS train_samples
FROM folds WHERE seed = 42 GROUP BY test_fold"""))
def _(t: Tables):
    return D.fold_partition_audit(_folds(t), 10)


@query("v5_check_paths", sql(Q.SAMPLES, """
SELECT sha AS subject, 'path_empty_or_unsafe' AS rule FROM samples WHERE o_orderpriority = '5-LOW'
UNION ALL SELECT 'images/' || family || '/' || CAST(floor(o_totalprice) AS BIGINT) || '.png', 'path_shared'
FROM samples WHERE o_orderpriority <> '5-LOW' GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT sha, 'file_missing' FROM samples
WHERE o_orderpriority <> '5-LOW' AND o_orderstatus = 'P' AND
  'images/' || family || '/' || CAST(floor(o_totalprice) AS BIGINT) || '.png' NOT IN (
    SELECT 'images/' || family || '/' || CAST(floor(o_totalprice) AS BIGINT) || '.png' FROM samples
    WHERE o_orderstatus <> 'P')"""))
def _(t: Tables):
    name = F.concat(F.floor("o_totalprice").cast("string"), F.lit(".png"))
    safe = F.concat_ws("/", "family", name)
    rows = t.samples.withColumn("image_path", F.when(
        F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("../"), safe)).otherwise(safe))
    files = t.samples.where(F.col("o_orderstatus") != "P").select(
        F.concat(F.lit("images/"), safe).alias("path"))
    return V.check_paths(rows, "images", files)


@query("v9_check_same_config", """
SELECT 'all' AS subject, 'configs_differ' AS rule
UNION ALL SELECT o_orderpriority, 'config_id_mismatch' FROM orders
WHERE o_orderpriority <> '1-URGENT' GROUP BY o_orderpriority""")
def _(t: Tables):
    configs = t.read("orders").select(
        F.col("o_orderpriority").alias("worker"),
        F.substring("o_orderpriority", 1, 1).alias("config_id")).distinct()
    return V.check_same_config(configs, {"config_id": "1"})


@query("k4_run_identity", """
SELECT o_orderpriority AS name, CAST(o_orderstatus AS VARCHAR) AS run_id FROM orders
WHERE o_orderstatus <> 'F' GROUP BY ALL""")
def _(t: Tables):
    todo = t.read("orders").select(F.col("o_orderpriority").alias("name"),
                                   F.col("o_orderstatus").alias("run_id")).distinct()
    done = todo.withColumn("completed", F.col("run_id") == "F")
    return P.completed_runs(todo, done)
