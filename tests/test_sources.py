"""Text, binary, image and prediction sources and their sinks."""

import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from chronoview.errors import ContractViolation
from chronoview.functions import scalars as S
from chronoview.operators import provenance as P
from chronoview.operators import validate as K
from chronoview.sources import binaries as B
from chronoview.sources import sinks as W
from chronoview.sources import tables as T

SHA = ["a" * 64, "b" * 64, "c" * 64, "d" * 64]


def write(path, text):
    path.write_bytes(text.encode("utf-8"))
    return str(path)


def test_bom_header_and_quotes(spark, tmp_path):
    path = write(tmp_path / "m.csv", "﻿sha,family,timestamp\n01,\"a,b\",2020\n02,,2021\n")
    rows = T.scan_metadata(spark, path).orderBy("sha").collect()
    assert [(r.sha, r.family, r.timestamp) for r in rows] == [
        ("01", "a,b", "2020"), ("02", None, "2021")]


@pytest.mark.parametrize("text", ["", "a,b\n1,2\n"])
def test_bad_csv(spark, tmp_path, text):
    with pytest.raises(ContractViolation):
        T.scan_metadata(spark, write(tmp_path / "bad.csv", text))


def test_alias_resolution(rows):
    frame = rows([("x", "f", 1)], "sample_id string, family string, k int")
    assert T.resolve_columns(frame).columns == ["sha", "family", "k"]
    with pytest.raises(ContractViolation):
        T.resolve_columns(frame.drop("family"))


@pytest.mark.parametrize("body", ["x,0\nX ,1\n", "x,0\ny,2\n", "x,1\ny,2\n", "x,0\ny,0\n",
                                  "x,0\ny,1.5\n", ",0\n"])
def test_bad_label_maps(spark, tmp_path, body):
    with pytest.raises(ContractViolation):
        T.load_label_map(spark, write(tmp_path / "map.csv", "family,class_id\n" + body))


def test_label_map_size_lock(spark, tmp_path):
    path = write(tmp_path / "map.csv", "family,class_id\nB,1\n a ,0\n")
    rows = {r.family: r.class_id for r in T.load_label_map(spark, path, 2).collect()}
    assert rows == {"a": 0, "b": 1}
    with pytest.raises(ContractViolation):
        T.load_label_map(spark, path, 51)


MANIFEST = """sha,family,class_id,split,month,timestamp,file_size,zip_crc32
{0},fam0,0,train,2019-10,2019-10-12T01:02:03Z,,
{1},fam1,1,validation,2020-03,2020-03-02,,
{2},fam0,0,future_test,2020-07,2020-07-02 10:00:00,12,00ff00FF
{3},Fam1 ,1,train,2019-11,2019-11-11,,
""".format(*SHA)


@pytest.fixture
def label_map(rows):
    return rows([("fam0", 0), ("fam1", 1)], "family string, class_id int")


def test_manifest_is_typed_and_ordered(spark, tmp_path, label_map):
    rows = T.load_manifest(spark, write(tmp_path / "m.csv", MANIFEST), label_map).collect()
    assert [(r.sha[0], r.split) for r in rows] == [
        ("a", "train"), ("d", "train"), ("b", "validation"), ("c", "test")]
    assert rows[3].file_size == 12 and rows[3].zip_crc32 == "00ff00ff"


@pytest.mark.parametrize("old, new", [
    ("2019-10,", "2019-09,"), ("fam0,0,train", "fam0,1,train"), ("fam1,1,val", "famX,1,val"),
    ("validation", "holdout"), ("2020-03-02", "2020-13-02"), ("2020-03-02", "yesterday"),
    ("b" * 64, "a" * 64), ("c" * 64, "c" * 63), (",12,", ",0,"), ("00ff00FF", "xx"),
    ("2020-03,2020-03-02", "2020-05,2020-05-02")])
def test_manifest_fails_closed(spark, tmp_path, label_map, old, new):
    with pytest.raises(ContractViolation):
        T.load_manifest(spark, write(tmp_path / "m.csv", MANIFEST.replace(old, new, 1)), label_map)


BLOBS = {SHA[0]: bytes(range(256)) * 4 + b"Z", SHA[1]: b"\x01\x02\x03" * 900, SHA[2]: b"\0" * 257}


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "altered"
    root.mkdir()
    for sha, content in BLOBS.items():
        (root / f"{sha.upper()}.exe").write_bytes(content)
    return str(root)


@pytest.fixture
def archive(tmp_path):
    path = tmp_path / "blobs.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("altered/", "")
        for sha, content in BLOBS.items():
            z.writestr(f"altered/{sha}.exe", content)
    return str(path)


def test_zip_equals_folder(spark, folder, archive):
    files = {r.sha: bytes(r.content) for r in B.scan_binary_folder(spark, folder).collect()}
    zipped = B.scan_zip_members(spark, archive, bytes_per_task=1000)
    assert zipped.rdd.getNumPartitions() > 1
    members = {r.sha: bytes(r.content) for r in zipped.collect()}
    assert files == members == BLOBS


def test_zip_index_only(spark, archive):
    rows = B.scan_zip_members(spark, archive, content=False).collect()
    assert {(r.sha, r.size, r.crc32) for r in rows} == {
        (s, len(c), f"{zlib.crc32(c):08x}") for s, c in BLOBS.items()}
    assert "content" not in rows[0].asDict()


def test_folder_index_prunes_content(spark, folder):
    index = B.scan_binary_folder(spark, folder, content=False)
    assert "content" not in index._jdf.queryExecution().executedPlan().toString()
    assert {r.size for r in index.collect()} == {len(c) for c in BLOBS.values()}


def test_fingerprint(spark, folder):
    prints = S.content_fingerprint(F.col("content"))
    frame = B.scan_binary_folder(spark, folder).select("sha", *(c.alias(n) for n, c in prints.items()))
    from hashlib import sha256
    for r in frame.collect():
        content = BLOBS[r.sha]
        assert (r.content_sha256, r.content_crc32, r.content_size) == (
            sha256(content).hexdigest(), f"{zlib.crc32(content):08x}", len(content))


def png(pixels, width, height):
    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))
    lines = b"".join(b"\0" + pixels[i * width:(i + 1) * width] for i in range(height))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))


def test_gray_png(spark, tmp_path):
    pixels = bytes(i % 256 for i in range(4096))
    (tmp_path / "good.png").write_bytes(png(pixels, 64, 64))
    (tmp_path / "broken.png").write_bytes(b"not an image")
    rows = {r.sha: r for r in T.scan_gray_images(spark, str(tmp_path)).collect()}
    assert [int(p) for p in rows["good"].pixels] == list(pixels)
    assert rows["broken"].pixels is None


def predictions(rows):
    return rows([("entropy", 11, "2020-02", s, i % 2, [0.5, float(i)], [1.0]) for i, s in enumerate(SHA)],
                T.PREDICTION_SCHEMA)


def test_predictions_round_trip(spark, rows, tmp_path):
    path = str(tmp_path / "export")
    W.write_predictions(predictions(rows), path, 2)
    scan = T.scan_predictions(spark, path, 2, views=["entropy"], seeds=[11])
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan and "PartitionFilters" in plan
    assert scan.count() == 4
    with pytest.raises(Exception):
        W.write_predictions(predictions(rows), path, 2)


def test_one_altered_logit_is_found(spark, rows, tmp_path):
    """The recorded sums tell one changed bit, a swapped label, a lost and a foreign row."""
    path = str(tmp_path / "export")
    W.write_predictions(predictions(rows), path, 2)
    recorded = spark.read.parquet(f"{path}_checksums")
    stored = T.scan_predictions(spark, path, 2)
    first = F.col("sha") == SHA[0]

    def rules(changed):
        return sorted(r.rule for r in K.check_export(changed, recorded, 2).collect())
    assert rules(stored.repartition(3)) == []
    nudged = F.transform("logits", lambda z: z + F.lit(2.0 ** -53))
    assert rules(stored.withColumn("logits", F.when(first, nudged).otherwise(F.col("logits")))) \
        == ["checksum"]
    assert rules(stored.withColumn("label", F.when(first, 1 - F.col("label")).otherwise(
        F.col("label")))) == ["checksum"]
    assert rules(stored.where(~first)) == ["checksum", "row_count"]
    assert rules(stored.withColumn("month", F.lit("2020-04"))) == ["export_missing", "not_recorded"]
    broken = stored.withColumn("logits", F.when(first, F.array(F.lit(0.5))).otherwise(
        F.col("logits")))
    assert rules(broken) == ["broken_rows", "checksum"]
    swapped = spark.createDataFrame(
        [("entropy", 11, "2020-02", s, i % 2, [0.5, float(i) + (i == 1)], [1.0])
         for i, s in enumerate(SHA)], T.PREDICTION_SCHEMA)
    swapped.write.mode("overwrite").partitionBy("view", "seed", "month").parquet(path)
    with pytest.raises(ContractViolation, match="checksum"):
        T.scan_predictions(spark, path, 2)


def test_checksums_of_parts_add_up(rows):
    whole = predictions(rows)
    parts = [K.export_checksums(whole.where(c)).first() for c in ("label = 0", "label = 1")]
    both = K.export_checksums(whole).first()
    assert [both[c] for c in K.LIMBS] == [sum(p[c] for p in parts) for c in K.LIMBS]


def test_bad_predictions_are_not_written(rows, tmp_path):
    bad = predictions(rows).withColumn("logits", F.array(F.lit(float("nan")), F.lit(0.0)))
    with pytest.raises(ContractViolation):
        W.write_predictions(bad, str(tmp_path / "export"), 2)
    assert not (tmp_path / "export").exists()


def test_json_refuses_nan(rows, tmp_path):
    with pytest.raises(ContractViolation):
        W.write_json_record(rows([("a", float("nan"))], "k string, v double"), str(tmp_path / "j"))
    assert not (tmp_path / "j").exists()


def test_outputs_are_claimed_by_one_identity(spark, rows, tmp_path):
    table = rows([(1, "x"), (2, "y")], "id int, v string")
    identity = P.run_identity({"k": 10}, {"table": table})
    path = str(tmp_path / "run")
    assert P.claim_output(spark, path, identity)
    assert P.claim_output(spark, path, identity)  # claimed, but not finished
    P.finish_output(spark, path, identity)
    assert not P.claim_output(spark, path, identity)
    other = P.run_identity({"k": 5}, {"table": table})
    with pytest.raises(ContractViolation):
        P.claim_output(spark, path, other)
    (tmp_path / "plain").mkdir()
    with pytest.raises(ContractViolation):
        P.claim_output(spark, str(tmp_path / "plain"), identity)


def test_identity_ignores_row_order(rows):
    a = rows([(1, "x"), (2, "y")], "id int, v string")
    b = rows([(2, "y"), (1, "x")], "id int, v string")
    c = rows([(2, "y"), (1, "z")], "id int, v string")
    ids = [P.run_identity({}, {"t": f})["run_id"] for f in (a, b, c)]
    assert ids[0] == ids[1] != ids[2]
