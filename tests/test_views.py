"""Spark view plans agree with the kernels, whole or in blocks."""

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoview.functions import arrow as A
from chronoview.functions import kernels as K
from chronoview.operators import blocks as B
from chronoview.operators import byteviews as N
from chronoview.operators import dataset as G
from chronoview.operators import models as M
from chronoview.operators import validate as V
from chronoview.session import configure

SIZES = [1, 2, 3, 64, 127, 128, 129, 255, 257, 767, 768, 769, 1536, 1537, 1700, 5000]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    data = [(f"s{n}", rng.integers(0, 256, n, dtype=np.uint8).tobytes()) for n in SIZES]
    return spark.createDataFrame(data, "sha string, content binary").cache()


def dense(frame, value="value"):
    grids = {}
    for row in frame.collect():
        grids.setdefault(row.sha, np.zeros((64, 64)))[row.r, row.c] = row[value]
    return {sha: grid.ravel() for sha, grid in grids.items()}


def expected(blobs, kernel):
    return {r.sha: kernel(np.frombuffer(r.content, np.uint8)) for r in blobs.collect()}


@pytest.mark.parametrize("native, kernel", [
    (N.raw_byte_cells_view, K.raw_byte_view), (N.entropy_cells_view, K.entropy_view),
    (lambda b: N.raw_byte_cells_view(b, fractional=False), K.raw_byte_view_binned),
    (lambda b: N.entropy_cells_view(b, fractional=False), K.entropy_view_binned)])
def test_native_views(blobs, native, kernel):
    got, want = dense(native(blobs)), expected(blobs, kernel)
    assert got.keys() == want.keys()
    assert all(np.abs(got[s] - want[s]).max() < 1e-6 for s in want)


@pytest.mark.parametrize("bits", [1, 3, 5, 6, 8])
def test_native_states(blobs, bits):
    states = {r.sha: r.s for r in blobs.select(
        "sha", N.state_array(F.col("content"), bits).alias("s")).collect()}
    want = expected(blobs, lambda v: K.lbit_states(v, bits))
    assert all(states[s] == want[s].tolist() for s in want)


def test_native_transition_view(blobs):
    cells = N.sbsmi_cells_view(blobs).withColumnsRenamed({"prev": "r", "cur": "c"})
    got, want = dense(cells, "pixel"), expected(blobs, K.sbsmi_view)
    assert all((got.get(s, np.zeros(4096)) == want[s]).all() for s in want)


@pytest.mark.parametrize("block", [768, 1536, 7680])
def test_block_views(blobs, block):
    views = {(r.sha, r.modality): np.array(r.pixels) for r in B.block_views(blobs, block).collect()}
    for name, kernel in A.VIEW_KERNELS.items():
        for sha, want in expected(blobs, kernel).items():
            got = views.get((sha, name), np.zeros(4096))
            assert np.abs(got - want).max() < 1e-6, (sha, name)


def test_block_size_must_hold_whole_units(blobs):
    with pytest.raises(ValueError):
        B.split_blocks(blobs, 1000)


def test_blocks_of_two_members_of_one_sha_do_not_mix(spark):
    """Keyed by member, two contents of one sha give two right views."""
    rng = np.random.default_rng(5)
    data = [("s", m, rng.integers(0, 256, n, dtype=np.uint8).tobytes())
            for m, n in (("one", 5000), ("two", 3000))]
    frame = spark.createDataFrame(data, "sha string, member string, content binary")
    views = B.block_views(frame, 768, ("sha", "member")).collect()
    assert len(views) == 6
    for _, member, content in data:
        for r in views:
            if r.member == member:
                want = A.VIEW_KERNELS[r.modality](K.as_bytes(content))
                assert np.abs(np.array(r.pixels) - want).max() < 1e-6


def test_blocks_take_one_scan_and_no_shuffle(spark, blobs, tmp_path):
    blobs.write.parquet(str(tmp_path / "blobs"))
    stored = spark.read.parquet(str(tmp_path / "blobs"))
    plan = B.block_parts(B.split_blocks(stored, 768), 768)._jdf.queryExecution() \
        .executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_views_of_one_side_only_fail(blobs):
    whole = G.view_rows(blobs, ("sbsmi",)).drop("error")
    sha = whole.first().sha
    verdict = {r.sha: r.status for r in V.compare_views(
        whole, whole.where(F.col("sha") != sha)).collect()}
    assert verdict[sha] == "FAIL" and set(verdict.values()) == {"PASS", "FAIL"}


def test_null_and_empty_contents(spark):
    frame = spark.createDataFrame([("a", None), ("b", b""), ("c", b"x")],
                                  "sha string, content binary")
    rows = {(r.sha, r.modality): r for r in G.view_rows(frame).collect()}
    assert len(rows) == 9
    assert all(rows[s, m].error and rows[s, m].pixels is None
               for s in "ab" for m in G.MODALITIES)
    assert all(rows["c", m].error is None for m in G.MODALITIES)


def test_sql_functions(spark, blobs):
    A.register_functions(spark)
    blobs.createOrReplaceTempView("test_blobs")
    row = spark.sql("SELECT size(sbsmi_view(content)) a, size(raw_byte_view(content)) b, "
                    "size(entropy_view(content)) c, byte_entropy(content) h "
                    "FROM test_blobs WHERE sha = 's5000'").first()
    assert (row.a, row.b, row.c) == (4096, 4096, 4096) and 7.9 < row.h <= 8
    states = spark.sql("SELECT t.* FROM test_blobs, LATERAL state_rows(content) t "
                       "WHERE sha = 's3' ORDER BY pos").collect()
    want = expected(blobs, K.lbit_states)["s3"].tolist()
    assert [r.state for r in states] == want


def test_pixel_digest_sees_every_pixel(spark):
    frame = spark.createDataFrame([("a", [0.0] * 4096), ("b", [0.0] * 4095 + [1.0]), ("c", None)],
                                  "sha string, pixels array<float>")
    digests = {r.sha: r.d for r in frame.select(
        "sha", G.pixels_sha256("pixels").alias("d")).collect()}
    from hashlib import sha256
    assert digests["a"] == sha256(np.zeros(4096, "<f4").tobytes()).hexdigest()
    assert digests["b"] != digests["a"] and digests["c"] is None


def test_block_parts_are_no_larger_than_their_blocks(blobs):
    """One row per block and view; a short block does not send sums of all 4,096 cells."""
    parts = B.block_parts(B.split_blocks(blobs, 1536), 1536).collect()
    blocks = sum(-(-n // 1536) for n in SIZES)
    assert len(parts) == 3 * blocks
    for name in ("raw_byte", "entropy"):
        packed = sum(len(p.sums) for p in parts if p.modality == name)
        assert packed <= sum(SIZES) + 128 * blocks


@pytest.mark.parametrize("fractional", [True, False])
def test_long_blocks_send_cells(spark, fractional):
    """Beyond ``OWN_ROWS`` rows sums of output cells are sent; both forms add up."""
    rng = np.random.default_rng(6)
    size = 3 * 768 * 100 + 700
    frame = spark.createDataFrame(
        [("s", rng.integers(0, 256, size, dtype=np.uint8).tobytes())], "sha string, content binary")
    for name, whole in (("raw_byte", K.raw_byte_view if fractional else K.raw_byte_view_binned),
                        ("entropy", K.entropy_view if fractional else K.entropy_view_binned)):
        parts = B.block_parts(B.split_blocks(frame, 768 * 100), 768 * 100, ("sha",), (name,),
                              fractional)
        cells = B.merge_parts(parts, fractional=fractional).collect()
        got = np.zeros(4096)
        for r in cells:
            got[r.cell] = r.value
        want = expected(frame, whole)["s"]
        assert parts.count() == 4 and np.abs(got - want).max() < 1e-6


def test_equal_contents_of_one_key_give_one_view(spark):
    frame = spark.createDataFrame([("s", bytes(range(256)) * 5)] * 3, "sha string, content binary")
    for native, kernel in ((N.raw_byte_cells_view, K.raw_byte_view),
                           (N.entropy_cells_view, K.entropy_view)):
        rows = native(frame)
        assert rows.count() == 4096
        assert np.abs(dense(rows)["s"] - kernel(K.as_bytes(bytes(range(256)) * 5))).max() < 1e-9


@pytest.mark.parametrize("modalities", [("sbsmi",), G.MODALITIES])
def test_few_views_wait_in_python(modalities):
    """However many blobs a batch has, at most ``VIEWS_AT_ONCE`` views leave together."""
    contents = [None, b"", *(bytes([n % 256]) * 300 for n in range(500))]
    batch = pa.RecordBatch.from_arrays([pa.array(contents, pa.binary())], names=["content"])
    made = list(A.view_rows(modalities, ())(iter([batch])))
    assert max(b.num_rows for b in made) <= A.VIEWS_AT_ONCE
    assert sum(b.num_rows for b in made) == 502 * len(modalities)
    nulls = [p for b in made for p, m in zip(b.column("pixels").to_pylist(),
                                             b.column("modality").to_pylist())
             if m == "sbsmi"]
    assert nulls[:2] == [None, None] and all(len(p) == 4096 for p in nulls[2:])


def test_batches_to_python_stay_small(spark):
    """Neither contents nor views come by more than 8 MB and a row; each comes once."""
    configure(spark)
    bound = 9 << 20
    frame = spark.range(0, 1200, 1, 1)
    views = frame.select("id", F.array_repeat(F.col("id").cast("float"), 4096).alias("pixels"))
    contents = frame.where("id < 24").select(
        "id", F.encode(F.repeat(F.lit("x"), 1 << 20), "UTF-8").alias("content"))

    @F.arrow_udf("long")
    def batch_bytes(column: pa.Array) -> pa.Array:
        return pa.array([column.nbytes] * len(column), pa.int64())

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])
    assert max(r[0] for r in contents.mapInArrow(sizes, "n long").collect()) <= bound
    rows = views.select("id", batch_bytes("pixels").alias("n"),
                        G.pixels_sha256("pixels").alias("digest")).collect()
    assert max(r.n for r in rows) <= bound
    assert {r.id: r.digest for r in rows} == {
        n: sha256(np.full(4096, n, np.float32).tobytes()).hexdigest() for n in range(1200)}


def test_exploded_views_are_made_once(spark):
    """No filter inferred from the explode makes a view a second time; missing ones give no cells."""
    frame = spark.createDataFrame([("a", b"some bytes" * 40), ("n", None)],
                                  "sha string, content binary")
    cells = N.explode_pixels(frame.select("sha", A.sbsmi_view("content").alias("pixels")))
    assert cells._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    rows = cells.orderBy("r", "c").collect()
    assert {r.sha for r in rows} == {"a"}
    assert [r.value for r in rows] == K.sbsmi_view(K.as_bytes(b"some bytes" * 40)).tolist()


def test_lists_of_many_rows():
    rows = [None if n % 7 == 0 else np.arange(n % 5, dtype=np.float64) for n in range(300)]
    got = A._lists(iter(rows), pa.float32()).to_pylist()
    assert got == [None if r is None else r.tolist() for r in rows]
    assert A._lists([], pa.int16()).to_pylist() == []


def test_scores_are_taken_in_slices(spark):
    seen = spark.createDataFrame(
        [("2020-02", f"s{n:03d}", 1, [float(n)] * 4) for n in range(600)],
        "month string, sha string, class_id int, pixels array<float>").coalesce(1)

    def size_and_first(pixels):
        return np.stack([np.full(len(pixels), len(pixels)), pixels[:, 0]], axis=1), pixels[:, :1]
    rows = M.score_with(seen, size_and_first, "raw_byte", 11).collect()
    assert sorted(r.logits[1] for r in rows) == list(range(600))
    assert max(r.logits[0] for r in rows) <= M.SCORED_AT_ONCE


def test_digests_come_with_the_views(spark, blobs):
    """A view's digest is taken in the pass that makes it and is that of its pixels."""
    made = G.view_rows(blobs.union(spark.createDataFrame([("n", None)], blobs.schema)),
                       digests=True)
    rows = made.withColumn("again", G.pixels_sha256("pixels")).collect()
    assert all(r.output_sha256 == r.again for r in rows)
    assert [r.output_sha256 for r in rows if r.sha == "n"] == [None] * 3
    manifest = blobs.select("sha", *(F.lit(None).cast(k).alias(c) for c, k in zip(
        G.IDENTITY, ("string", "int", "string", "string", "string"))))
    plan = G.generate_views(manifest, blobs.withColumn("member", F.col("sha")), "c")
    assert "ArrowEvalPython" not in plan._jdf.queryExecution().executedPlan().toString()


def test_implementations_are_compared_by_digests_first(spark, blobs):
    """The same rows as by pixels, though only views of other digests are made a second time."""
    extra = spark.createDataFrame([("n", None), ("e", b""), ("s5000", b"another")], blobs.schema)
    frame, asked = blobs.union(extra), []

    def whole(source, kinds):
        return G.view_rows(source, kinds).drop("error")

    def other(source, kinds):
        asked.append((source, kinds))
        pixels = F.when(F.col("sha").isin("s64", "s129") & (F.col("modality") == "sbsmi"),
                        F.transform("pixels", lambda p, i: F.when(
                            i < 3, p + F.lit(2).cast("float")).otherwise(p)))
        pixels = pixels.when((F.col("sha") == "s3") & (F.col("modality") == "entropy"), F.transform(
            "pixels", lambda p, i: F.when(i == 5, F.lit(float("nan")).cast("float")).otherwise(p)))
        views = B.block_views(source, 1536, modalities=kinds).where(F.col("sha") != "s5000")
        again = whole(source, kinds).where(F.col("sha") == "s5000")
        return views.unionByName(again).withColumn(
            "pixels", F.coalesce(pixels, F.col("pixels")))

    columns = ["sha", "modality", "differing_pixels", "max_abs_difference", "differing_float32",
               "status"]
    got = G.compare_implementations(frame, whole, other).select(*columns)
    second = {kinds: {r.sha for r in source.select("sha").collect()} for source, kinds in asked[1:]}
    want = V.compare_views(whole(frame, G.MODALITIES), other(frame, G.MODALITIES)).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert second == {("sbsmi",): {"n", "e", "s5000", "s64", "s129"},
                      ("raw_byte",): {"n", "e", "s5000"},
                      ("entropy",): {"n", "e", "s5000", "s3"}}
