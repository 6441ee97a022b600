"""Workers to merged, audited datasets; streaming; the driver contract."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from chronoview.errors import ContractViolation
from chronoview.functions import scalars as S
from chronoview.operators import dataset as G
from chronoview.operators import journal
from chronoview.operators import models as K
from chronoview.plans import dataset as P
from chronoview.sources import sinks as W
from chronoview.sources import tables as T
from chronoview.streaming.incremental import (
    incremental_views,
    named_files,
    stored_files,
    views_as_both_arrive,
)

SHA = ["a" * 64, "b" * 64, "d" * 64]
LENGTHS = [1025, 12800, 257]


@pytest.fixture
def manifest(rows):
    return rows([(SHA[0], "fam0", 0, "train", "2019-10", "2019-10-12"),
                 (SHA[1], "fam1", 1, "validation", "2020-03", "2020-03-02"),
                 (SHA[2], "fam1", 1, "train", "2019-11", "2019-11-11")],
                "sha string, family string, class_id int, split string, month string, timestamp string")


@pytest.fixture
def blobs(rows):
    rng = np.random.default_rng(2)
    return rows([(s, f"altered/{s}.exe", rng.integers(0, 256, n, dtype=np.uint8).tobytes())
                 for s, n in zip(SHA, LENGTHS)], "sha string, member string, content binary")


def generated(manifest, blobs, *modalities):
    return G.generate_views(manifest, blobs, "cfg", modalities or G.MODALITIES)


def test_workers_merge_and_audit(spark, manifest, blobs, tmp_path):
    workers = {}
    for name in G.MODALITIES:
        W.write_views(generated(manifest, blobs, name), str(tmp_path / name))
        workers[name] = T.scan_view_images(spark, str(tmp_path / name))
    views = G.union_workers(workers)
    reports = views.drop("pixels")
    assert G.candidate_problems(manifest, reports, G.MODALITIES).isEmpty()
    merged = G.merge_views(manifest, reports).collect()
    assert {r.merge_status for r in merged} == {"merged"} and len(merged) == 3
    audit = G.audit_dataset(manifest, views, reports)
    assert audit["verdict"].first().verdict == "PASS"
    assert sum(r.verified for r in audit["verified"].collect()) == 9
    assert audit["duplicates"].isEmpty()


def test_contents_are_scanned_once_and_never_shuffled(spark, manifest, blobs, tmp_path):
    blobs.write.parquet(str(tmp_path / "blobs"))
    stored = spark.read.parquet(str(tmp_path / "blobs"))
    plan = generated(manifest, stored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("content#") and plan.count("MapInArrow") == 1
    executed = generated(manifest, stored)._jdf.queryExecution().executedPlan().toString()
    below = executed[executed.index("MapInArrow"):]
    scans = [line for line in below.splitlines() if "FileScan" in line and "content" in line]
    assert len(scans) == 1
    shuffles = [line for line in below.splitlines() if "Exchange hashpartitioning" in line]
    assert not any("content" in line for line in shuffles)


def test_every_sample_gets_rows(rows, manifest, blobs):
    """Missing sources are ERROR rows; two members of one sha keep their own bytes."""
    lacking = generated(manifest, blobs.where(f"sha <> '{SHA[1]}'")).collect()
    assert sorted({r.sha for r in lacking if r.status == "ERROR"}) == [SHA[1]]
    assert len(lacking) == 9
    twice = blobs.unionByName(rows([(SHA[0], "other.exe", b"\x07" * 999)],
                                   "sha string, member string, content binary"))
    made = [r for r in generated(manifest, twice, "raw_byte").collect() if r.sha == SHA[0]]
    assert len(made) == 2 and made[0].output_sha256 != made[1].output_sha256


def dataset_rows(manifest):
    return manifest.select("*", F.lit(None).cast("bigint").alias("file_size"),
                           F.lit(None).cast("string").alias("zip_crc32"))


def test_generation_fails_closed(spark, rows, manifest, blobs, tmp_path):
    path, settings = str(tmp_path / "out"), {"name": "v2"}
    selected = dataset_rows(manifest)

    def refused(match, chosen=selected, source=blobs, **more):
        with pytest.raises(ContractViolation, match=match):
            P.generate_dataset(spark, chosen, source, settings, path, **more)
        assert not (tmp_path / "out" / "views").exists()
    refused("source_missing", source=blobs.where(f"sha <> '{SHA[0]}'"))
    refused("source_ambiguous", source=blobs.unionByName(blobs.limit(1)))
    refused("source_size", selected.withColumn("file_size", F.lit(1).cast("bigint")))
    test_rows = selected.withColumn("split", F.lit("test"))
    refused("future_test_without_frozen_config", test_rows)
    mixed = selected.withColumn("split", F.when(F.col("sha") == SHA[0], "test").otherwise("train"))
    refused("future_test_mixed", mixed)
    log = P.generate_dataset(spark, selected, blobs, settings, path)
    assert {r.status for r in log.collect()} == {"CREATED"} and log.count() == 9
    again = P.generate_dataset(spark, selected, blobs, settings, path)
    assert {r.status for r in again.collect()} == {"VERIFIED"}
    with pytest.raises(ContractViolation, match="other inputs or settings"):
        P.generate_dataset(spark, selected, blobs, {"name": "v3"}, path)


def test_declared_crc_is_checked(spark, manifest, blobs, tmp_path):
    wrong = dataset_rows(manifest).withColumn("zip_crc32", F.lit("00000000"))
    with pytest.raises(ContractViolation, match="crc"):
        P.generate_dataset(spark, wrong, blobs, {"name": "v2"}, str(tmp_path / "out"))


def test_merge_plan(manifest, blobs):
    workers = {m: generated(manifest, blobs, m).drop("pixels") for m in G.MODALITIES}
    merged = P.merge_dataset(manifest, workers)
    assert merged.count() == 3 and "merge_status" not in merged.columns
    assert P.merge_dataset(manifest, workers, previous=merged).count() == 3
    other = {**workers, "sbsmi": workers["sbsmi"].withColumn("config_id", F.lit("x"))}
    for bad, match in ((other, "configs_differ"),
                       ({k: v for k, v in workers.items() if k != "entropy"}, "no_candidate"),
                       ({**workers, "again": workers["entropy"]}, "several_candidates")):
        with pytest.raises(ContractViolation, match=match):
            P.merge_dataset(manifest, bad)
    with pytest.raises(ContractViolation, match="month_conflict"):
        P.merge_dataset(manifest, workers, previous=merged.withColumn("month", F.lit("2018-01")))


def test_merge_refuses_problems(manifest, blobs):
    reports = generated(manifest, blobs).drop("pixels")
    missing = reports.where(f"NOT (sha = '{SHA[0]}' AND modality = 'entropy')")
    assert [(r.sha, r.rule) for r in G.candidate_problems(manifest, missing, G.MODALITIES).collect()] \
        == [(SHA[0], "no_candidate")]
    twice = reports.unionByName(reports.where(f"sha = '{SHA[1]}' AND modality = 'sbsmi'"))
    assert [r.rule for r in G.candidate_problems(manifest, twice, G.MODALITIES).collect()] \
        == ["several_candidates"]
    other = reports.withColumn("content_sha256", F.when(
        (F.col("sha") == SHA[2]) & (F.col("modality") == "sbsmi"), F.lit("0" * 64))
        .otherwise(F.col("content_sha256")))
    status = {r.sha: r.merge_status for r in G.merge_views(manifest, other).collect()}
    assert status[SHA[2]] == "different_bytes_or_config" and status[SHA[0]] == "merged"


def test_audit_finds_tampering(manifest, blobs):
    views = generated(manifest, blobs).cache()
    reports = views.drop("pixels")
    first = (F.col("sha") == SHA[0]) & (F.col("modality") == "raw_byte")
    changed = views.withColumn("pixels", F.when(first, F.transform(
        "pixels", lambda p: p / F.lit(2.0).cast("float"))).otherwise(F.col("pixels")))
    errors = G.audit_dataset(manifest, changed, reports)["errors"].collect()
    assert {(r.sha, r.modality, r.rule) for r in errors} == {(SHA[0], "raw_byte", "output_digest")}
    lost = G.audit_dataset(manifest, views.where(~first), reports)
    assert lost["verdict"].first().verdict == "FAIL"


def test_upsert(manifest, blobs):
    reports = generated(manifest, blobs).drop("pixels")
    old = G.merge_views(manifest, reports, ("raw_byte",)).drop("merge_status")
    new = G.merge_views(manifest.where("split = 'train'"), reports, ("sbsmi",)).drop("merge_status")
    rows = {r.sha: r for r in G.upsert_manifest(old, new).collect()}
    assert rows[SHA[0]].raw_byte_path and rows[SHA[0]].sbsmi_path and not rows[SHA[1]].sbsmi_path
    assert G.upsert_conflicts(old, new).isEmpty()
    moved = new.withColumn("month", F.lit("2018-01"))
    assert {r.rule for r in G.upsert_conflicts(old, moved).collect()} == {"month_conflict"}


def test_incremental_views(spark, manifest, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    paths = [str(tmp_path / name) for name in ("views", "log", "checkpoint")]

    def run():
        incremental_views(stored_files(spark, str(source)), manifest, "cfg", *paths,
                          ("sbsmi", "raw_byte"))
        log = spark.read.option("recursiveFileLookup", True).parquet(paths[1])
        return sorted((r.sha[0], r.modality) for r in log.collect())
    for sha in SHA[:2]:
        (source / f"{sha}.exe").write_bytes(b"abc" * 200)
    first = run()
    assert first == [("a", "raw_byte"), ("a", "sbsmi"), ("b", "raw_byte"), ("b", "sbsmi")]
    assert run() == first
    (source / f"{SHA[2]}.exe").write_bytes(b"xyz" * 200)
    (source / "copy").mkdir()
    (source / "copy" / f"{SHA[0]}.exe").write_bytes(b"abc" * 200)
    assert run() == first + [("d", "raw_byte"), ("d", "sbsmi")]


def test_blobs_before_their_manifest_row_wait(spark, manifest, tmp_path):
    source, paths = tmp_path / "in", [str(tmp_path / n) for n in ("views", "log", "checkpoint")]
    source.mkdir()
    (source / f"{SHA[0]}.exe").write_bytes(b"abc" * 200)

    def run(known, config):
        incremental_views(stored_files(spark, str(source)), known, config, *paths, ("sbsmi",))
        log = spark.read.option("recursiveFileLookup", True).parquet(paths[1])
        return sorted((r.sha[0], r.config_id, r.status) for r in log.collect())
    nobody = manifest.where("false")
    assert run(nobody, "cfg") == [("a", "cfg", "WAITING")]
    (source / "again").mkdir()
    (source / "again" / f"{SHA[0]}.exe").write_bytes(b"abc" * 200)
    done = [("a", "cfg", "CREATED"), ("a", "cfg", "WAITING")]
    assert run(manifest, "cfg") == done
    (source / "third").mkdir()
    (source / "third" / f"{SHA[0]}.exe").write_bytes(b"abc" * 200)
    assert run(manifest, "new") == [*done, ("a", "new", "CREATED")]


def test_scoring_function(manifest, blobs):
    views = generated(manifest, blobs, "raw_byte")

    def two_classes(pixels):
        mean = pixels.mean(axis=1)
        return np.stack([mean, 1 - mean], axis=1), pixels[:, :8]
    rows = K.score_with(views, two_classes, "raw_byte", 11).collect()
    assert len(rows) == 3 and all(len(r.logits) == 2 and len(r.embedding) == 8 for r in rows)

    def broken(pixels):
        return np.full((len(pixels), 2), np.nan), pixels[:, :8]
    with pytest.raises(Exception, match="non-finite"):
        K.score_with(views, broken, "raw_byte", 11).collect()


def test_classifier(manifest, blobs):
    views = generated(manifest, blobs, "raw_byte")
    model = K.fit_view_classifier(views, 2, max_iter=3)
    rows = K.score_views(model, views, "raw_byte", 11, 3).collect()
    assert len(rows) == 3 and all(len(r.logits) == 3 and r.logits[2] == -1e6 for r in rows)
    assert K.finite_scores(K.score_views(model, views, "raw_byte", 11, 3)).isEmpty()


def test_contract(spark):
    assert entry(spark).count() == 12
    assert set(oracle_sql()) <= set(queries())
    assert S.SPLIT_ORDER == ("train", "validation", "test")


@pytest.fixture
def undisturbed(spark, manifest, blobs, tmp_path):
    """Digests of all items of a run that nothing disturbed."""
    path = str(tmp_path / "undisturbed")
    P.generate_dataset(spark, dataset_rows(manifest), blobs, {"name": "v2"}, path)
    return digests(spark, path)


def digests(spark, path):
    views = journal.current_views(spark, path).withColumn("now", G.pixels_sha256("pixels"))
    rows = views.select("sha", "modality", "output_sha256", "now").collect()
    assert all(r.output_sha256 == r.now for r in rows)
    return sorted((r.sha, r.modality, r.now) for r in rows)


def statuses(log):
    return sorted((r.sha[0], r.modality, r.status) for r in log.collect())


class Killed(Exception):
    pass


def dies_at(monkeypatch, module, name, first=None):
    """The run ends where ``name`` is called (after ``first`` did a part of its work)."""
    real = getattr(module, name)

    def end(*args, **more):
        if first:
            first(real, *args, **more)
        raise Killed(name)
    monkeypatch.setattr(module, name, end)


def half(real, views, path, **more):
    """Write all files, then lose some, cut one short and lose the job's marker."""
    real(views, path, **more)
    parts = sorted(Path(path).rglob("*.parquet"))
    for part in parts[::3]:
        part.unlink()
    parts[1].write_bytes(parts[1].read_bytes()[:200])
    (Path(path) / "_SUCCESS").unlink()


@pytest.mark.parametrize("module, name, first", [
    (P, "make_views", None), (P.journal, "claim", None), (P.sinks, "write_views", None),
    (P.sinks, "write_views", half), (P.journal, "written", None), (P.journal, "commit", None),
    (P.journal, "commit", lambda real, *a: real(*a)), (P, "finish_output", None)])
def test_a_run_that_dies_is_continued(spark, manifest, blobs, tmp_path, monkeypatch, undisturbed,
                                      module, name, first):
    path, selected = str(tmp_path / "out"), dataset_rows(manifest)
    with monkeypatch.context() as patch:
        dies_at(patch, module, name, first)
        with pytest.raises(Killed):
            P.generate_dataset(spark, selected, blobs, {"name": "v2"}, path)
    log = P.generate_dataset(spark, selected, blobs, {"name": "v2"}, path)
    assert log.count() == 9 and digests(spark, path) == undisturbed
    again = P.generate_dataset(spark, selected, blobs, {"name": "v2"}, path)
    assert {r.status for r in again.collect()} == {"VERIFIED"}
    assert digests(spark, path) == undisturbed


def test_whole_views_of_a_dead_run_are_adopted(spark, manifest, blobs, tmp_path, monkeypatch):
    path, selected = str(tmp_path / "out"), dataset_rows(manifest)
    with monkeypatch.context() as patch:
        dies_at(patch, P.journal, "written")
        with pytest.raises(Killed):
            P.generate_dataset(spark, selected, blobs, {"name": "v2"}, path)
    log = P.generate_dataset(spark, selected, blobs, {"name": "v2"}, path)
    assert {r.status for r in log.collect()} == {"VERIFIED"}
    assert not (tmp_path / "out" / "views" / "attempt=2").exists()


def test_damaged_views_are_made_again(spark, manifest, blobs, tmp_path, undisturbed):
    path, selected = str(tmp_path / "out"), dataset_rows(manifest)
    P.generate_dataset(spark, selected, blobs, {"name": "v2"}, path)
    first = next((tmp_path / "out" / "views").rglob("split=validation/**/modality=sbsmi/*.parquet"))
    first.write_bytes(b"corruption")
    log = P.generate_dataset(spark, selected, blobs, {"name": "v2"}, path)
    assert [s for s in statuses(log) if s[2] == "CREATED"] == [("b", "sbsmi", "CREATED")]
    assert digests(spark, path) == undisturbed
    # A readable file with other pixels is found by its digest.
    victim = next((tmp_path / "out" / "views").rglob("split=validation/**/modality=entropy/*.parquet"))
    changed = spark.read.parquet(str(victim)).withColumn("pixels", F.transform(
        "pixels", lambda p: p / F.lit(2).cast("float")))
    changed.coalesce(1).write.parquet(str(tmp_path / "changed"))
    victim.write_bytes(next((tmp_path / "changed").glob("*.parquet")).read_bytes())
    Path(f"{victim.parent}/.{victim.name}.crc").unlink()
    log = P.generate_dataset(spark, selected, blobs, {"name": "v2"}, path)
    assert [s for s in statuses(log) if s[2] == "CREATED"] == [("b", "entropy", "CREATED")]
    assert digests(spark, path) == undisturbed
    assert list((tmp_path / "out" / "_set_aside").rglob("*.parquet"))


def test_sources_are_verified_on_demand(spark, manifest, blobs, tmp_path):
    path, selected = str(tmp_path / "out"), dataset_rows(manifest)
    P.generate_dataset(spark, selected, blobs, {"name": "v2"}, path)
    other = blobs.withColumn("content", F.when(
        F.col("sha") == SHA[1], F.reverse("content")).otherwise(F.col("content")))
    with pytest.raises(ContractViolation, match="source_changed"):
        P.generate_dataset(spark, selected, other, {"name": "v2"}, path, verify_sources=True)
    log = P.generate_dataset(spark, selected, blobs, {"name": "v2"}, path, verify_sources=True)
    assert {r.status for r in log.collect()} == {"VERIFIED"}


def test_failed_views_are_set_aside(spark, manifest, blobs, tmp_path, monkeypatch):
    """What the write job counted keeps broken views out of every reader's sight."""
    path, selected = str(tmp_path / "out"), dataset_rows(manifest)
    real = G.generate_views

    def broken(*args):
        views = real(*args)
        return views.withColumn("pixels", F.when(
            F.col("modality") == "entropy", F.slice("pixels", 1, 9)).otherwise(F.col("pixels")))
    monkeypatch.setattr(G, "generate_views", broken)
    with pytest.raises(ContractViolation, match="broken=3"):
        P.generate_dataset(spark, selected, blobs, {"name": "v2"}, path)
    monkeypatch.undo()
    assert not (tmp_path / "out" / "views" / "attempt=1").exists()
    log = P.generate_dataset(spark, selected, blobs, {"name": "v2"}, path)
    assert {r.status for r in log.collect()} == {"CREATED"} and log.count() == 9


def test_declared_sizes_spare_reading_contents(spark, manifest, blobs, tmp_path):
    sized = blobs.withColumn("size", F.octet_length("content").cast("bigint"))
    sized.write.parquet(str(tmp_path / "blobs"))
    stored = spark.read.parquet(str(tmp_path / "blobs"))
    plan = P.source_index(stored)._jdf.queryExecution().optimizedPlan().toString()
    scanned = plan[plan.index("+- Relation"):] if "+- Relation" in plan else plan
    assert "Project [sha" in plan and "octet_length" not in plan, scanned


def test_released_blobs_of_a_table_take_one_scan(spark, manifest, blobs, tmp_path):
    """A batch reads a table once, however many blobs it releases, and drops other samples."""
    blobs.select("sha", "member").write.parquet(str(tmp_path / "names"))
    manifest.where(f"sha <> '{SHA[0]}'").write.parquet(str(tmp_path / "rows"))
    names = spark.readStream.schema("sha string, member string").parquet(str(tmp_path / "names"))
    rows = spark.readStream.schema(manifest.schema).parquet(str(tmp_path / "rows"))
    paths, asked = [str(tmp_path / n) for n in ("views", "log", "checkpoint")], []

    def fetch(ready):
        asked.append(ready.count())
        return blobs.select("sha", "member", "content")
    views_as_both_arrive(names, rows, fetch, "cfg", *paths, ("sbsmi", "raw_byte"), None)
    log = spark.read.option("recursiveFileLookup", True).parquet(paths[1])
    known = {r.sha for r in manifest.select("sha").collect()} - {SHA[0]}
    assert len(asked) == 1 and asked[0] == len(known)
    assert sorted((r.sha, r.modality) for r in log.collect()) == sorted(
        (s, m) for s in known for m in ("sbsmi", "raw_byte"))


def test_only_wanted_views_are_generated(spark, manifest, blobs):
    wanted = F.when(F.col("sha") == SHA[0], F.array(F.lit("sbsmi"))).otherwise(
        F.array(F.lit("sbsmi"), F.lit("entropy")))
    made = G.generate_views(manifest.withColumn("wanted", wanted), blobs, "cfg")
    assert "wanted" not in made.columns
    found = {(r.sha, r.modality) for r in made.collect()}
    assert found == {(r.sha, m) for r in manifest.collect() for m in (
        ("sbsmi",) if r.sha == SHA[0] else ("sbsmi", "entropy"))}


def test_late_manifest_rows_release_waiting_blobs(spark, manifest, tmp_path):
    """Either side may come first; nothing waits for good, nothing is viewed twice."""
    source, rows_at = tmp_path / "in", str(tmp_path / "rows")
    source.mkdir()
    paths = [str(tmp_path / n) for n in ("views", "log", "checkpoint")]

    def run():
        names = stored_files(spark, str(source)).select("sha", "member")
        rows = spark.readStream.schema(manifest.schema).parquet(rows_at)
        views_as_both_arrive(names, rows, named_files, "cfg", *paths, ("sbsmi",))
        if not (tmp_path / "log").exists():
            return []
        log = spark.read.option("recursiveFileLookup", True).parquet(paths[1])
        return sorted((r.sha[0], r.status) for r in log.collect())
    (source / f"{SHA[0]}.exe").write_bytes(b"abc" * 200)
    manifest.where(f"sha = '{SHA[1]}'").write.parquet(rows_at)
    assert run() == []
    manifest.where(f"sha = '{SHA[0]}'").write.mode("append").parquet(rows_at)
    assert run() == [("a", "CREATED")]
    (source / f"{SHA[1]}.exe").write_bytes(b"xyz" * 90)
    (source / "copy").mkdir()
    (source / "copy" / f"{SHA[0]}.exe").write_bytes(b"abc" * 200)
    assert run() == [("a", "CREATED"), ("b", "CREATED")]
    views = spark.read.option("recursiveFileLookup", True).parquet(paths[0])
    assert {r.sha for r in views.select("sha").collect()} == set(SHA[:2]) and views.count() == 2
