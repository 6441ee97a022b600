"""Cohort, selection, fold, join and validation operators on small tables."""

from difflib import SequenceMatcher
from random import Random

import pytest
from pyspark.sql import functions as F

from chronoview.errors import ContractViolation, require_clean
from chronoview.functions import scalars as S
from chronoview.operators import cohort as C
from chronoview.operators import folds as D
from chronoview.operators import joins as J
from chronoview.operators import names as N
from chronoview.operators import ranking as R
from chronoview.operators import selection as L
from chronoview.operators import validate as V
from chronoview.plans import manifest as M


def sha(i):
    from hashlib import sha256
    return sha256(str(i).encode()).hexdigest()


def rules(frame):
    return sorted((str(r[0]), r.rule) for r in frame.collect())


@pytest.mark.parametrize("text, want", [
    ("2019-10-12 01:02:03", "2019-10-12T01:02:03.000000+00:00"),
    ("2019-10-12T01:02:03Z", "2019-10-12T01:02:03.000000+00:00"),
    ("2019-10-12T01:02:03+02:00", "2019-10-11T23:02:03.000000+00:00"),
    ("10/12/2019 01:02", "2019-10-12T01:02:00.000000+00:00"),
    ("2019/10/12", "2019-10-12T00:00:00.000000+00:00"),
    ("20191012", "2019-10-12T00:00:00.000000+00:00"),
    ("12 Oct 2019 01:02:03", "2019-10-12T01:02:03.000000+00:00"),
    ("2019-13-12", None), ("12:30", None), ("2019", None), ("", None), (None, None)])
def test_mixed_timestamps(rows, text, want):
    frame = rows([(text,)], "t string")
    assert frame.select(S.iso_utc(S.parse_mixed_timestamp(F.col("t")))).first()[0] == want


@pytest.mark.parametrize("text, want", [
    ("7", 7), ("7.0", 7), ("7e2", 700), ("7.5", None), ("-1", None), ("true", None),
    ("nan", None), ("9223372036854775807", 2**63 - 1), ("9223372036854775808", None), (None, None)])
def test_integers(rows, text, want):
    assert rows([(text,)], "t string").select(S.integer_or_null(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000003])
def test_hex_mod(rows, n):
    frame = rows([(sha(i),) for i in range(20)] + [("f" * 64,)], "sha string")
    got = {r.sha: r.m for r in frame.select("sha", S.hex_mod(F.col("sha"), n).alias("m")).collect()}
    assert got == {s: int(s, 16) % n for s in got}


@pytest.mark.parametrize("path, safe", [("a/b.exe", True), ("", False), ("/a", False), ("../a", False),
                                        ("a/../b", False), ("C:\\x", False), ("a\\..\\b", False),
                                        ("a..b", True), (None, False)])
def test_relative_paths(rows, path, safe):
    assert rows([(path,)], "p string").select(S.is_safe_relative(F.col("p"))).first()[0] is safe


@pytest.fixture(scope="module")
def samples(spark):
    """600 samples; one class holds two thirds of them."""
    data = [(sha(i), 0 if i % 3 else 1 + i % 4, f"2019-{1 + i % 9:02d}") for i in range(600)]
    return spark.createDataFrame(data, "sha string, class_id int, month string").cache()


def test_ranks_do_not_need_one_task(samples):
    ranked = R.ranked(samples, ["class_id"], [F.col("sha")], R.sha_bucket(F.col("sha"), 1))
    by_class = {}
    for r in ranked.collect():
        by_class.setdefault(r.class_id, []).append((r["rank"], r.sha))
    for pairs in by_class.values():
        assert [rank for rank, _ in sorted(pairs)] == list(range(1, len(pairs) + 1))
        assert [s for _, s in sorted(pairs)] == sorted(s for _, s in pairs)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_join(spark, samples, how):
    small = spark.createDataFrame([(c, f"name{c}") for c in range(4)], "class_id int, name string")
    plain = samples.join(small, "class_id", how).select("sha", "name")
    skewed = R.skew_join(samples, small, ["class_id"], how).select("sha", "name")
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, skewed.collect()), key=str)


def test_fold_hashes_are_not_shuffled(samples):
    """Rows meet their bucket's first number without the 64 characters they are sorted by."""
    def joins(node):
        if node.nodeName() == "Join":
            yield node.output()
        for i in range(node.children().size()):
            yield from joins(node.children().apply(i))
    plan = D.repeated_folds(samples, 10, [42, 43])._jdf.queryExecution().optimizedPlan()
    names = [[out.apply(i).name() for i in range(out.size())] for out in joins(plan)]
    assert names and all(set(n) <= {*samples.columns, "seed", "_bucket", "_before", "_rows", "start",
                                    "class_id"} for n in names)


def test_folds(spark, samples):
    folds = D.stratified_folds(samples, 10, 42).cache()
    require_clean(D.check_folds(folds, 10), "folds")
    again = D.stratified_folds(samples.orderBy(F.desc("sha")).repartition(3), 10, 42)
    assert not folds.exceptAll(again.select(folds.columns)).count()
    other = D.stratified_folds(samples, 10, 43)
    assert folds.select("sha", "test_fold").exceptAll(other.select("sha", "test_fold")).count()
    for fold in (0, 9):
        train, test = J.split_fold(folds, fold)
        assert train.count() + test.count() == 600 and J.overlap(train, test).isEmpty()


def test_fold_problems(samples):
    folds = D.stratified_folds(samples, 10, 42)
    assert rules(D.check_folds(folds.where("NOT (class_id = 1 AND test_fold = 3)"), 10)) == [
        ("1", "class_missing_from_a_fold")]
    moved = folds.withColumn("test_fold", F.when(F.col("class_id") == 0, 0).otherwise(F.col("test_fold")))
    assert ("0", "class_missing_from_a_fold") in rules(D.check_folds(moved, 10))
    twice = folds.unionByName(folds.orderBy("sha").limit(1))
    assert any(rule == "sample_repeated" for _, rule in rules(D.check_folds(twice, 10)))
    assert rules(D.small_classes(samples, 60)) == [(str(c), "class_smaller_than_fold_count")
                                                   for c in (1, 2, 3, 4)]


def test_shards_partition_the_manifest(rows):
    manifest = rows([(sha(i), "train" if i % 2 else "validation", "2019-09") for i in range(50)],
                    "sha string, split string, month string")
    parts = [{r.sha for r in L.select_rows(manifest, ["train", "validation"], shard_id=i,
                                           num_shards=3).collect()} for i in range(3)]
    assert sum(map(len, parts)) == 50 and len(set().union(*parts)) == 50
    for bad in ({"shard_id": 3, "num_shards": 3}, {"limit": 0}, {"num_shards": 0}):
        with pytest.raises(ValueError):
            L.select_rows(manifest, ["train"], **bad)


def test_limit_takes_the_first_rows(rows):
    data = [(sha(i), "train", f"2019-{8 + i % 3:02d}") for i in range(60)]
    manifest = rows(data, "sha string, split string, month string")
    first = sorted(r.sha for r in L.select_rows(manifest, ["train"], limit=25).collect())
    assert first == sorted(s for _, s in sorted((m, s) for s, _, m in data)[:25])


def test_subtotals_keep_null_groups(rows):
    frame = rows([("s1", "a", "m"), ("s2", None, "m"), ("s3", None, None)],
                 "sha string, family string, month string")
    got = {(r.family, r.month): r.n_files for r in C.grouping_totals(
        frame, "family", "month").collect()}
    assert got == {("a", "m"): 1, (None, "m"): 1, (None, None): 1, ("a", "TOTAL"): 1,
                   (None, "TOTAL"): 2, ("TOTAL", "TOTAL"): 3}
    expected = rows([("a", 2), (None, 5)], "family string, expected bigint")
    current = rows([("a", 2), (None, 4)], "family string, current bigint")
    table = {r.family: (r.expected, r.current) for r in C.compare_expected(
        expected, current).collect()}
    assert table == {"a": (2, 2), None: (5, 4), "TOTAL": (7, 6)}


def test_guard_future(rows):
    mixed = rows([("train",), ("test",)], "split string")
    only = rows([("test",)], "split string")
    assert {r.rule for r in L.guard_future(mixed, "id", "id").collect()} == {
        "future_test_mixed_with_other_splits"}
    assert {r.rule for r in L.guard_future(only, None, "id").collect()} == {
        "future_test_without_frozen_config"}
    assert L.guard_future(only, "id", "id").isEmpty()
    assert L.guard_future(rows([("train",)], "split string"), None, "id").isEmpty()


def test_similar_names_equal_brute_force(rows):
    rng, pool = Random(3), set()
    while len(pool) < 250:
        base = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 9)))
        pool.add(base)
        cut = rng.randrange(len(base) + 1)
        pool.add(base[:cut] + rng.choice("abcdeXY") + base[cut:])
    names = sorted(pool)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1:]
            if SequenceMatcher(None, a.lower(), b.lower()).ratio() >= 0.8}
    got = N.similar_names(rows([(n, 1) for n in names], "family string, support long"))
    assert {(r.family_a, r.family_b) for r in got.collect()} == want


def test_build_manifest(rows):
    label_map = rows([("fam0", 0), ("fam1", 1)], "family string, class_id int")
    data = [(sha(1).upper(), " Fam0", "10/12/2019 01:02"), (sha(2), "fam1", "2020-03-02"),
            (sha(3), "unknown", "2020-03-02"), (sha(4), "fam1", "2021-01-01"),
            (sha(5), "fam0", "2020-07-02T00:00:00Z")]
    metadata = rows(data, "sha string, family string, timestamp string")
    got = M.build_manifest(metadata, label_map).collect()
    assert [(r.sha, r.class_id, r.split) for r in got] == [
        (sha(1), 0, "train"), (sha(2), 1, "validation"), (sha(5), 0, "test")]
    for bad in ((sha(1), "fam0", "2020-03-02"), ("short", "fam0", "2020-03-02"), (sha(9), "fam0", "x")):
        with pytest.raises(ContractViolation):
            M.build_manifest(metadata.union(rows([bad], metadata.schema)), label_map)
    twice = rows([(sha(1), 5, None), (sha(1), 6, None)], "sha string, file_size long, zip_crc32 string")
    with pytest.raises(ContractViolation):
        M.build_manifest(metadata, label_map, twice)


def test_ids(rows):
    frame = rows([("A ",), ("a",), ("",), (None,), ("b",)], "sha string")
    assert rules(V.check_ids(frame)) == [("", "id_blank"), ("None", "id_null"), ("a", "id_repeated")]


def test_paths(rows):
    frame = rows([("s1", "x/a.png"), ("s2", "x\\a.png"), ("s3", "../b.png"), ("s4", "x/c.png")],
                 "sha string, image_path string")
    files = rows([("root/x/a.png",)], "path string")
    assert rules(V.check_paths(frame, "root", files)) == [
        ("root/x/a.png", "path_shared"), ("s3", "path_empty_or_unsafe"), ("s4", "file_missing")]


def test_support_uses_training_rows_only(rows):
    data = [(sha(i), "F", f"2019-{8 + i % 3:02d}") for i in range(60)] + [
        (sha(1000 + i), "G", "2019-09") for i in range(60)]
    support = {r.family: r for r in C.family_support(
        rows(data, "sha string, family string, month string")).collect()}
    assert support["F"].eligible and not support["G"].eligible


def test_dataset_hash_is_order_free(samples):
    columns = ["sha", "class_id", "month"]
    one = C.dataset_hash(samples, columns).first()
    two = C.dataset_hash(samples.orderBy(F.desc("sha")).repartition(5), columns).first()
    three = C.dataset_hash(samples.withColumn("class_id", F.col("class_id") + 1), columns).first()
    assert one == two and one.dataset_hash != three.dataset_hash


def test_prefix_trees_find_changes_from_the_top(spark, rows):
    """Equal tables end at the root; else only rows of differing prefixes are compared."""
    from hashlib import sha256
    data = [(sha256(str(i).encode()).hexdigest(), f"f{i % 3}") for i in range(500)]
    schema, columns = "sha string, family string", ["sha", "family"]
    left = rows(data, schema)
    tree = C.prefix_tree(left, columns)
    assert tree.where("level = 0").first().n == 500
    assert C.differing_prefixes(tree, C.prefix_tree(left.repartition(5), columns)) == []
    other = rows([*data[:7], (data[7][0], "new"), *data[9:], ("0" * 64, "f0")], schema)
    found = C.differing_prefixes(tree, C.prefix_tree(other, columns))
    assert found == sorted({data[7][0][:3], data[8][0][:3], "000"})
    got = {tuple(r) for r in C.changed_rows(left, other, found, columns).collect()}
    assert got == {(data[7][0], "changed"), (data[8][0], "removed"), ("0" * 64, "added")}
