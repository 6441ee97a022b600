import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from corpus import EXTRA, SCHEMA, rows
from test_neardup import brute as near_brute
from test_neardup import corpus
from test_packing import PATH, pieces_of
from test_quality import brute as quality_counts
from tokenizers import Tokenizer

import __spark_entry__
from chronoview.llm import catalog

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents with short, near and exact copies, and labels, as Parquet."""
    place = tmp_path_factory.mktemp("sf")
    data = [(r[0], " ".join([r[1]] + [f"tail{r[0] // 3}x{k}" for k in range(60)]), *r[2:])
            for r in corpus(11)]
    data += [(1000 + i, r[1], *r[2:]) for i, r in enumerate(data[:20])]
    data += rows([None, "", "too short"])[:3]
    data = [(5000 + i if r[0] in (0, 1, 2) and len(r[1] or "") < 20 else r[0], *r[1:])
            for i, r in enumerate(data)]
    spark.createDataFrame(data, SCHEMA).select(*COLUMNS).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in data[::2]],
                          "doc_id long, quality int, toxic int").write.parquet(
        f"{place}/labels.parquet")
    return str(place), [r[:5] for r in data]


def test_stages_are_registered():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in catalog.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_every_stage_against_brute_force(spark, folder):
    """Each stage's rows follow from its own input."""
    place, data = folder
    docs, model = data, Tokenizer.from_file(PATH)
    frame = spark.read.parquet(f"{place}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, place)
        got = [tuple(r) for r in out.collect()]
        if name != "pack_sequences":
            assert out.columns == COLUMNS
        if name == "quality_rules":
            # With so few labels no cutoff is proven, so the base decides alone.
            assert Counter(got) == Counter(r for r in docs if quality_counts(r[1])[0] >= 50)
        elif name == "exact_dedup":
            best = {}
            for r in docs:
                best[r[1]] = max(best.get(r[1], r), r)
            assert Counter(got) == Counter(best.values())
        elif name == "near_dedup":
            kept = {k[0] for k in near_brute(docs, 5) if k[3]}
            assert Counter(got) == Counter(r for r in docs if r[0] in kept)
        elif name == "mix_sources":
            sizes = {r[0]: len(re.findall(r"\S+", r[1])) for r in docs}
            assert set(got) <= set(docs) and max(Counter(got).values()) <= 2
            taken = sum(sizes[r[0]] for r in got)
            assert abs(taken - 1.5 * sum(sizes.values())) <= 3 * max(sizes.values())
        else:
            want = Counter((r[0], *p) for r in docs for p in pieces_of(r[1], model, 2048))
            assert Counter(r[:5] for r in got) == want
            bins = defaultdict(int)
            for r in got:
                bins[r[5]] += r[3]
            assert max(bins.values()) <= 2048
        out.write.parquet(f"{place}/{name}.parquet")
        frame, docs = spark.read.parquet(f"{place}/{name}.parquet"), got
        assert got


def test_run_applies_all_stages(spark, folder):
    place, _ = folder
    assert corpus_pipeline.run(spark, place).columns == [
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).select(*COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_extra_columns_survive(spark):
    data = [(1, "a b " * 40, "en", "s", 1, *EXTRA)]
    frame = spark.createDataFrame(data, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, frame, "unused")
        assert out.columns == frame.columns and {tuple(r) for r in out.collect()} == {tuple(data[0])}
