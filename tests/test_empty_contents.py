"""Queries of views beside their SQL on documents some of which are empty or missing."""

import duckdb
import numpy as np
import pytest

from __spark_entry__ import oracle_sql, queries
from tools.check_oracles import compare

#: Documents without text, by number: in train, validation and test, with a label and without.
EMPTY, MISSING = (3, 6, 18, 21, 25, 36), (4, 19, 26)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """40 documents over all splits, of 1 byte to 3,000; every third has a label."""
    rng, path = np.random.default_rng(7), str(tmp_path_factory.mktemp("tables"))
    letters = list("aaaabc \n\tXYZ09äλ字")
    texts = ["".join(rng.choice(letters, n)) for n in rng.integers(1, 3000, 40)]
    texts[0] = "q"
    docs = [(11 * n, None if n in MISSING else "" if n in EMPTY else text, "en", f"src{n % 4}")
            for n, text in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string") \
        .coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(11 * n, n % 2, 0) for n in range(0, 40, 3)],
                          "doc_id bigint, quality int, toxic int") \
        .coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


def against_sql(spark, folder, name):
    with duckdb.connect() as base:
        for table in ("documents", "labels"):
            base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        want = base.execute(oracle_sql()[name]).fetchdf()
    assert len(want)
    # Integers with nulls are floats in the frame of Spark.
    want = want.astype({c: "float64" for c in want if str(want[c].dtype) == "Int64"})
    return compare(queries()[name](spark, folder).toPandas(), want)


@pytest.mark.parametrize("name", [
    "b18_lbit_states",
    "f6_window_overlap_mean",
    "i1_raw_byte_view",
    "i2_raw_byte_view_binned",
    "i4_entropy_view",
    "i5_entropy_view_binned",
    "i7_sbsmi_view",
    "l2_register_functions",
    "h2_union_workers",
    "v11_audit_dataset",
    "v11_audit_errors",
    "v12_compare_implementations",
    "v6_check_view_image",
    "h4_bucketed_upsert",
    "h4_upsert_manifest",
    "k1_fit_view_classifier",
    "a16_resumed_dataset",
    "c9_resume_generation",
    "i9_generate_views",
    "a8_scan_view_images",
    "k2_score_views",
    "k3_cross_validate",
])
def test_empty_contents_as_in_sql(spark, folder, name):
    assert against_sql(spark, folder, name) == "ok"
