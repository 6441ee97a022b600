"""What the corpus operators share: text expressions, Arrow slices and the bounded sieve."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The characters that separate words, and the word pattern made of them.
GAPS = " \t\n\u000b\f\r"
WORD = r"[^\x20\x09-\x0D]"
GAP = r"[\x20\x09-\x0D]"

ARROW = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Batches to Python are bounded by bytes, so a batch of long texts stays small."""
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/documents.parquet")


def whole(text: str = "text") -> Column:
    """The text; a null one counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def packed(docs: DataFrame, *names: str | Column) -> DataFrame:
    """Whole rows in one column ``_row`` beside the columns that are worked with.

    What an operator adds can then not clash with a column of the documents.
    """
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"), *names)


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("_row.*")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    """Number of words: each becomes one letter, so no array of words is built."""
    return F.length(F.regexp_replace(F.ltrim(text, F.lit(GAPS)), f"{WORD}++{GAP}*+", "w")).cast(
        "long")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def byte_slices(batches: Iterator[pa.RecordBatch], column: str,
                limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start, held = 0, 0
        for row, size in enumerate(sizes):
            if row > start and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if len(sizes) > start:
            yield batch.slice(start)


def cut_at_gaps(text: str, limit: int, gap: str = " ", before: str = " ") -> Iterator[str]:
    """Parts of about ``limit`` characters; each later part began with one ``gap``, now dropped.

    A cut is made only before a gap whose left neighbour is none of ``before``, so a run of gaps
    stays with what follows it.
    """
    start = 0
    while len(text) - start > limit:
        at = text.find(gap, start + limit)
        while at > 0 and text[at - 1] in before:
            at = text.find(gap, at + 1)
        if at < 0:
            break
        yield text[start:at]
        start = at + 1
    yield text[start:]
