"""Mixing sources to target weights: Efraimidis-Spirakis sampling with word budgets.

Every document draws an exponential key divided by its quality weight; within a source,
documents sorted by that key form a weighted sample without replacement, and a prefix of
them fills the source's budget. Complete epochs come first: a target of 1.4 times a source
takes every document once and a prefix worth 0.4 of the source a second time.

No source is sorted in one task. Keys fall into buckets of their logarithm, bucket sums give
each source the bucket where its budget ends, and only that bucket's documents are ordered.
Equal rows share a key and are interchangeable: they count as one block, and where a budget
ends inside a block, its rows are taken in the order of their stored places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chronoview.llm.common import packed, unpacked, whole, without, word_count
from chronoview.operators.ranking import ranked
from chronoview.session import staged

# Buckets per doubling of the key; a bucket holds at most about 0.4 % of a source.
STEPS = 128
NOISE = "#*$%&|<>"


def clean_share(text: Column) -> Column:
    """Default quality weight: the share of characters that are no symbols, in (0, 1]."""
    return (F.length(without(text, NOISE)) + F.lit(1)) / (F.length(text) + F.lit(1))


def exponential_key(doc_id: Column, weight: Column, seed: int) -> Column:
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"))), 1, 12)
    uniform = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))
    return -F.log(uniform) / weight


def measured(docs: DataFrame, seed: int = 0, weight: Column | None = None) -> DataFrame:
    """Add ``_size``, ``_key`` and ``_bucket`` to documents."""
    text = whole()
    weight = clean_share(text) if weight is None else weight
    return (docs.withColumn("_size", word_count(text))
            .withColumn("_key", exponential_key(F.col("doc_id"), weight, seed))
            .withColumn("_bucket", F.floor(F.log2(F.col("_key")) * STEPS).cast("int")))


def source_targets(sizes: DataFrame, pattern: Sequence[int], share: float,
                   cap: float) -> DataFrame:
    """Target words per source (source, source_size): ``share`` of all words, split by weight.

    Weights repeat ``pattern`` over the sources in code-point order, null last. A target stops
    at ``cap`` times its source; what is cut off goes to the others by weight until no target
    is above. With sources ordered by the level at which they are full, that end point is one
    running sum. The frame has one row per source.
    """
    weights = F.array(*(F.lit(w) for w in pattern))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    everything = W.partitionBy()
    weighed = (sizes.withColumn("_weight", F.get(weights, place % len(pattern)))
               .withColumn("_cap", F.col("source_size") * F.lit(cap))
               .withColumn("_budget", F.sum("source_size").over(everything) * F.lit(share)))
    by_level = W.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(
        by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    levelled = weighed.withColumn("_level", (F.col("_budget") - before) / left)
    open_level = F.when(F.col("_cap") / F.col("_weight") > F.col("_level"), F.col("_level"))
    share_of = F.max(open_level).over(everything) * F.col("_weight")
    return levelled.select("source", "source_size", F.least(
        F.col("_cap"), F.coalesce(share_of, F.col("_cap"))).alias("target"))


def same_source(left: DataFrame, right: DataFrame, how: str = "inner",
                also: Column | None = None) -> DataFrame:
    """Join on source, null with null; the right side's columns come without its source."""
    right = right.withColumnRenamed("source", "_source")
    on = left["source"].eqNullSafe(right["_source"])
    return left.join(right, on if also is None else on & also, how).drop("_source")


def position() -> Column:
    """Where a measured row stands in its source's order; equal rows stand together."""
    return F.struct("_key", "_size", "doc_id")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Store measured rows with a ``_place`` that is unique and fixed from here on."""
    return staged(rows.withColumn("_place", F.monotonically_increasing_id()), name)


def sampled() -> Column:
    """Whether the fractional epoch takes a measured document, given its source's cut."""
    here = (F.col("_bucket") == F.col("_cut")) & (
        F.coalesce(position() <= F.col("_last"), F.lit(False)) | F.coalesce(
            (position() == F.col("_part")) & (F.col("_place") <= F.col("_part_end")), F.lit(False)))
    return F.col("_cut").isNull() | (F.col("_bucket") < F.col("_cut")) | here


def picked() -> Column:
    here = F.struct("_size", "doc_id") == F.col("_pick")
    return F.coalesce(here & (F.col("_place") <= F.col("_pick_end")), F.lit(False))


def ends(rows: DataFrame, count: str, name: str) -> DataFrame:
    """(source, ``name``): the place of the last of each source's first ``count`` rows.

    Rows are ranked by place within the runs in which places were given, so a block of equal
    rows that fills a third of the table is still ranked by many tasks.
    """
    order = ranked(rows.select(F.struct("source").alias("_of"), "_place", count), ["_of"],
                   [F.col("_place")], F.shiftright("_place", 33), name="_rank")
    return (order.where(F.col("_rank") <= F.col(count)).groupBy("_of")
            .agg(F.max("_place").alias(name)).select("_of.source", name))


def source_cuts(sizes: DataFrame, pattern: Sequence[int] = (3, 1, 2), share: float = 1.5,
                cap: float = 2.0) -> DataFrame:
    """Where each source's sample ends, from numbered rows (source, doc_id, _size, ...).

    Returns source, source_size, target, _epochs, _cut (bucket), _last (position of the last
    block wholly inside), _part and _part_end (the block that the rest enters, and the place of
    its last row inside), _pick and _pick_end (the largest documents outside that still fit).
    """
    sums = sizes.groupBy("source", "_bucket").agg(F.sum("_size").alias("_words"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("_words").alias("source_size")),
                             pattern, share, cap)
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))),
                        F.lit(0)).cast("long")
    wanted = targets.withColumn("_epochs", epochs).withColumn(
        "_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    wanted = staged(wanted, "mix-targets")
    running = sums.withColumn("_running", F.sum("_words").over(
        W.partitionBy("source").orderBy("_bucket")))
    fits = F.col("_running") <= F.col("_rest")
    cuts = (same_source(running, wanted).groupBy("source")
            .agg(F.min(F.when(~fits, F.col("_bucket"))).alias("_cut"),
                 F.coalesce(F.max(F.when(fits, F.col("_running"))), F.lit(0)).alias("_before")))
    cuts = staged(same_source(wanted, cuts), "mix-cuts")

    edge = same_source(sizes, cuts.select("source", "_rest", "_cut", "_before"),
                       also=sizes["_bucket"] == cuts["_cut"])
    blocks = edge.groupBy("source", "_key", "_size", "doc_id", "_rest", "_before").agg(
        (F.count("*") * F.col("_size")).alias("_words"))
    blocks = blocks.withColumn("_filled", F.col("_before") + F.sum("_words").over(
        W.partitionBy("source").orderBy("_key", "_size", "doc_id")))
    inside, start = F.col("_filled") <= F.col("_rest"), F.col("_filled") - F.col("_words")
    # Only the first block that does not fit starts before the rest ends.
    enters = ~inside & (start <= F.col("_rest"))
    fitting = F.floor((F.col("_rest") - start) / F.col("_size"))
    within = blocks.groupBy("source").agg(
        F.max(F.when(inside, position())).alias("_last"),
        F.max(F.when(inside, F.col("_filled"))).alias("_filled"),
        F.max(F.when(enters, position())).alias("_part"),
        F.max(F.when(enters, fitting)).alias("_part_rows"))
    cuts = staged(same_source(cuts, within, "left").withColumn(
        "_gap", F.col("_rest") - F.coalesce("_filled", "_before")
        - F.coalesce(F.col("_part_rows") * F.col("_part._size"), F.lit(0))), "mix-edges")

    entered = same_source(sizes, cuts).where(
        (F.col("_part_rows") > 0) & (F.col("_bucket") == F.col("_cut"))
        & (position() == F.col("_part")))
    cuts = staged(same_source(cuts, ends(entered, "_part_rows", "_part_end"), "left"), "mix-parts")

    def spare() -> Column:
        return ~sampled() & (F.col("_size") > 0) & (F.col("_size") <= F.col("_gap"))
    best = (same_source(sizes, cuts).where(spare()).groupBy("source")
            .agg(F.max(F.struct("_size", "doc_id")).alias("_pick")))
    cuts = staged(same_source(cuts, best, "left").withColumn(
        "_picks", F.floor(F.col("_gap") / F.col("_pick._size"))), "mix-picks")
    chosen = same_source(sizes, cuts).where(
        spare() & (F.struct("_size", "doc_id") == F.col("_pick")))
    return staged(same_source(cuts, ends(chosen, "_picks", "_pick_end"), "left").select(
        "source", "source_size", "target", "_epochs", "_cut", "_last", "_part", "_part_end",
        "_pick", "_pick_end"), "mix-plan")


def with_copies(measured_docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``_copies``: how often the mix takes each measured document."""
    extra = (sampled() | picked()).cast("long")  # what is picked lies outside the sample
    return same_source(measured_docs, cuts).withColumn("_copies", F.col("_epochs") + extra)


def mix_report(docs: DataFrame, pattern: Sequence[int] = (3, 1, 2), share: float = 1.5,
               cap: float = 2.0, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and the words the mix takes.

    Null text has size 0; null source is a source of its own, last in order; documents
    without words take 0. Rows that share doc_id, text and source draw the same key; the budget
    may end among them. A very long text counts as any other: it is taken whole or not, and the
    source then ends up to one document short. An empty table gives no rows; other columns are
    ignored.
    """
    sizes = numbered(measured(docs.select("doc_id", "text", "source"), seed).select(
        "doc_id", "source", "_size", "_key", "_bucket"), "mix-sizes")
    mixed = with_copies(sizes, source_cuts(sizes, pattern, share, cap))
    return mixed.select("doc_id", F.col("_size").alias("size"), "source_size", "target",
                        (F.col("_copies") * F.col("_size")).alias("taken"), "source")


def mix(docs: DataFrame, pattern: Sequence[int] = (3, 1, 2), share: float = 1.5,
        cap: float = 2.0, seed: int = 0) -> DataFrame:
    """The documents of the mix, whole rows, each as often as it is taken.

    Texts are measured once, while the rows are stored for the second pass.
    """
    rows = numbered(measured(packed(docs, "doc_id", "text", "source"), seed).drop("text"),
                    "mix-rows")
    mixed = with_copies(rows, source_cuts(rows, pattern, share, cap))
    return unpacked(mixed.where(F.col("_copies") > 0).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))))
