"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Every document has a fixed hash. A source takes each document ``whole`` times (target divided by size, rounded
down) and once more if its hash lies below the source's threshold. The threshold comes from nested histograms:
sums of words by source and hash bucket show in which bucket the budget runs out, and only the documents of
that bucket are summed again by the next bits. Nothing is sorted but the buckets of one source, of which there
are at most ``2**BITS``.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents that
share a doc_id (also a null one) share the hash and are taken together; sources without words have target 0;
an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnwatch.llm.shared import same_columns, stored

WORD = r"[^\x20\x09-\x0D]+"
BITS = 12  # bits of the hash that one histogram reads
LEVELS = 5  # 60 bits in all
MOST = 3  # a source is taken at most this often


def hash60(column: Column) -> Column:
    """60 bits of the MD5 of the id's text: the same in every engine and run."""
    digest = F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(digest, 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """One row per source: source_size, target and the ``whole`` copies and ``rest`` of words beyond them.

    ``sizes`` has source and size. Weights repeat along the sources in code point order, null last. Targets
    share all words by weight; a target stops at ``MOST`` times its source's size and the excess goes
    to the others by weight. With the sources in order of size per weight the stopped ones come first, so
    running sums over the sources (one row each) find them all at once.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    choice = F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", choice.cast("long").alias("weight"))
    order = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    run = per.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    # Stopped if its share of what the earlier sources leave is above its bound.
    left = F.col("total") - MOST * F.col("size_before")
    over = F.col("weight") * left > MOST * F.col("source_size") * (F.col("all_weight") - F.col("weight_before"))
    run = run.withColumn("stopped", over)
    run = run.select(
        "*",
        F.sum(F.when(F.col("stopped"), F.col("source_size")).otherwise(0)).over(everything).alias("stopped_size"),
        F.sum(F.when(F.col("stopped"), 0).otherwise(F.col("weight"))).over(everything).alias("open_weight"),
    )
    share = (F.col("weight") * (F.col("total") - MOST * F.col("stopped_size"))).cast("double") / F.col("open_weight").cast("double")
    run = run.withColumn("target", F.when(F.col("stopped"), (MOST * F.col("source_size")).cast("double")).otherwise(share))
    words = F.col("source_size")
    whole = F.when(words == 0, 0).otherwise(F.floor(F.col("target") / words)).cast("long")
    return run.select("source", "source_size", "target", whole.alias("whole")).withColumn(
        "rest", F.when(words == 0, 0).otherwise(F.floor(F.col("target") - F.col("whole") * words)).cast("long")
    )


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source the bound ``below``: documents with a smaller hash are taken once more.

    Each level keeps the documents of one bucket per source and the budget left for it. The last level decides
    whether the group of documents with the boundary's very hash is nearer to the budget with or without it.
    """
    budget = goals.select(F.col("source").alias("s"), F.col("rest").alias("left"))
    found = None
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        last = level == LEVELS - 1
        bucket = F.shiftright("hash", shift)
        sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        upto = W.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("words").over(upto))
        joined = sums.join(budget.select("s", "left"), F.col("source").eqNullSafe(F.col("s")))
        # The first bucket that the budget does not cover.
        first = (
            joined.filter(F.col("upto") > F.col("left"))
            .groupBy("s")
            .agg(F.min(F.struct("bucket", "words", "upto", "left")).alias("x"))
            .select("s", "x.*")
        )
        inside = F.col("left") - (F.col("upto") - F.col("words"))
        if last:
            near = (F.col("upto") - F.col("left")) < inside
            found = first.select("s", (F.col("bucket") + F.when(near, 1).otherwise(0)).alias("below"))
        else:
            budget = stored(first.select("s", inside.alias("left"), "bucket"), "budget")
            rows = stored(
                rows.withColumn("_bucket", bucket)
                .join(budget.select("s", "bucket"), F.col("source").eqNullSafe(F.col("s")) & (F.col("_bucket") == F.col("bucket")), "left_semi")
                .drop("_bucket"),
                "boundary",
            )
    return found


def prepared(base: DataFrame, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """Sizes and hashes of the documents (doc_id, source, text), and per source what to take of it."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = stored(base.select("doc_id", "source", size.alias("size"), hash60(F.col("doc_id")).alias("hash")), "sizes")
    goals = stored(targets(rows, weights), "targets")
    below = stored(thresholds(rows, goals), "thresholds")
    plan = goals.join(below, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("s"), "source_size", "target", "whole", "below"
    )
    return rows, stored(plan, "plan")


def taken(size: Column, hash_: Column) -> Column:
    once = F.when(F.col("below").isNotNull() & (hash_ < F.col("below")), 1).otherwise(0)
    return size * (F.col("whole") + once)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and the words ``taken`` from it."""
    rows, plan = prepared(same_columns(docs, ["doc_id", "source", "text"]), weights)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "source_size", "target", taken(F.col("size"), F.col("hash")).alias("taken")
    )


def mixture(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """The documents that the mix takes: their columns, then size, source_size, target and ``taken``.

    Columns of those four names give way. Only the short plan by source is joined; the documents stay put.
    """
    _, plan = prepared(same_columns(docs, ["doc_id", "source", "text"]), weights)
    new = ["size", "source_size", "target", "taken"]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    size = F.coalesce(F.regexp_count(F.col("row.text"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(row.alias("row")).withColumn("size", size).join(plan, F.col("row.source").eqNullSafe(F.col("s")))
    rows = rows.withColumn("taken", taken(F.col("size"), hash60(F.col("row.doc_id")))).filter("taken > 0")
    return rows.select("row.*", *new)
