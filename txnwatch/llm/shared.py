"""Spark helpers of this subpackage: written intermediate tables, fixed-size filters, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.llm.words import mix
from txnwatch.operators.skew import delete_at_end
from txnwatch.session import checkpoint_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint folder and read back.

    It cuts the lineage, fixes the rows for every later reader and survives lost executors. The folder
    goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


# Whole texts go to Python in batches of so many rows.
TEXT_ROWS = 1024
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Steps that are written inside hand rows to Python in short batches; the session's setting holds again after.

    Spark counts rows, not bytes: ten thousand whole texts are tens of MB, several times over in the executor and its workers.
    """
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(TEXT_ROWS if int(before) <= 0 else min(TEXT_ROWS, int(before))))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def same_columns(docs: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns, so that extra columns cannot clash with working names."""
    return docs.select(*[F.col(f"`{name}`") for name in names])


# Largest filter that is broadcast: 2^27 bits are 16 MB.
MAX_FILTER_BITS = 1 << 27
PROBES = 3


def _slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(keys.astype(np.int64).view(np.uint64))
    g = (h >> np.uint64(32)) | np.uint64(1)
    return [(h + np.uint64(k) * g) & np.uint64(bits - 1) for k in range(PROBES)]


def key_filter(keys: DataFrame) -> Broadcast:
    """A Bloom filter of the long column ``key``, at most 16 MB whatever the number of keys.

    It only saves work: a key that was added always passes, and a later exact join drops the others.
    """
    spark = keys.sparkSession
    n = keys.count()
    bits = min(MAX_FILTER_BITS, 1 << max(16, int(12 * max(n, 1)).bit_length()))

    def slots(batches):
        import pyarrow as pa

        for batch in batches:
            found = np.concatenate(_slots(batch.column(0).to_numpy(zero_copy_only=False), bits))
            word, bit = found >> np.uint64(6), np.uint64(1) << (found & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bit.view(np.int64))], ["word", "bits"])

    found = keys.select("key").mapInArrow(slots, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    if found.num_rows:
        table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(table)


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in a filter made by ``key_filter``."""
    ok = np.ones(len(keys), bool)
    for slot in _slots(keys, len(table) * 64):
        ok &= (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
    return ok


def may_be_in(table):
    """A test of a long column against a ``key_filter``; Python sees that column only, not the texts beside it."""
    import pyarrow as pa

    return F.arrow_udf(lambda keys: pa.array(passes(table.value, keys.to_numpy(zero_copy_only=False))), "boolean")


def filtered(rows: DataFrame, column: str, table) -> DataFrame:
    """The rows whose long ``column`` may be in a ``key_filter``."""
    return rows.filter(may_be_in(table)(F.col(column)))


def components(edges: DataFrame) -> DataFrame:
    """Smallest node of each node's component: columns node, root (long), for nodes with an edge.

    ``edges`` has long columns a and b. Alternating star steps hang each node's larger and smaller
    neighbours on its smallest one, which takes a number of rounds that grows with the logarithm of the
    longest chain. Each round is a grouping by node with map-side minima and is written to the shared folder.
    """
    current = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges"
    )
    before = None
    while True:
        # Large star: each neighbour above the node hangs on the node's smallest neighbour.
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: the node and its neighbours below hang on the smallest of them.
        lower = large.distinct()
        low = lower.groupBy("u").agg(F.min("v").alias("m"))
        hung = lower.join(low, "u")
        small = hung.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        current = stored(small.distinct(), "edges")
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    found = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.union(found.select("root", "root").distinct())
