"""Building blocks that stay parallel when one key holds a large share of the rows.

``hot_groups`` counts rows per key once and names the few keys worth special care. The other functions
choose their plan by that list: ``skew_join`` salts hot keys, ``running`` cuts their ordered rows into
chunks and carries totals from chunk to chunk, ``sliding`` evaluates range windows with two running
passes, and ``numbered`` numbers rows after a range sort. Without hot keys the plan is the plain join
or window. Nothing is dropped or approximated either way.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnwatch.session import checkpoint_folder

# Up to this many hot keys are fixed on the driver; a longer list is written to the shared folder. Joins with
# it carry no hint, so Spark broadcasts it only if its size allows.
LISTED_KEYS = 20_000
MAX_SALTS = 8192
# A list of at most this many rows is broadcast after its size has been counted.
SHORT_LIST = 100_000
CHUNKS_PER_WINDOW = 1 << 16
# Chunk width for timelines without a natural window: 2^32 microseconds, about 71 minutes.
TIMELINE_CHUNK = 1 << 32

UNKNOWN = object()
# Hot keys of a table: a short list, None for none, or UNKNOWN to have them counted.
Hot = DataFrame | None | object

COMBINE = {
    "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
    "min": F.least,
    "max": F.greatest,
}
REDUCE = {"sum": F.sum, "min": F.min, "max": F.max}


def hot_floor(spark: SparkSession) -> int:
    """Rows a key needs before it counts as hot (``spark.txnwatch.hotRows``)."""
    return int(spark.conf.get("spark.txnwatch.hotRows", "1000000"))


def hot_groups(df: DataFrame, keys: Sequence[str], floor: int | None = None) -> DataFrame | None:
    """The large groups of ``df``, or None when no group is large.

    Runs one counting job over the key columns alone. The list is fixed, on the driver if it is short and in
    the shared folder otherwise, so every later use, retries included, gets the same answer.
    """
    floor = floor or hot_floor(df.sparkSession)
    found = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") >= floor)
        .select(*keys, F.least(F.lit(MAX_SALTS), F.ceil(F.col("_rows") / floor) + 1).cast("int").alias("_pieces"))
    )
    rows = found.limit(LISTED_KEYS + 1).collect()
    if len(rows) > LISTED_KEYS:
        return stored(found, "hot")
    return df.sparkSession.createDataFrame(rows, found.schema) if rows else None


def hot_within(
    df: DataFrame, keys: Sequence[str], group: Sequence[str], hot: Hot = UNKNOWN, floor: int | None = None
) -> DataFrame | None:
    """Hot keys finer than ``group``, such as (customer, day): only rows of hot groups are counted.

    A fine key can only be hot inside a hot group, so the many fine keys of other groups need no count.
    """
    groups = hot_groups(df, group) if hot is UNKNOWN else hot
    if groups is None:
        return None
    among = df.join(groups.drop("_pieces"), list(group), "left_semi")
    return hot_groups(among, keys, floor)


def hot_blocks(
    source: DataFrame, group: Sequence[str], block: Column, hot: DataFrame | None
) -> DataFrame | None:
    """Hot (group, ``_block``) pairs for windows that reach from one block into the next.

    A block shares its work with the block after it, hence both are hot when one holds half the bound.
    """
    half = max(1, hot_floor(source.sparkSession) // 2)
    found = hot_within(source.withColumn("_block", block), [*group, "_block"], group, hot, half)
    if found is None:
        return None
    both = found.select(*group, F.explode(F.array(F.col("_block"), F.col("_block") + 1)).alias("_block"), "_pieces")
    return both.groupBy(*group, "_block").agg(F.max("_pieces").alias("_pieces"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back.

    Later steps start from files every executor can reach, with fixed contents and known size. They go when
    the application ends.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the driver delete a folder when the application ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def mark_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(hot, list(keys), "left")


def whole(column: Column, width: int | Column) -> Column:
    """``column`` divided by ``width``, rounded down, in whole numbers throughout."""
    return F.call_function("div", column - F.pmod(column, F.lit(width)), F.lit(width))


def skew_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    salt_on: Sequence[str] = (),
    hot: Hot = UNKNOWN,
) -> DataFrame:
    """Equi-join where single keys of ``big`` may hold much of the data.

    Rows of a hot key in ``big`` are spread over several salts, and the few rows of that key in
    ``small`` are repeated once per salt. ``how`` is inner, left, left_semi or left_anti. Rows of
    ``big`` with a null key match nothing and are spread as well. ``hot`` may hand over the hot keys
    of ``big`` (None for none) when the caller has already counted them.
    """
    keys = list(keys)
    hot = hot_groups(big, keys) if hot is UNKNOWN else hot
    if hot is None:
        return big.join(small, keys, how)
    spread = F.xxhash64(*(salt_on or big.columns))
    null_key = F.lit(False)
    for key in keys:
        null_key = null_key | F.col(key).isNull()
    left = mark_hot(big, hot, keys).withColumn(
        "_salt",
        F.when(null_key, F.pmod(spread, F.lit(MAX_SALTS)))
        .when(F.col("_pieces").isNotNull(), F.pmod(spread, F.col("_pieces")))
        .otherwise(F.lit(0))
        .cast("int"),
    ).drop("_pieces")
    right = mark_hot(small, hot, keys).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1))
    ).drop("_pieces")
    return left.join(right, keys + ["_salt"], how).drop("_salt")


def list_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "left_semi",
    salt_on: Sequence[str] = (),
    hot: Hot = UNKNOWN,
) -> DataFrame:
    """Join with what is often a short list, such as uploads, runs or selected customers.

    The list is counted up to a bound: a short one is broadcast, so ``big`` is not shuffled at all; a
    longer one goes through ``skew_join``.
    """
    if small.limit(SHORT_LIST + 1).count() <= SHORT_LIST:
        return big.join(F.broadcast(small), list(keys), how)
    return skew_join(big, small, keys, how, salt_on, hot)


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    aggs: Mapping[str, tuple[str, str]],
    chunk: Column,
    hot: DataFrame | None,
    inclusive: bool = True,
) -> DataFrame:
    """Running sum, min or max within a group: ``aggs`` maps output to (function, column).

    ``chunk`` is a whole number that never decreases along ``order``; rows equal in ``order`` share
    a chunk. A hot group is evaluated chunk by chunk, then the totals of earlier chunks are added.
    Group columns must not be null. With ``inclusive=False`` the current row is left out.
    """
    group = list(group)
    upto = W.currentRow if inclusive else -1
    if hot is None:
        frame = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, upto)
        return df.select("*", *[REDUCE[fn](column).over(frame).alias(out) for out, (fn, column) in aggs.items()])
    chunk = chunk.cast("long")
    rows = mark_hot(df, hot, group).select(
        *df.columns, F.when(F.col("_pieces").isNotNull(), chunk).otherwise(F.lit(0).cast("long")).alias("_chunk")
    )
    frame = W.partitionBy(*group, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, upto)
    local = rows.select("*", *[REDUCE[fn](column).over(frame).alias(f"_l_{out}") for out, (fn, column) in aggs.items()])
    totals = (
        df.join(hot.drop("_pieces"), group, "left_semi")
        .withColumn("_chunk", chunk)
        .groupBy(*group, "_chunk")
        .agg(*[REDUCE[fn](column).alias(f"_t_{out}") for out, (fn, column) in aggs.items()])
    )
    before = W.partitionBy(*group).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *group, "_chunk", *[REDUCE[fn](f"_t_{out}").over(before).alias(f"_c_{out}") for out, (fn, _) in aggs.items()]
    )
    return local.join(carried, group + ["_chunk"], "left").select(
        *df.columns,
        *[COMBINE[fn](F.col(f"_l_{out}"), F.col(f"_c_{out}")).alias(out) for out, (fn, _) in aggs.items()],
    )


def sliding(
    nodes: DataFrame,
    group: Sequence[str],
    at: str,
    width: int | Column,
    aggs: Mapping[str, tuple[str, str]],
    tie: str | None = None,
    source: DataFrame | None = None,
    hot: Hot = UNKNOWN,
) -> DataFrame:
    """For every node, aggregate the *other* nodes of its group in ``[at, at + width]``.

    Nodes at the same position count only if their ``tie`` is greater, so without ``tie`` a group
    must hold one node per position. The axis is cut into blocks of ``width``: a window is the end
    of one block plus the start of the next, so two running passes replace a frame scan per row,
    and the work is linear in the nodes however long the windows are. ``source`` may give the raw
    rows (group and ``at``) from which hot groups and blocks are counted cheaply, ``hot`` the hot groups
    if they are known. ``width`` may be a column over the group columns.
    """
    group = list(group)
    block = whole(F.col(at), width)
    blocked = group + ["_block"]
    counted = source if source is not None else nodes
    groups = hot_groups(counted, group) if hot is UNKNOWN else hot
    blocks = hot_blocks(counted, group, block, groups)
    if isinstance(width, int):
        step: int | Column = max(1, -(-width // CHUNKS_PER_WINDOW))
    else:
        step = F.greatest(F.lit(1), whole(width + F.lit(CHUNKS_PER_WINDOW - 1), CHUNKS_PER_WINDOW))
    order = [F.desc(at)] + ([F.desc(tie)] if tie else [])
    tail = running(
        nodes.withColumn("_block", block),
        blocked,
        order,
        {f"_s_{out}": spec for out, spec in aggs.items()},
        chunk=-whole(F.col(at), step),
        hot=blocks,
        inclusive=False,
    )
    kind = F.col("_kind")
    used = {column for _, column in aggs.values()}
    payload = [c for c in nodes.columns if c not in group]
    doubled = tail.withColumn("_kind", F.explode(F.array(F.lit(0), F.lit(1))))
    probes = doubled.select(
        *group,
        (F.col("_block") + kind).alias("_block"),
        (F.col(at) + kind * F.lit(width)).alias("_probe_at"),
        "_kind",
        *[F.when(kind == 1, F.col(c)).alias(c) for c in payload],
        *[F.when(kind == 1, F.col(f"_s_{out}")).alias(f"_s_{out}") for out in aggs],
        *[F.when(kind == 0, F.col(c)).alias(f"_n_{c}") for c in sorted(used)],
    )
    head = running(
        probes,
        blocked,
        [F.col("_probe_at"), F.col("_kind")],
        {f"_p_{out}": (fn, f"_n_{column}") for out, (fn, column) in aggs.items()},
        chunk=whole(F.col("_probe_at"), step),
        hot=blocks,
    )
    return head.filter(F.col("_kind") == 1).select(
        *group,
        *payload,
        *[COMBINE[fn](F.col(f"_s_{out}"), F.col(f"_p_{out}")).alias(out) for out, (fn, _) in aggs.items()],
    )


def next_after(
    probes: DataFrame,
    items: DataFrame,
    group: Sequence[str],
    probe_at: str,
    item_at: str,
    item: str,
    out: str,
    hot: DataFrame | None,
) -> DataFrame:
    """Attach to each probe the first item of its group at or after ``probe_at``.

    ``item`` is a struct column whose first field orders items (it must begin with the position).
    Probes and items are read once in descending order with a running minimum, so no pairs are formed.
    ``hot`` names the groups with many items or probes.
    """
    group = list(group)
    payload = [c for c in probes.columns if c not in group]
    item_type = items.schema[item].dataType
    left = probes.select(
        *group, F.col(probe_at).alias("_probe_at"), F.lit(1).alias("_kind"),
        F.struct(*payload).alias("_probe"), F.lit(None).cast(item_type).alias("_item"),
    )
    right = items.select(
        *group, F.col(item_at).alias("_probe_at"), F.lit(0).alias("_kind"),
        F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"), F.col(item).alias("_item"),
    )
    both = left.unionByName(right)
    found = running(
        both,
        group,
        [F.desc("_probe_at"), F.col("_kind")],
        {"_found": ("min", "_item")},
        chunk=-whole(F.col("_probe_at"), TIMELINE_CHUNK),
        hot=hot,
    )
    return found.filter(F.col("_kind") == 1).select(*group, "_probe.*", F.col("_found").alias(out))


def numbered(
    df: DataFrame, group: Sequence[str], order: Sequence[str], out: str, totals: Mapping[str, str] | None = None
) -> DataFrame:
    """Number the rows of each group 1..n along ``order`` (a total order), whatever the group size.

    A range sort spreads even a single group over all tasks. The sorted rows are stored once so that
    partition bounds stay fixed; then each (group, partition) piece gets the count of the
    pieces before it. ``totals`` maps output to a column summed over the whole group on the way.
    """
    totals = totals or {}
    group = list(group)
    placed = stored(
        df.orderBy(*group, *order)
        .withColumn("_position", F.monotonically_increasing_id())
        .withColumn("_piece", F.shiftright(F.col("_position"), 33)),
        "numbered",
    )
    pieces = placed.groupBy(*group, "_piece").agg(
        F.min("_position").alias("_first"),
        F.count(F.lit(1)).alias("_size"),
        *[F.sum(column).alias(f"_t_{name}") for name, column in totals.items()],
    )
    before = W.partitionBy(*group).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    entire = W.partitionBy(*group)
    offsets = pieces.select(
        *group,
        "_piece",
        (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        *[F.sum(f"_t_{name}").over(entire).alias(name) for name in totals],
    )
    # One (group, piece) is at most one sort partition, so this join needs no salt.
    joined = placed.join(offsets, [*group, "_piece"], "inner")
    return joined.select(*df.columns, (F.col("_position") + F.col("_shift")).alias(out), *totals)
