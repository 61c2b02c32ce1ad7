"""MinHash near-dedup by a chosen-path set similarity join.

Documents are sets of word shingles; equal sets are one class. In each of ``TREES`` trees a class
starts in the node named by one of its minwise tokens. A small node compares all its classes. A larger one
branches: it picks positions of the signature (1.25 on average, the inverse of the similarity sought), and each
class moves to the child of its minwise token there, so similar classes stay together and others part, until nodes are
small. Large nodes also compare every class with two pivots, which links big groups of near copies with work in
proportion to their size. Candidates whose signatures agree in too few places are dropped; the others are
confirmed on full sets, the most promising first, and only as long as they would join two components.

A large node that is one component is done. A dense one, whose classes mostly resemble each other, would hardly get smaller by
branching, as they share nearly all tokens. As the method prescribes for points that resemble most of their node, these
are compared with the whole node and leave the tree: where a component holds half of the node, only the other
classes with that component, once for all nodes. They meet in blocks, and there a pair must also agree in ``WIDE_AGREE`` of
``WIDE`` further places and is then compared in full at once. A block hands on only links that join two of its components, so it
gives fewer rows than it has classes, however many pairs are a little more or less similar than sought. Large nodes that together hold at
most ``FEW`` classes are compared in this way as well.

With 64 places and a cut of 38, a pair of similarity 0.8 passes the signature test with probability 0.99996. The trees
propose it with 0.9999 if its nodes are small after three levels, 0.998 after five, 0.973 after ten and 0.93 after
fourteen. All trees draw from the same places, so this is averaged over the number of places in which such a pair agrees.

Defined cases: null texts and texts without words have no shingles and are linked with nothing; a text with
fewer words than a shingle is one shingle; component_id is the smallest doc_id, nulls aside (null if all are
null), and ``kept`` compares null-safe; rows of one id are judged by their texts; extra columns are ignored;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnwatch.llm.shared import components, key_filter, passes, same_columns, short_batches, stored
from txnwatch.llm.words import array, list_column, mix, shingles, signed, texts, words

PLACES = 64
TREES = 14
SETTLE = 2
SMALL = 24
AGREE = 38
SALT = np.uint64(0xA24BAED4963EE407)
# A class resembles a pivot if they agree in LIKE places. Classes of a dense node meet in blocks of about BLOCK by BLOCK.
LIKE = 32
BLOCK = 256
BLOCK_WORDS = 1 << 18  # shingles of the sets of a block's side
FEW = 8192
WIDE = 1024
WIDE_AGREE = 768
_MULTIPLY = np.random.default_rng(11).integers(1, 1 << 62, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_MULTIPLY_WIDE = np.random.default_rng(12).integers(1, 1 << 62, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles, A-Z folded."""
    return np.unique(shingles(words(array(text), lower=True)[2], width))


def minwise(hashes: np.ndarray, multiply: np.ndarray = _MULTIPLY) -> np.ndarray:
    """One scrambled minimum per place."""
    least = np.full(len(multiply), np.iinfo(np.uint64).max, np.uint64)
    step = (1 << 18) // len(multiply)
    for at in range(0, len(hashes), step):
        least = np.minimum(least, (hashes[at : at + step, None] * multiply).min(0))
    return mix(least)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, t (hash of the text), n shingles, d1 and d2 (set digest), sig (a byte per place), roots."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            n, digest, sig, roots = [], [], [], []
            for text in texts(batch.column(2)):
                s = shingle_set(text, width)
                n.append(len(s))
                digest.append((mix(s).sum(dtype=np.uint64), mix(s ^ SALT).sum(dtype=np.uint64)))
                least = minwise(s)
                sig.append((least & np.uint64(255)).astype(np.uint8).tobytes())
                roots.append(signed(least[:TREES]))
            both = np.array(digest, np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()), batch.column(1), pa.array(n, pa.int64()), pa.array(signed(both[:, 0].copy())), pa.array(signed(both[:, 1].copy())),
                    pa.array(sig, pa.binary()), list_column(np.concatenate(roots) if roots else np.zeros(0, np.int64), np.full(len(n), TREES), pa.int64()),
                ],
                ["doc_id", "t", "n", "d1", "d2", "sig", "roots"],
            )

    shape = "doc_id long, t long, n long, d1 long, d2 long, sig binary, roots array<long>"
    return docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(run, shape)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PLACES)


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _rows(node: np.ndarray, cls: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(signed(node)), pa.array(cls), pa.array([x.tobytes() for x in sig], pa.binary())], ["node", "cls", "sig"]
    )


def _pairs(a: np.ndarray, b: np.ndarray, agree: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(agree.astype(np.int32))], ["a", "b", "agree"])


def wide_sketches(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """cls and full set to cls, ``WIDE`` bytes and the set."""
    for batch in batches:
        found = [minwise(np.asarray(w, np.int64).view(np.uint64), _MULTIPLY_WIDE) for w in (batch.column(1)[k].values.to_numpy() for k in range(batch.num_rows))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([(w & np.uint64(255)).astype(np.uint8).tobytes() for w in found], pa.binary()), batch.column(1)], ["cls", "wide", "words"])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Are two sets, sorted and without repeats, similar?"""
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def across(batches: Iterable[pa.RecordBatch], percent: int) -> Iterable[pa.RecordBatch]:
    """Links a, b that join components of a block. Rows (meet, side, twice, cls, root, sig, wide, words) come sorted by meet.

    ``twice``: both sides are the same classes, so each pair comes in two blocks.
    """

    def compare(meet, side, twice, cls, root, sig, wide, sets) -> Iterable[pa.RecordBatch]:
        ends = np.flatnonzero(np.diff(meet)) + 1
        for part in np.split(np.arange(len(meet)), ends):
            left, right = part[side[part] == 0], part[side[part] == 1]
            above: dict[int, int] = {}

            def top(x: int) -> int:
                while x in above:
                    above[x] = above.get(above[x], above[x])
                    x = above[x]
                return x

            found = []
            for at in range(0, len(left), 64):
                some = left[at : at + 64]
                i, j = np.nonzero((sig[some][:, None] == sig[right][None]).sum(2) >= AGREE)
                i, j = some[i], right[j]
                ask = (root[i] != root[j]) & ((cls[i] < cls[j]) | ~twice[i])
                i, j = i[ask], j[ask]
                for k in range(0, len(i), 4096):
                    x, y = i[k : k + 4096], j[k : k + 4096]
                    agree = (wide[x] == wide[y]).sum(1)
                    order = np.argsort(-agree, kind="stable")
                    for p, q in zip(x[order[agree[order] >= WIDE_AGREE]].tolist(), y[order[agree[order] >= WIDE_AGREE]].tolist(), strict=True):
                        u, v = top(int(root[p])), top(int(root[q]))
                        if u != v and similar(sets[p], sets[q], percent):
                            above[max(u, v)] = min(u, v)
                            found.append((int(cls[p]), int(cls[q])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    def columns(batch):
        wide = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(-1, WIDE)
        sets = np.empty(batch.num_rows, object)
        for k in range(batch.num_rows):
            sets[k] = batch.column(7)[k].values.to_numpy().view(np.uint64)
        return [*(_longs(batch.column(k)) for k in (0, 1)), _longs(batch.column(2)).astype(bool), *(_longs(batch.column(k)) for k in (3, 4)), _signatures(batch.column(5)), wide, sets]

    held = None
    for batch in batches:
        now = columns(batch)
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        yield from compare(*[x[:cut] for x in now])
        held = [x[cut:] for x in now]
    if held is not None:
        yield from compare(*held)


ROWS = "node long, cls long, sig binary"
PAIRS = "a long, b long, agree int"


def plant(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """The first node of every tree for each class: columns cls, sig, roots."""
    for batch in batches:
        cls, sig = _longs(batch.column(0)), _signatures(batch.column(1))
        roots = batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, TREES)
        for tree in range(TREES):
            yield _rows(mix(roots[:, tree] + np.uint64(tree + 1)), cls, sig)


def branch(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Move each class to the children of its node: one child, or two for a quarter of the nodes."""
    for batch in batches:
        node, cls, sig = _longs(batch.column(0)).view(np.uint64), _longs(batch.column(1)), _signatures(batch.column(2))
        for child in (0, 1):
            draw = mix(node ^ (SALT + np.uint64(child)))
            go = (draw & np.uint64(3)) == 0 if child else np.ones(len(node), bool)
            place = ((draw >> np.uint64(8)) % np.uint64(PLACES)).astype(np.int64)
            token = sig[np.arange(len(node)), place].astype(np.uint64)
            yield _rows(mix(mix(node + np.uint64(child)) + (place.astype(np.uint64) << np.uint64(8)) + token)[go], cls[go], sig[go])


def small_nodes(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Compare the classes of each node that are not of one component; rows come sorted by node, and nodes are small."""

    def compare(node: np.ndarray, cls: np.ndarray, sig: np.ndarray, root: np.ndarray) -> Iterable[pa.RecordBatch]:
        live, step = np.arange(len(node)), 0
        while len(live):
            step += 1
            live = live[live + step < len(node)]
            live = live[node[live] == node[live + step]]
            apart = live[root[live] != root[live + step]]
            agree = (sig[apart] == sig[apart + step]).sum(1)
            near = agree >= AGREE
            yield _pairs(cls[apart[near]], cls[apart[near] + step], agree[near])

    held = None
    for batch in batches:
        now = [_longs(batch.column(0)), _longs(batch.column(1)), _signatures(batch.column(2)), _longs(batch.column(3))]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        yield from compare(*[x[:cut] for x in now])
        held = [x[cut:] for x in now]
    if held is not None:
        yield from compare(*held)


def resembling(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """node, cls, sig, root, most, pivot: whether sig and the pivot's agree in ``LIKE`` places, as 0 or 1."""
    for batch in batches:
        near = (_signatures(batch.column(2)) == _signatures(batch.column(5))).sum(1) >= LIKE
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(near.astype(np.int32))], ["node", "cls", "sig", "root", "most", "near"])


def against(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Compare cls, sig, root with other, other_sig, other_root row by row, where the roots differ."""
    for batch in batches:
        cls, other = _longs(batch.column(0)), _longs(batch.column(3))
        agree = (_signatures(batch.column(1)) == _signatures(batch.column(4))).sum(1)
        near = (agree >= AGREE) & (_longs(batch.column(2)) != _longs(batch.column(5)))
        yield _pairs(cls[near], other[near], agree[near])


class Links:
    """Confirmed links among classes, and the components they make so far."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> None:
        self.docs, self.classes, self.width, self.percent = docs, classes, width, percent
        none = docs.sparkSession.createDataFrame([], "x long, y long")
        self.joined = False
        self.sets: DataFrame | None = None
        self.tried = none.select(F.col("x").alias("a"), F.col("y").alias("b"))
        self.groups = none.select(F.col("x").alias("node"), F.col("y").alias("root"))

    def load(self, pairs: DataFrame) -> None:
        """Read the full sets of the classes in ``pairs`` that are not there yet."""
        wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("cls"), "cls", "left_anti")
        where = stored(self.classes.join(wanted, "cls", "left_semi").select("cls", "at.*"), "where")
        if not where.isEmpty():
            with short_batches(self.docs.sparkSession):
                more = sets_of(self.docs, where, self.width)
            self.sets = more if self.sets is None else self.sets.union(more)

    def rooted(self, pairs: DataFrame) -> DataFrame:
        """Pairs with the components of their ends: columns ra and rb."""
        if not self.joined:
            return pairs.withColumns({"ra": F.col("a"), "rb": F.col("b")})
        side = lambda x: self.groups.select(F.col("node").alias(x), F.col("root").alias(f"_{x}"))
        both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        return both.withColumns({"ra": F.coalesce("_a", "a"), "rb": F.coalesce("_b", "b")}).drop("_a", "_b")

    def confirm(self, turn: DataFrame) -> None:
        """Compare the pairs in full and merge the components that links join."""
        self.tried = self.tried.union(turn.select("a", "b"))
        self.merge(confirmed(turn, self.sets, self.percent))

    def merge(self, pairs: DataFrame) -> None:
        """Merge the components that links join."""
        found = stored(self.rooted(pairs).filter("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
        if found.isEmpty():
            return
        # Only components are joined, so the graph is small after the first turn.
        merged = components(found).select(F.col("node").alias("old"), F.col("root").alias("new"))
        grown = self.groups.join(merged, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
        fresh = merged.select(F.col("old").alias("node"), F.col("new").alias("root")).join(self.groups.select("node"), "node", "left_anti")
        self.groups, self.joined = stored(grown.union(fresh), "groups"), True

    def advance(self, pairs: DataFrame) -> None:
        """Confirm candidates (a, b, agree) until none joins two components.

        First every class tries its most promising partner and the smallest one, which tends to be shared. Then
        pairs across components are compared, per pair of components the best 16, then all. What a turn has compared or
        joined is not looked at again.
        """
        self.load(pairs)
        if self.sets is None:
            return
        for take in (0, 16, None):
            open_ = self.rooted(pairs).filter("ra != rb").join(self.tried, ["a", "b"], "left_anti")
            if self.joined:
                open_ = stored(open_, "left")
                pairs = open_.drop("ra", "rb")
            if take == 0:
                ends = open_.select(F.col("a").alias("u"), F.col("b").alias("v"), "agree").union(open_.select("b", "a", "agree"))
                best = ends.groupBy("u").agg(F.max(F.struct("agree", (-F.col("v")).alias("v")))["v"].alias("x"), F.max(-F.col("v")).alias("y"))
                two = best.select("u", F.explode(F.array(-F.col("x"), -F.col("y"))).alias("v"))
                open_ = two.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
            elif take:
                by = W.partitionBy(F.least("ra", "rb"), F.greatest("ra", "rb")).orderBy(F.desc("agree"), "a", "b")
                open_ = open_.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= take)
            turn = stored(open_.select("a", "b"), "turn")
            if turn.isEmpty():
                return
            self.confirm(turn)

    def with_roots(self, rows: DataFrame) -> DataFrame:
        """Rows (node, cls, sig) with the component of their class, ``root``."""
        side = self.groups.select(F.col("node").alias("cls"), "root")
        return rows.join(side, "cls", "left").select("node", "cls", "sig", F.coalesce("root", "cls").alias("root"))

    def open_nodes(self, rows: DataFrame) -> DataFrame:
        """The rows (node, cls, sig) of nodes that hold more than one component, with their ``root``."""
        rooted = self.with_roots(rows)
        mixed = rooted.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("node")
        return rooted.join(mixed, "node", "left_semi").select("node", "cls", "sig", "root")

    def dense_nodes(self, rows: DataFrame) -> DataFrame:
        """Rows (node, cls, sig, root) with ``most``, a component that holds half of the node, and ``like``, whether at
        least half of the node's classes resemble one of them."""
        mark = F.xxhash64("cls", "node")
        counts = rows.groupBy("node", "root").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(mark.alias("mark"), "sig")).alias("pivot"))
        counts = counts.groupBy("node").agg(F.max(F.struct("count", "root")).alias("top"), F.sum("count").alias("all"), F.min("pivot")["sig"].alias("pivot"))
        most = F.when(F.col("top.count") * 2 >= F.col("all"), F.col("top.root"))
        marked = rows.join(counts.select("node", "pivot", most.alias("most")), "node").select("node", "cls", "sig", "root", "most", "pivot")
        marked = stored(marked.mapInArrow(resembling, ROWS + ", root long, most long, near int"), "marked")
        shares = marked.groupBy("node").agg((F.avg("near") >= 0.5).alias("like"))
        return marked.join(shares, "node").drop("near")

    def across_dense(self, dense: DataFrame) -> DataFrame:
        """Links (a, b) among the classes of dense nodes (columns node, cls, sig, root, most) that join what was not joined."""
        # Between a component and the other classes of its nodes, once for all nodes; else among all classes of the node.
        columns = ["cls", "sig", "root"]
        one = dense.filter("most is not null").select(
            F.xxhash64("most").alias("hall"), *columns, F.lit(False).alias("twice"), (F.col("root") == F.col("most")).cast("long").alias("side")
        )
        all_ = dense.filter("most is null").select(
            F.col("node").alias("hall"), *columns, F.lit(True).alias("twice"), F.explode(F.array(F.lit(0), F.lit(1)).cast("array<long>")).alias("side")
        )
        sides = stored(one.dropDuplicates(["hall", "cls"]).union(all_), "sides")
        self.load(sides.select(F.col("cls").alias("a"), F.col("cls").alias("b")))
        wide = self.sets.join(sides.select("cls").distinct(), "cls", "left_semi").select("cls", "words")
        wide = stored(wide.mapInArrow(wide_sketches, "cls long, wide binary, words array<long>"), "wide")
        sides = sides.join(wide.select("cls", F.size("words").alias("len")), "cls")
        # Blocks of bounded numbers of classes and of shingles.
        here = lambda side: F.when(F.col("side") == side, F.col("len"))
        cut = lambda side: F.ceil(F.greatest(F.count(here(side)) / F.lit(BLOCK), F.sum(here(side)) / F.lit(BLOCK_WORDS))).cast("int")
        cuts = sides.groupBy("hall").agg(cut(0).alias("lefts"), cut(1).alias("rights")).filter("lefts > 0 and rights > 0")
        # Each row meets every block of the other side.
        left = F.col("side") == 0
        own = F.pmod(F.xxhash64("cls"), F.when(left, F.col("lefts")).otherwise(F.col("rights")))
        other = F.explode(F.sequence(F.lit(0), F.when(left, F.col("rights")).otherwise(F.col("lefts")) - 1).cast("array<long>"))
        rows = sides.join(cuts, "hall").withColumn("own", own).withColumn("other", other)
        meet = F.xxhash64("hall", F.when(left, F.col("own")).otherwise(F.col("other")), F.when(left, F.col("other")).otherwise(F.col("own")))
        full = rows.join(wide, "cls").select(meet.alias("meet"), "side", F.col("twice").cast("long").alias("twice"), "cls", "root", "sig", "wide", "words")
        return full.repartition("meet").sortWithinPartitions("meet").mapInArrow(lambda b, percent=self.percent: across(b, percent), "a long, b long")


def link_classes(classes: DataFrame, links: Links) -> None:
    """Walk the trees level by level, until no node is large, and confirm what the nodes propose.

    After level ``SETTLE`` candidates are confirmed once, and from then on large nodes that are, or are nearly, one
    component are left aside, so a big group of near copies does not go down the trees again and again.
    """
    rows = stored(classes.select("cls", "sig", "roots").mapInArrow(plant, ROWS), "level")
    proposed: list[DataFrame] = []
    dense: list[DataFrame] = []
    level = 0
    while True:
        level += 1
        # Of the two pivots one has the least mark wherever it is, so a big group has nearly the same one in all its nodes.
        mark, low = F.xxhash64("cls", "node"), F.xxhash64("cls")
        # Until candidates are confirmed, each class is a component. Later nodes that are one component propose nothing, and
        # the others only pairs across components.
        rooted = links.with_roots(rows) if level > SETTLE else rows.withColumn("root", F.col("cls"))
        counts = rooted.groupBy("node").agg(
            F.count(F.lit(1)).alias("size"), F.min(low).alias("low"), F.max(mark).alias("high"), F.min("root").alias("least"), F.max("root").alias("most")
        )
        crowd = stored(rooted.join(counts.filter("least != most").drop("least", "most"), "node"), "crowd")
        few = crowd.filter(F.col("size") <= SMALL).select("node", "cls", "sig", "root")
        large = crowd.filter(F.col("size") > SMALL)
        pivots = large.filter((low == F.col("low")) | (mark == F.col("high"))).select(
            "node", F.col("cls").alias("other"), F.col("sig").alias("other_sig"), F.col("root").alias("other_root")
        )
        large = large.select("node", "cls", "sig", "root")
        met = large.join(pivots, "node").select("cls", "sig", "root", "other", "other_sig", "other_root")
        # Written level by level: one plan for all levels would be too large for the driver.
        proposed.append(stored(met.mapInArrow(against, PAIRS).union(compared(few)).distinct(), "pairs"))
        if level == SETTLE:
            links.advance(stored(union_of(proposed).distinct(), "pairs"))
            # These are all compared or within a component now.
            proposed = []
        if level >= SETTLE:
            judged = stored(links.dense_nodes(links.open_nodes(large.drop("root")) if level == SETTLE else large), "judged")
            dense.append(judged.filter("like or most is not null").drop("like"))
            large = judged.filter("not like and most is null").drop("like")
            # What a component leaves behind stays in its node for one more level: compared there if it is small now.
            odd = judged.filter("most is not null and root != most").drop("like").withColumn("most", F.lit(None).cast("long"))
            rest = large.union(odd)
            if rest.limit(FEW + 1).count() <= FEW:
                dense.append(rest)
                break
            rows = stored(large.select("node", "cls", "sig").mapInArrow(branch, ROWS).union(odd.select("node", "cls", "sig")), "level")
        else:
            rows = stored(large.drop("root").mapInArrow(branch, ROWS), "level")
        if rows.isEmpty():
            break
    if dense:
        meeting = stored(union_of(dense), "dense")
        if not meeting.isEmpty():
            with short_batches(classes.sparkSession):
                links.merge(links.across_dense(meeting))
    if proposed:
        links.advance(stored(union_of(proposed).distinct(), "pairs"))


def compared(rows: DataFrame) -> DataFrame:
    """Candidates of small nodes."""
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(small_nodes, PAIRS)


def union_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.union(b), parts)


def sets_of(docs: DataFrame, where: DataFrame, width: int) -> DataFrame:
    """The full sets of the classes in ``where`` (cls, doc_id, t), from one document of each: cls and sorted hashes."""
    table = key_filter(where.select(F.col("t").alias("key")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            place = np.flatnonzero(passes(table.value, _longs(batch.column(1))))
            if not len(place):
                continue
            part = batch.take(pa.array(place))
            sets = [shingle_set(text, width) for text in texts(part.column(2))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), part.column(1), list_column(signed(np.concatenate(sets)), np.array([len(s) for s in sets]), pa.int64())],
                ["doc_id", "t", "words"],
            )

    sets = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, "doc_id long, t long, words array<long>")
    sets = sets.select(F.col("doc_id").alias("d"), F.col("t").alias("key"), "words")
    one = where.join(sets, (F.col("t") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("d")))
    return stored(one.select("cls", "words").dropDuplicates(["cls"]), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar."""
    both = pairs.select("a", "b").join(sets.select(F.col("cls").alias("a"), F.col("words").alias("wa")), "a")
    both = both.join(sets.select(F.col("cls").alias("b"), F.col("words").alias("wb")), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    return both.filter(100 * common >= percent * (F.size("wa") + F.size("wb") - common)).select("a", "b")


def grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``near_duplicates`` with ``chosen``: is the row the first of its component by doc_id, nulls last, and text hash."""
    base = same_columns(docs, ["doc_id", "text"])
    with short_batches(docs.sparkSession):
        prints = stored(sketches(base, width), "sketches")
    at = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")
    classes = prints.filter("n > 0").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("label"), F.min(at).alias("at"), F.first("sig").alias("sig"), F.first("roots").alias("roots")
    )
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    links = Links(base, classes, width, percent)
    link_classes(classes, links)
    groups = links.groups
    named = classes.select("cls", "label", "at", "d1", "d2").join(groups, F.col("cls") == F.col("node"))
    least = named.groupBy("root").agg(F.min("label").alias("least"), F.min("at").alias("top"))
    moved = named.join(least, "root").select("d1", "d2", "least", "top")
    labels = classes.select("d1", "d2", "label", "at").join(moved, ["d1", "d2"], "left").select(
        "d1", "d2", F.coalesce("least", "label").alias("component"), F.coalesce("top", "at").alias("top")
    )
    joined = prints.select("doc_id", "t", "n", "d1", "d2").join(labels, ["d1", "d2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return joined.select(
        "doc_id", "t", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
        at.eqNullSafe(F.col("top")).alias("chosen"),
    )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, t (hash of the text), n_shingles, component_id and kept."""
    return grouped(docs, width, percent).drop("chosen")


def component_report(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    return near_duplicates(docs, width, percent).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one left of each group, all columns kept; of repeated rows of one id and text, one.

    The smallest doc_id stays, nulls last; of different texts with that id, the one with the smallest hash.
    """
    found = grouped(docs, width, percent).filter("chosen and n_shingles > 0").select(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col("text")).alias("_key"))
    blank = ~F.coalesce(F.col("row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    same = (F.col("_key") == F.col("_t")) & F.col("row.doc_id").eqNullSafe(F.col("_d"))
    full = rows.filter(~blank).join(found, same, "left_semi")
    # Only rows that share id and text can repeat; they are reduced by those two.
    full = full.select("row", "_key", F.col("row.doc_id").alias("_id")).dropDuplicates(["_id", "_key"]).select("row")
    return full.union(rows.filter(blank).select("row")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
