"""Benchmark decontamination by SimHash of item-sized windows.

For every benchmark item of n words the windows of n words of a text get a 64-bit SimHash of their weighted
word shingles. Fingerprints are cut into ``BLOCKS`` blocks; two fingerprints that differ in at most ``RADIUS``
bits differ in at most ``RADIUS // BLOCKS`` bits in some block, so tables of the items by block value find
every item within the radius. The candidates are then compared exactly: weighted Jaccard of the shingle
multisets, a shingle weighing as many points as its words have bytes, so long words count more than short ones.

Both sides are lower-cased. Windows that hold no shingle of any item have similarity 0 and are skipped before hashing. The benchmark is a
stated query set: it is read in groups of about ``ITEMS`` items, each group is sent to all tasks and meets all
documents in one pass.

Defined cases: a null or wordless text matches nothing; a text shorter than an item is its only window; items
without words are never found, items shorter than a shingle are one shingle; equal items are all reported;
rows are judged one by one, so repeated rows agree; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.shared import same_columns
from txnwatch.llm.words import array, blocks, list_column, mix, shingles, texts, words

BITS = 64
BLOCKS = 8
RADIUS = 23
ITEMS = 20_000
MASK = (1 << 20) - 1


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """Signs +1 and -1 by hash bit."""
    bytes_ = mix(hashes ^ np.uint64(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(bytes_, axis=1).astype(np.float64) * 2 - 1


def pack(votes: np.ndarray) -> np.ndarray:
    """Votes per bit to fingerprints, one byte per block."""
    return np.packbits(votes > 0, axis=1)


def sizes_of(lengths: np.ndarray, width: int) -> np.ndarray:
    """Bytes of the words of each shingle."""
    run = np.concatenate([[0], np.cumsum(lengths)])
    k = min(width, len(lengths))
    return (run[k:] - run[: len(run) - k]).astype(np.float64)


class Index:
    """The items of one group: their shingles, and block tables by item length."""

    def __init__(self, items: list[tuple[int, bytes]], width: int) -> None:
        self.width = width
        self.ids, self.n, self.sets = [], [], []
        self.weight: dict[int, float] = {}
        for item, text in items:
            starts, ends, h = words(array(text), lower=True)
            if len(h):
                self.ids.append(item)
                self.n.append(len(h))
                found = shingles(h, width).tolist()
                self.sets.append(Counter(found))
                self.weight.update(zip(found, sizes_of(ends - starts, width).tolist(), strict=True))
        self.lengths: dict[int, np.ndarray] = {}
        for k, n in enumerate(self.n):
            self.lengths.setdefault(n, []).append(k)
        self.holders: dict[int, set[int]] = {}
        for k, c in enumerate(self.sets):
            for s in c:
                self.holders.setdefault(s, set()).add(self.n[k])
        self.known = {}
        self.prints, self.near = {}, {}
        flips = [0] + [1 << i for i in range(8)] + [(1 << i) | (1 << j) for i in range(8) for j in range(i)]
        for n, members in self.lengths.items():
            prints = np.concatenate([pack(self.vote(self.sets[k])[None]) for k in members])
            near = np.zeros((BLOCKS, 256, -(-len(members) // 8)), np.uint8)
            for at, row in enumerate(prints):
                for block, value in enumerate(row):
                    near[block, [int(value) ^ f for f in flips], at >> 3] |= 1 << (at & 7)
            self.prints[n], self.near[n] = prints, near
        # Sorted shingles and a bit table in front of them, by shingle width (short items have narrower ones).
        for w in {min(width, n) for n in self.n}:
            keys = np.unique(np.array([s for k, c in enumerate(self.sets) if min(width, self.n[k]) == w for s in c], np.uint64))
            table = np.zeros(MASK + 1, bool)
            table[(keys & np.uint64(MASK)).astype(np.int64)] = True
            self.known[w] = (keys, table)

    def vote(self, counts: Counter) -> np.ndarray:
        keys = np.array(list(counts), np.uint64)
        size = np.array([counts[s] * self.weight[s] for s in counts])
        return (bits_of(keys) * size[:, None]).sum(0)

    def hits(self, s: np.ndarray, w: int) -> np.ndarray:
        """Positions of shingles that some item of that shingle width holds."""
        keys, table = self.known[w]
        at = np.flatnonzero(table[(s & np.uint64(MASK)).view(np.int64)])
        found = np.searchsorted(keys, s[at])
        return at[(found < len(keys)) & (keys[np.minimum(found, len(keys) - 1)] == s[at])]

    def similarity(self, window: np.ndarray, sizes: np.ndarray, item: int) -> float:
        have, want = Counter(window.tolist()), self.sets[item]
        weight = dict(zip(window.tolist(), sizes.tolist(), strict=True))
        both = either = 0.0
        for s in have.keys() | want.keys():
            w = weight[s] if s in weight else self.weight[s]
            a, b = have.get(s, 0), want.get(s, 0)
            both, either = both + w * min(a, b), either + w * max(a, b)
        return both / either

    def search(self, hashes: np.ndarray, lengths: np.ndarray, least: float) -> dict[int, tuple[float, int]]:
        """For each item found in a text (its word hashes and lengths): best similarity and first word of that window."""
        out: dict[int, tuple[float, int]] = {}
        total = len(hashes)
        for w in self.known:
            s = shingles(hashes, w) if total >= w else shingles(hashes, total)
            at = self.hits(s, w)
            if not len(at):
                continue
            sizes = sizes_of(lengths, w)
            for n in sorted(set().union(*(self.holders[x] for x in set(s[at].tolist())))):
                if min(self.width, n) != w:
                    continue
                inside = max(1, n - w + 1)  # shingles of a window
                last = max(0, len(s) - inside)
                # Every window with at least one hit.
                step = np.zeros(last + 2, np.int64)
                np.add.at(step, np.minimum(np.maximum(0, at - inside + 1), last), 1)
                np.add.at(step, np.minimum(at, last) + 1, -1)
                starts = np.flatnonzero(np.cumsum(step)[:-1] > 0)
                for k in range(0, len(starts), 4096):
                    self._compare(s, sizes, starts[k : k + 4096], inside, n, least, out)
        return out

    def _compare(self, s: np.ndarray, sizes: np.ndarray, starts: np.ndarray, inside: int, n: int, least: float, out: dict) -> None:
        low, high = int(starts[0]), min(len(s), int(starts[-1]) + inside)
        part, size = s[low:high], sizes[low:high]
        run = np.zeros((len(part) + 1, BITS))
        np.cumsum(bits_of(part) * size[:, None], axis=0, out=run[1:])
        ends = np.minimum(starts + inside, len(s))
        prints = pack(run[ends - low] - run[starts - low])
        near = self.near[n][0, prints[:, 0]]
        for block in range(1, BLOCKS):
            near = near | self.near[n][block, prints[:, block]]
        members = self.lengths[n]
        window, member = np.nonzero(np.unpackbits(near, axis=1, bitorder="little")[:, : len(members)])
        apart = np.bitwise_count(prints[window] ^ self.prints[n][member]).sum(1)
        order = np.lexsort((starts[window], apart))
        for k in order[apart[order] <= RADIUS]:
            item, start = members[member[k]], int(starts[window[k]])
            best = out.get(item)
            if best and best[0] >= 1.0:
                continue
            found = self.similarity(s[start : start + inside], sizes[start : start + inside], item)
            if found >= least and (best is None or (-found, start) < (-best[0], best[1])):
                out[item] = (found, start)


def found_items(docs: DataFrame, benchmark: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """Per row of ``docs`` (doc_id, t, lower-case text): doc_id, t and the arrays items, scores and starts (first words)."""
    items = same_columns(benchmark, ["item_id", "text"]).withColumn("text", F.lower("text")).filter("item_id is not null and text is not null")
    groups = max(1, -(-items.count() // ITEMS))
    parts = []
    for k in range(groups):
        group = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == k).orderBy("item_id", "text").collect()
        sent = docs.sparkSession.sparkContext.broadcast([(int(r["item_id"]), r["text"].encode()) for r in group])
        parts.append(docs.mapInArrow(_finder(sent, width, least), "doc_id long, t long, items array<long>, scores array<double>, starts array<long>"))
    if groups == 1:
        return parts[0]
    # Equal rows find the same items: what each distinct text finds is merged over the groups, then given to every row.
    every = None
    for part in parts:
        hits = part.filter("size(items) > 0").dropDuplicates(["doc_id", "t"])
        every = hits if every is None else every.union(hits)
    merged = every.groupBy(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).agg(
        F.flatten(F.collect_list("items")).alias("items"),
        F.flatten(F.collect_list("scores")).alias("scores"),
        F.flatten(F.collect_list("starts")).alias("starts"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t"))
    lists = [F.coalesce(c, F.array().cast(merged.schema[c].dataType)).alias(c) for c in ("items", "scores", "starts")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "t").join(merged, same, "left").select("doc_id", "t", *lists)


def _finder(sent, width: int, least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        index = Index(sent.value, width)
        for batch in batches:
            rows = texts(batch.column(2))
            found: list[dict[int, tuple[float, int]]] = [{} for _ in rows]
            for first, buf, begin in blocks(rows):
                starts, ends, hashes = words(buf, lower=True)
                if not len(hashes):
                    continue
                doc = np.searchsorted(begin, starts, "right") - 1
                edge = np.searchsorted(doc, np.arange(len(begin) + 1))
                chosen: set[int] = set()
                for w in index.known:
                    at = index.hits(shingles(hashes, w), w) if len(hashes) >= w else np.zeros(0, np.int64)
                    chosen.update(doc[at[doc[at] == doc[np.minimum(at + w - 1, len(doc) - 1)]]].tolist())
                for k in chosen:
                    found[first + k] = index.search(hashes[edge[k] : edge[k + 1]], (ends - starts)[edge[k] : edge[k + 1]], least)
            flat = [sorted((index.ids[i], score, start) for i, (score, start) in f.items()) for f in found]
            size = np.array([len(f) for f in flat], np.int64)
            column = lambda k, kind: np.array([x[k] for f in flat for x in f], kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()), batch.column(1), list_column(column(0, np.int64), size, pa.int64()),
                    list_column(column(1, np.float64), size, pa.float64()), list_column(column(2, np.int64), size, pa.int64()),
                ],
                ["doc_id", "t", "items", "scores", "starts"],
            )

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return same_columns(docs, ["doc_id", "text"]).select("doc_id", F.xxhash64("text").alias("t"), F.lower("text").alias("text"))


def leak_report(docs: DataFrame, benchmark: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document: doc_id, kept (no item found), n_items, item_ids and the best similarity."""
    found = found_items(_keyed(docs), benchmark, width, least)
    return found.select(
        "doc_id",
        (F.size("items") == 0).alias("kept"),
        F.size("items").cast("long").alias("n_items"),
        F.array_sort("items").alias("item_ids"),
        F.array_max("scores").alias("similarity"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """The documents in which no item is found, all columns kept."""
    leaks = found_items(_keyed(docs), benchmark, width, least).filter("size(items) > 0").select(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col("text")).alias("_key"))
    same = (F.col("_key") == F.col("_t")) & F.col("row.doc_id").eqNullSafe(F.col("_d"))
    return rows.join(leaks, same, "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
