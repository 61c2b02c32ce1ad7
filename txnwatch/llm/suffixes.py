"""Removal of repeated byte strings by deep-shallow suffix sorting of anchored suffixes.

A byte goes if a string of ``SPAN`` bytes that covers it starts anywhere else in the corpus as well.

Not every suffix is sorted. Each string of ``SPAN`` bytes has an anchor, the place of the smallest hash among
its ``GRAM``-byte pieces, which its content alone decides; equal strings have equal anchors at equal offsets. One
anchor serves a range of neighbouring string starts, about 150. Anchors whose piece is unique, or whose whole
surroundings (all strings of the range) are shared as they are, are settled by counting hashes. What remains are
anchors near the ends of repeated passages. They are grouped by piece, and in each group the suffixes
that begin at the anchors, and the reversed prefixes that end there, are put in order by deep-shallow sorting:
multikey quicksort on 8-byte digits down to ``SHALLOW`` bytes, then blind tries for suffixes that agree so
far. Common prefixes of neighbours in both orders tell how far each pair agrees to the right and to the left.

A group with more than ``BIG`` different surroundings is not sorted in one task: the strings of its anchors are
counted one by one by their hash instead, which finds the same ranges and spreads over all tasks.

Defined cases: a null or empty text has no bytes and loses none; texts below ``SPAN`` bytes lose none; strings never
cross texts; equal texts of at least ``SPAN`` bytes lose everything, repeated rows included; extra columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.shared import filtered, key_filter, may_be_in, same_columns, short_batches, stored
from txnwatch.llm.words import array, list_column, mix, signed, span_hash, sums, texts

SPAN = 400
GRAM = 100
SHALLOW = 32
BIG = 1024
PIECE = 1 << 19  # string starts that are handled at once
PLACE_BITS = 20
KEYS = "doc_id long, t long, u long"


def anchors_of(buf: np.ndarray, piece: int = PIECE) -> Iterable[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of a text: offset, anchors, first and last string start of each, hashes of piece and surroundings."""
    window = SPAN - GRAM + 1
    low = np.uint64((1 << PLACE_BITS) - 1)
    for at in range(0, len(buf) - SPAN + 1, piece):
        part = buf[at : at + piece + SPAN - 1]
        run = sums(part)
        place = np.arange(len(part) - GRAM + 1)
        grams = span_hash(run, place, place + GRAM)
        # Smallest hash of each window; the first of equal ones.
        rank = (grams & ~low) | place.astype(np.uint64)
        fill = -len(rank) % window
        grid = np.concatenate([rank, np.full(fill, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, window)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(part) - SPAN + 1
        anchor = (np.minimum(behind[:n], ahead[window - 1 : window - 1 + n]) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:], n) - 1
        own = anchor[first]
        around = mix(span_hash(run, first, last + SPAN) + (own - first).astype(np.uint64))
        yield at, own, first, last, grams[own], around


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to be at least ``at``."""
    high = min(len(a), len(b))
    if a[at:high] == b[at:high]:
        return high
    while high - at > 1:
        middle = (at + high) // 2
        if a[at:middle] == b[at:middle]:
            at = middle
        else:
            high = middle
    return at


def blind_trie(items: Sequence[bytes], group: list[int], depth: int) -> list[int]:
    """Order strings that agree on their first ``depth`` bytes.

    Inner nodes keep only the depth and the branching bytes. A string goes down by those bytes to some leaf, is
    compared once with that leaf, and then hung where the comparison says.
    """
    byte = lambda s, d: s[d] if d < len(s) else -1
    root: list | int = group[0]
    for k in group[1:]:
        s, node = items[k], root
        while isinstance(node, list):
            node = node[1].get(byte(s, node[0])) if byte(s, node[0]) in node[1] else next(iter(node[1].values()))
        d = common(s, items[node if isinstance(node, int) else node[0]], depth)
        other = items[node]
        parent, node = None, root
        while isinstance(node, list) and node[0] < d:
            parent, node = node, node[1][byte(s, node[0])]
        if isinstance(node, list) and node[0] == d:
            c = byte(s, d)
            if c in node[1]:  # equal to the end: keep both under one leaf
                node[1][c] = [len(s), {-1: node[1][c], -2: k}] if isinstance(node[1][c], int) else node[1][c]
                if isinstance(node[1][c], list) and k not in node[1][c][1].values():
                    node[1][c][1][-len(node[1][c][1]) - 1] = k
            else:
                node[1][c] = k
            continue
        mine, theirs = byte(s, d), byte(other, d)
        if mine == theirs:  # equal strings
            mine = -2
        new = [d, {theirs: node, mine: k}]
        if parent is None:
            root = new
        else:
            parent[1][byte(s, parent[0])] = new
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            out.append(node)
        else:
            stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
    return out


def deep_shallow(items: Sequence[bytes], shallow: int = SHALLOW) -> list[int]:
    """Positions of the strings in sorted order."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(items))), 0)]
    while stack:
        group, d = stack.pop()
        if len(group) == 1:
            out.append(group[0])
        elif d >= shallow:
            out.extend(blind_trie(items, group, d))
        else:
            digits = [items[k][d : d + 8] for k in group]
            pivot = sorted((digits[0], digits[len(digits) // 2], digits[-1]))[1]
            parts: tuple[list[int], list[int], list[int]] = ([], [], [])
            for k, digit in zip(group, digits, strict=True):
                parts[(digit >= pivot) + (digit > pivot)].append(k)
            if parts[2]:
                stack.append((parts[2], d))
            # A short digit means that the strings end here.
            stack.append((parts[1], d + 8 if len(pivot) == 8 else shallow))
            if parts[0]:
                stack.append((parts[0], d))
    return out


def reaches(rights: list[bytes], lefts: list[bytes], same: np.ndarray) -> list[tuple[int, int, int]]:
    """Members with a repeated string, and the smallest and largest offset of the anchor in such a string.

    ``rights`` are the bytes from the anchor on, ``lefts`` the bytes before it, reversed. Members with equal
    ``same`` are one place of one text and do not count for each other.
    """
    n = len(rights)
    order = [deep_shallow(x) for x in (rights, lefts)]
    near = [np.array([common(x[o[k]], x[o[k + 1]]) for k in range(n - 1)] + [0], np.int64) for x, o in zip((rights, lefts), order, strict=True)]
    rank = [np.argsort(o) for o in order]
    out = []
    for k in range(n):
        agree = []
        for o, lcp, r in zip(order, near, rank, strict=True):
            at = r[k]
            row = np.zeros(n, np.int64)
            row[at + 1 :] = np.minimum.accumulate(lcp[at : n - 1])
            row[:at] = np.minimum.accumulate(lcp[:at][::-1])[::-1]
            back = np.empty(n, np.int64)
            back[o] = row
            agree.append(back)
        ok = (agree[0] + agree[1] >= SPAN) & (same != same[k])
        if ok.any():
            out.append((k, int((SPAN - agree[0][ok]).min()), int(agree[1][ok].max())))
    return out


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, two hashes of the text, the text."""
    base = same_columns(docs, ["doc_id", "text"])
    return base.select("doc_id", F.xxhash64("text").alias("t"), F.xxhash64(F.lit(7), "text").alias("u"), "text")


def all_anchors(docs: DataFrame) -> DataFrame:
    piece = PIECE

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            # Texts are gathered to some megabytes of anchors before they are handed on.
            held: list[list[np.ndarray]] = []
            total = 0
            rows = texts(batch.column(3))
            for row, text in enumerate(rows):
                if text is not None and len(text) >= SPAN:
                    for at, own, first, last, gram, around in anchors_of(array(text), piece):
                        held.append([np.full(len(own), row), own + at, first + at, last + at, signed(gram), signed(around)])
                        total += len(own)
                if held and (total > 1 << 16 or row == len(rows) - 1):
                    one, *columns = (np.concatenate(x) for x in zip(*held, strict=True))
                    place = pa.array(one)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).cast(pa.int64()).take(place), batch.column(1).take(place), batch.column(2).take(place), *map(pa.array, columns)],
                        ["doc_id", "t", "u", "anchor", "first", "last", "gram", "around"],
                    )
                    held, total = [], 0

    return docs.mapInArrow(run, f"{KEYS}, anchor long, first long, last long, gram long, around long")


def surroundings(docs: DataFrame, contested: DataFrame) -> DataFrame:
    """The bytes around one anchor of each contested class: right from the anchor on, left reversed."""
    wanted = contested.groupBy("doc_id", "t", "u").agg(F.collect_list(F.struct("anchor", "first", "last", "gram", "around", "n", "size")).alias("all"))
    wanted = stored(wanted.select(F.col("doc_id").alias("d"), F.col("t").alias("t1"), F.col("u").alias("u1"), "all"), "wanted")
    some = filtered(docs, "t", key_filter(wanted.select(F.col("t1").alias("key"))))
    same = (F.col("t") == F.col("t1")) & (F.col("u") == F.col("u1")) & F.col("doc_id").eqNullSafe(F.col("d"))
    joined = some.join(wanted, same).select("t", "text", "all")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for row, (t, text) in enumerate(zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True)):
                these = batch.column(2)[row].as_py()
                for at in range(0, len(these), 4096):
                    part = these[at : at + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([x["gram"] for x in part], pa.int64()), pa.array([x["around"] for x in part], pa.int64()),
                            pa.array([x["n"] for x in part], pa.int64()), pa.array([x["size"] for x in part], pa.int64()), pa.array([t] * len(part), pa.int64()),
                            pa.array([x["anchor"] for x in part], pa.int64()),
                            pa.array([text[x["first"] : x["anchor"]][::-1] for x in part], pa.binary()),
                            pa.array([text[x["anchor"] : x["last"] + SPAN] for x in part], pa.binary()),
                        ],
                        ["gram", "around", "n", "size", "t", "anchor", "left", "right"],
                    )

    return joined.mapInArrow(run, "gram long, around long, n long, size long, t long, anchor long, left binary, right binary")


FOUND = "gram long, around long, least int, most int"


def sorted_groups(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Ranges of the members of each group; rows come sorted by (gram, around), groups hold at most ``BIG``."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        gram, around = _longs(table.column("gram").combine_chunks()), _longs(table.column("around").combine_chunks())
        same = np.array([hash(x) for x in zip(table.column("t").to_pylist(), table.column("anchor").to_pylist(), strict=True)], np.int64)
        left, right = table.column("left").to_pylist(), table.column("right").to_pylist()
        cuts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1], [True]])).tolist()
        rows: list[tuple[int, int, int]] = []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            # A class can come twice if rows of the table are repeated.
            keep = [k for k in range(low, high) if k == low or around[k] != around[k - 1]]
            if len(keep) == 2:
                a, b = keep
                r, f = common(right[a], right[b]), common(left[a], left[b])
                if r + f >= SPAN and same[a] != same[b]:
                    rows += [(a, SPAN - r, f), (b, SPAN - r, f)]
            elif len(keep) > 2:
                for k, least, most in reaches([right[x] for x in keep], [left[x] for x in keep], same[keep]):
                    rows.append((keep[k], least, most))
        at = np.array([r[0] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(gram[at]), pa.array(around[at]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())],
            ["gram", "around", "least", "most"],
        )

    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        if held is not None:
            now = pa.concat_tables([held, now])
        gram = _longs(now.column("gram").combine_chunks())
        cut = int(np.searchsorted(gram, gram[-1])) if len(gram) else 0
        if cut:
            yield solve(now.slice(0, cut))
        held = now.slice(cut)
    if held is not None and held.num_rows:
        yield solve(held)


def counted_groups(rows: DataFrame) -> DataFrame:
    """The same ranges for large groups: every string of every member is counted by its hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            offsets, hashes, size = [], [], []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                buf = array(left[::-1] + right)
                starts = np.arange(len(buf) - SPAN + 1)
                hashes.append(span_hash(sums(buf), starts, starts + SPAN))
                offsets.append(len(left) - starts)
                size.append(len(starts))
            n = np.array(size, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), list_column(np.concatenate(offsets).astype(np.int32), n, pa.int32()),
                    list_column(signed(np.concatenate(hashes)), n, pa.int64()),
                ],
                ["gram", "around", "offsets", "hashes"],
            )

    each = rows.dropDuplicates(["gram", "around"]).select("gram", "around", "left", "right")
    each = each.mapInArrow(run, "gram long, around long, offsets array<int>, hashes array<long>")
    each = each.select("gram", "around", F.explode(F.arrays_zip("offsets", "hashes")).alias("x")).select("gram", "around", "x.offsets", "x.hashes")
    each = stored(each, "strings")
    twice = each.groupBy("gram", "hashes").count().filter("count > 1").select("gram", "hashes")
    return each.join(twice, ["gram", "hashes"], "left_semi").groupBy("gram", "around").agg(F.min("offsets").alias("least"), F.max("offsets").alias("most"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Per text (t, u) its ``spans``, an array of (low, high): overlapping, unordered, each repeated elsewhere."""
    with short_batches(docs.sparkSession):
        every = stored(all_anchors(docs), "anchors")
    pieces = every.groupBy("gram").count().filter("count > 1").select(F.col("gram").alias("key"))
    live = filtered(every, "gram", key_filter(pieces))
    at = F.struct(F.col("doc_id").isNull().alias("last_"), "doc_id", "t", "u", "anchor", "first", "last")
    classes = stored(live.groupBy("gram", "around").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("at")), "classes")
    sizes = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    contested = classes.select("gram", "around", "n", "at.*").join(sizes, "gram")
    with short_batches(docs.sparkSession):
        rows = stored(surroundings(docs, contested), "surroundings")
    some = rows.filter(F.col("size") <= BIG).repartition("gram").sortWithinPartitions("gram", "around").mapInArrow(sorted_groups, FOUND)
    found = some.union(counted_groups(rows.filter(F.col("size") > BIG)).select("gram", "around", "least", "most"))
    one = classes.filter("n = 1").select("gram", "around", "at.t", "at.u", "at.anchor")
    part = one.join(found, ["gram", "around"]).select("t", "u", (F.col("anchor") - F.col("most")).alias("low"), (F.col("anchor") - F.col("least") + SPAN).alias("high"))
    whole = live.join(classes.filter("n > 1").select("gram", "around"), ["gram", "around"], "left_semi")
    whole = whole.select("t", "u", F.col("first").alias("low"), (F.col("last") + SPAN).alias("high"))
    return part.union(whole).distinct().groupBy("t", "u").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, ``runs`` removed (low, high) and ``kept``, the bytes that remain."""
    rows = keyed(docs)
    spans = stored(repeated_spans(rows), "spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                runs, kept, size = [], [], []
                for text, found in zip(texts(part.column(1)), part.column(2).to_pylist(), strict=True):
                    text, here = text or b"", merged(found or [])
                    edges = [0, *(x for r in here for x in r), len(text)]
                    runs.append([{"low": a, "high": b} for a, b in here])
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    size.append(len(text))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(runs, shape), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "runs", "kept"]
                )

    # Texts without spans need no join, stay where they are and keep all bytes.
    may = may_be_in(key_filter(spans.select(F.col("t").alias("key"))))
    kind = "array<struct<low:long,high:long>>"
    touched = rows.filter(may("t")).join(spans, ["t", "u"], "left").select("doc_id", "text", "spans")
    touched = touched.mapInArrow(run, f"doc_id long, n_bytes long, runs {kind}, kept binary")
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    clean = rows.filter(~may("t")).select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), F.array().cast(kind).alias("runs"), whole.alias("kept"))
    return touched.union(clean)


def repeat_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    found = remove_repeats(docs)
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda total, r: total + r["high"] - r["low"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
