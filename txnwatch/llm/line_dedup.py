"""Line dedup by an exact set-similarity join.

A line is the set of its words (A-Z folded). The words of a line are ordered by rarity; two sets with Jaccard
similarity of at least the bound share a word among the first few of each (prefix filter), at places that leave
room for enough common words (positional filter), and have similar sizes (length filter). A parity map of the
words (64 bits, 128 or 256 for long lines) bounds their difference, so few pairs are left for the exact comparison. A
line goes when an earlier line, by (doc_id, text hash, line number), is equal or similar to it; it does not matter
whether that one goes as well. A line of n words can resemble a different one only if n / (n + 1) reaches the bound (four
words at 80 percent); shorter ones can only be equal.

One earlier line is enough, so a line does not meet all lines like it: per prefix word it stops looking once it has
``SURE`` earlier candidates whose maps differ in at most half of what is allowed, or ``KEEP`` of any kind. The
best of all words is compared first, then the others of lines that are still undecided: by parity maps of 256 bits, and what
these leave by the words. Lines undecided after that which stopped early meet every candidate.

Prefix entries are shuffled in bundles, not in rows of their own: a task sorts about ``CHUNK`` of them by word and hands on a row
per bucket of words with the entries' fields as packed arrays. Only entries of words with more than ``BLOCK`` lines go as rows.

Rarity comes from word counts of all texts in ``SLOTS`` counters, a table of fixed size (1 MB) that is sent to all
tasks. Collisions only change the order, which has to be the same everywhere but need not be exact. A word
whose counter holds more than 1/``HOT_SHARE`` of all words is split by size class; sets of one class and the
next larger one meet there. The lines of a word, or of a word and size class, that are still more than ``BLOCK`` are
dealt by id into blocks of about that many. Each block is searched on its own; lines that could go on looking then
meet the other blocks in a join, one block of them with one block of the group at a time.

Defined cases: a null or empty text has no lines and loses none; lines without a word stay and count for nothing;
a null doc_id comes last in order; rows with the same id and text count as one document and share its result;
documents keep all columns, and no name of theirs is used; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.shared import filtered, key_filter, passes, same_columns, short_batches, stored
from txnwatch.llm.words import array, blocks, list_column, mix, signed, texts, words
from txnwatch.operators.skew import list_join

SLOTS = 1 << 20
PIECE = 1 << 14  # counters per row of the count table
HOT_SHARE = 10_000
HOT_ROWS = 20_000
KEEP = 32
SURE = 2
BLOCK = 50_000  # prefix rows of one word that one task compares
PARTS = (1 << 24) - 1  # low bits of a group's number: its block, from 1; 0 if the group is whole
SEEN = 1 << 18  # sets that a task remembers
LONG = 100  # lines with more words have parity maps of 128 bits, with more than twice as many 256 bits
SMALL = 1 << 16  # bytes of text that are handled as one numpy block; its arrays stay in the cache
CHUNK = 1 << 20  # prefix entries that a task bundles at once
GATHER = 1 << 16  # prefix entries that are searched at once, at least
LAST = np.iinfo(np.int64).max  # place of a null doc_id
SALT = np.uint64(0xD6E8FEB86659FD93)


def text_key(column: Column) -> Column:
    return F.xxhash64(column)


def rarity(docs: DataFrame) -> tuple[np.ndarray, int]:
    """For each counter eight times the binary logarithm of its words' count, as one byte; the least hot rank."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        held, size = [np.zeros(0, np.int64)], 0
        for batch in batches:
            for _, buf, _ in blocks(texts(batch.column(0)), SMALL):
                held.append((words(buf, lower=True)[2] >> np.uint64(44)).view(np.int64))
                size += len(held[-1])
                if size > SLOTS:
                    total += np.bincount(np.concatenate(held), minlength=SLOTS)
                    held, size = held[:1], 0
        total += np.bincount(np.concatenate(held), minlength=SLOTS)
        rows = [(k, np.flatnonzero(total[k * PIECE : (k + 1) * PIECE])) for k in range(SLOTS // PIECE)]
        rows = [(k, at) for k, at in rows if len(at)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in rows], pa.int32()),
                pa.array([at.astype("<u2").tobytes() for _, at in rows], pa.binary()),
                pa.array([total[k * PIECE + at].astype("<i8").tobytes() for k, at in rows], pa.binary()),
            ],
            ["piece", "at", "n"],
        )

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(PIECE, np.int64)
        for at, n in zip(table.column("at").to_pylist(), table.column("n").to_pylist(), strict=True):
            total[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<i8")
        at = np.flatnonzero(total)
        return pa.table(
            {"piece": pa.array([key[0].as_py()], pa.int32()), "at": pa.array([at.astype("<u2").tobytes()], pa.binary()), "n": pa.array([total[at].astype("<i8").tobytes()], pa.binary())}
        )

    shape = "piece int, at binary, n binary"
    counts = docs.select("text").mapInArrow(count, shape)
    # Two rounds, so that no task gets the rows of all partitions.
    part = counts.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(16))).groupBy("piece", "salt").applyInArrow(add, shape)
    out, all_words = np.zeros(SLOTS, np.uint8), 0
    for row in part.groupBy("piece").applyInArrow(add, shape).collect():
        at = np.frombuffer(bytes(row["at"]), "<u2").astype(np.int64) + row["piece"] * PIECE
        n = np.frombuffer(bytes(row["n"]), "<i8")
        out[at] = log_rank(n)
        all_words += int(n.sum())
    return out, int(log_rank(np.array([max(HOT_ROWS, all_words // HOT_SHARE)]))[0]) + 1


def log_rank(n: np.ndarray) -> np.ndarray:
    return np.minimum(255, 8 * np.log2(n + 1.0)).astype(np.uint8)


# The value of a counter that has seen one word.
ONCE = 8


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def has_neighbours(n: np.ndarray, percent: int) -> np.ndarray:
    """Can a set of n words resemble a different one? The closest one has a word more."""
    return 100 * n >= percent * (n + 1)


def by_line(key: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Order by line, then by key: one sort of both numbers' leading bits, unless these tie for different keys."""
    if line[-1] < 1 << 16:
        both = (line.astype(np.uint64) << np.uint64(48)) | (key >> np.uint64(16))
        order = np.argsort(both)
        both, full = both[order], key[order]
        if not ((both[1:] == both[:-1]) & (full[1:] != full[:-1])).any():
            return order
    return np.lexsort((key, line))


def line_sets(buf: np.ndarray, rank: np.ndarray) -> dict[str, np.ndarray] | None:
    """Distinct words of every line of a block, rare ones first: the lines and their words end to end."""
    starts, _, hashes = words(buf, lower=True)
    if not len(starts):
        return None
    feeds = np.flatnonzero(buf == 10)
    line = np.repeat(np.arange(len(feeds) + 1), np.diff(np.searchsorted(starts, feeds), prepend=0, append=len(starts)))
    key = (rank[(hashes >> np.uint64(44)).view(np.int64)].astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8))
    order = by_line(key, line)
    key, line = key[order], line[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    key, line = key[fresh], line[fresh]
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    return {
        "line": line[first], "first": first, "n": np.diff(np.append(first, len(key))), "key": key, "feeds": feeds,
        "id1": np.add.reduceat(mix(key), first), "id2": np.add.reduceat(mix(key ^ SALT), first),
        "owner": np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key)))),
    }


def widths(n: np.ndarray) -> np.ndarray:
    """How many words of 64 bits the parity map of a line of n words has."""
    return 1 + (n > LONG) + 2 * (n > 2 * LONG)


def parities(s: dict[str, np.ndarray], width: np.ndarray) -> np.ndarray:
    """Parity maps of the lines of a block, four words each, of which a line uses the first ``width`` (1, 2 or 4)."""
    slot = (s["key"] >> np.uint64(20)) & np.uint64(255)
    out = np.zeros((len(s["n"]), 4), np.uint64)
    bit = np.uint64(1) << (slot & np.uint64(63))
    most = int(width.max())
    if most == 1:
        out[:, 0] = np.bitwise_xor.reduceat(bit, s["first"])
        return out
    part = (slot >> np.uint64(6)) & (width.astype(np.uint64) - np.uint64(1))[s["owner"]]
    for k in range(most):
        out[:, k] = np.bitwise_xor.reduceat(np.where(part == k, bit, np.uint64(0)), s["first"])
    return out


MANY = 1 << 31


def binary(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of x, cut at the given places."""
    x = np.ascontiguousarray(x)
    each = x.itemsize * int(np.prod(x.shape[1:]))
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * each).astype(np.int32)), pa.py_buffer(x)])


def entries_of(prefix: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a column of prefixes, end to end, and the row of each."""
    offsets = np.frombuffer(prefix.buffers()[1], np.int32)[prefix.offset : prefix.offset + len(prefix) + 1]
    held = prefix.buffers()[2]
    flat = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]].view(np.int64) if held is not None and offsets[-1] > offsets[0] else np.zeros(0, np.int64)
    return flat, np.repeat(np.arange(len(prefix)), np.diff(offsets) // 8)


def occurrences(docs: DataFrame, sent, percent: int) -> DataFrame:
    """A row per line with words: ids of its set, size, parity map, prefix. A row with line -1 per document: its number of such lines.

    The prefix is an array of 64-bit entries as bytes. They hold the word (high 32 bits), its place in the line, and a last bit that is set where the
    line stands in the size class below its own. The bit ``MANY`` is set where the word may have more than ``BLOCK`` lines,
    and ``many`` is true for lines with such a word.
    """
    many = int(log_rank(np.array([BLOCK]))[0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        (rank, hot), seen = sent.value, {}
        names = ["doc_id", "t", "line", "n", "id1", "id2", "p0", "p1", "p2", "p3", "prefix", "many"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 6]
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            place = ids.fill_null(LAST).to_numpy(zero_copy_only=False)
            t = batch.column(1).to_numpy(zero_copy_only=False)
            zero = np.zeros(len(t), np.int64)
            held = zero.copy()
            for at, buf, begin in blocks(texts(batch.column(2)), SMALL):
                s = line_sets(buf, rank)
                if s is None:
                    continue
                base = np.searchsorted(s["feeds"], begin)  # line feeds before each text
                doc = np.searchsorted(base, s["line"], "right") - 1 + at
                n = s["n"]
                held += np.bincount(doc, minlength=len(t))
                size = np.where(has_neighbours(n, percent), prefix_size(n, percent), 0)
                # Prefix entries once per task and set, again only for an earlier document.
                if len(seen) > SEEN:
                    seen.clear()
                new = np.zeros(len(n), bool)
                for i, (x, d) in enumerate(zip(s["id1"].tolist(), place[doc].tolist(), strict=True)):
                    if size[i] and d < seen.get(x, LAST + 1):
                        seen[x] = d
                        new[i] = True
                size[~new] = 0
                total = int(size.sum())
                within = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
                owner = np.repeat(np.arange(len(n)), size)
                key = s["key"][s["first"][owner] + within]
                # Words that occur once in all texts lead to no other line.
                useful = (key >> np.uint64(56)) > ONCE
                key, owner, within = key[useful], owner[useful], within[useful]
                common = (key >> np.uint64(56)) >= hot
                twice = 1 + common.astype(np.int64)
                key, owner, within, common = (np.repeat(x, twice) for x in (key, owner, within, common))
                large = (key >> np.uint64(56)) >= many
                lower = np.zeros(len(key), bool)
                lower[1:] = common[1:] & (np.arange(1, len(key)) == np.cumsum(twice).repeat(twice)[1:] - 1)
                step = np.floor(np.log(n[owner]) / np.log(100 / percent)).astype(np.int64) - lower
                key = np.where(common, mix(key + step.astype(np.uint64)), key)
                entry = (key << np.uint64(32)) | (within.astype(np.uint64) << np.uint64(1)) | lower.astype(np.uint64)
                entry[large] |= np.uint64(MANY)
                parity = parities(s, widths(n))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(doc)), pa.array(t[doc]), pa.array((s["line"] - base[doc - at]).astype(np.int32)), pa.array(n.astype(np.int32)),
                        pa.array(signed(s["id1"])), pa.array(signed(s["id2"])), *[pa.array(signed(parity[:, k].copy())) for k in range(4)],
                        binary(entry, np.append(0, np.cumsum(np.bincount(owner, minlength=len(n))))), pa.array(np.bincount(owner[large], minlength=len(n)) > 0),
                    ],
                    names,
                )
            plain = [zero - 1, held, *[zero] * 6]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(t), *[pa.array(x, kind) for x, kind in zip(plain, kinds[2:], strict=True)], binary(zero[:0], np.append(0, zero)), pa.array(zero > 0)], names
            )

    shape = "doc_id long, t long, line int, n int, id1 long, id2 long, p0 long, p1 long, p2 long, p3 long, prefix binary, many boolean"
    return docs.select("doc_id", text_key(F.col("text")), "text").mapInArrow(run, shape)


def search(tok, n, ident, doc, spot, parity, percent: int, keep: int, enough: int) -> pa.RecordBatch:
    """Earlier candidates of each line in groups of equal ``tok``; entries are sorted by (tok, n, ident), each once.

    Columns: later and earlier set, ``apart`` (bound on their difference), ``more`` if the line stopped looking. Where groups are
    blocks (``tok`` is a long) also the group, and the lines that did not stop are listed as well, with a null for the earlier set.
    """
    n = n.astype(np.int64)
    lower, pos = (spot & 1) == 1, spot.astype(np.int64) >> 1
    width = widths(n)
    mixed = bool((width > 1).any())
    size = len(tok)
    got, sure, full = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
    found = []
    # The smaller set of a pair may use a shorter prefix.
    live = np.flatnonzero((pos < n - -(-2 * percent * n // (100 + percent)) + 1) & ~lower)
    group = np.cumsum(np.concatenate([[0], tok[1:] != tok[:-1]])) if size else np.zeros(0, np.int64)
    end = np.append(np.flatnonzero(np.diff(group)) + 1, size)[group] if size else group  # first entry behind the group
    step = 0
    while len(live):
        step += 1
        if step % 32 == 0:
            # Nothing is left to find for a full row whose group has no open row behind.
            last = np.full(int(group[-1]) + 1, -1, np.int64)
            free = np.flatnonzero(~full)
            last[group[free]] = free
            live = live[~full[live] | (last[group[live]] >= live + step)]
        live = live[live + step < end[live]]
        other = live + step
        go = 100 * n[live] >= percent * n[other]
        live, other = live[go], other[go]
        # Positional and parity filters hold for both directions.
        forth, back = doc[live] <= doc[other], doc[other] <= doc[live]
        ask = np.flatnonzero((forth & ~full[other]) | (back & ~full[live]))
        x, y, forth, back = other[ask], live[ask], forth[ask], back[ask]
        both = n[x] + n[y]
        least = -(-percent * both // (100 + percent))
        fit = np.flatnonzero(np.minimum(n[x] - pos[x], n[y] - pos[y]) >= least)
        x, y, forth, back, room = x[fit], y[fit], forth[fit], back[fit], (both - 2 * least)[fit]
        apart = np.bitwise_count(parity[x, 0] ^ parity[y, 0]).astype(np.int64)
        odd = np.zeros(len(x), bool)
        if mixed:
            apart += np.bitwise_count(parity[x, 1:] ^ parity[y, 1:]).sum(1).astype(np.int64)
            # Maps of different width cannot be compared.
            odd = width[x] != width[y]
            apart[odd] = 0
        fit = np.flatnonzero(apart <= room)
        x, y, forth, back, apart, good = x[fit], y[fit], forth[fit], back[fit], apart[fit], (~odd & (2 * apart <= room))[fit]
        for later, earlier, way in ((x, y, forth), (y, x, back)):
            ok = np.flatnonzero(way & ~full[later])
            at = later[ok]
            found.append((at, earlier[ok], apart[ok]))
            got[at] += 1
            sure[at] += good[ok]
            full[at] = (sure[at] >= enough) | (got[at] >= keep)
    x, y, apart = (np.concatenate(c) for c in zip(*found, strict=True)) if found else np.zeros((3, 0), np.int64)
    names = ["later", "earlier", "apart", "more", "grp"]
    if tok.dtype != np.int64:  # words, no blocks
        return pa.RecordBatch.from_arrays([pa.array(ident[x]), pa.array(ident[y]), pa.array(apart.astype(np.int32)), pa.array(full[x])], names[:4])
    rest = np.flatnonzero(~full & ((tok & PARTS) > 0))
    x, y, apart = (np.concatenate(c) for c in ((x, rest), (y, rest), (apart, np.zeros(len(rest), np.int64))))
    none = np.arange(len(x)) >= len(x) - len(rest)
    return pa.RecordBatch.from_arrays(
        [pa.array(ident[x]), pa.array(ident[y], mask=none), pa.array(apart.astype(np.int32)), pa.array(full[x]), pa.array(tok[x])], names
    )


def once_each(tok, n, ident, doc, spot, parity) -> list[np.ndarray]:
    """Entries sorted by (tok, n, ident), each once with its earliest document."""
    order = np.lexsort((ident, (tok.astype(np.uint64) << np.uint64(32)) | n.astype(np.uint64)))
    tok, n, ident, doc, spot, parity = (x[order] for x in (tok, n, ident, doc, spot, parity))
    fresh = np.ones(len(tok), bool)
    fresh[1:] = (tok[1:] != tok[:-1]) | (ident[1:] != ident[:-1]) | (n[1:] != n[:-1])
    first = np.flatnonzero(fresh)
    return [tok[first], n[first], ident[first], np.minimum.reduceat(doc, first), np.minimum.reduceat(spot, first), parity[first]]


def promising(rows: Iterable[pa.RecordBatch], percent: int, keep: int, enough: int) -> Iterable[pa.RecordBatch]:
    """``search`` over rows sorted by (grp, n, id, doc)."""

    def scan(tok, n, ident, doc, spot, parity) -> pa.RecordBatch:
        # The first row of an id has its earliest document.
        fresh = np.ones(len(tok), bool)
        fresh[1:] = (tok[1:] != tok[:-1]) | (ident[1:] != ident[:-1]) | (n[1:] != n[:-1])
        return search(*(x[fresh] for x in (tok, n, ident, doc, spot, parity)), percent, keep, enough)

    held = None
    for batch in rows:
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        now.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5, 9)], axis=1).view(np.uint64))
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        if cut:
            yield scan(*[x[:cut] for x in now])
        held = [x[cut:] for x in now]
    if held is not None and len(held[0]):
        yield scan(*held)


BUNDLE = "bucket int, base long, low binary, high binary, n binary, spot binary, doc binary, id binary, map1 binary, map2 binary, map4 binary"


def bundles(lines: Iterable[pa.RecordBatch], bits: int, without: np.ndarray | None, chunk: int = CHUNK) -> Iterable[pa.RecordBatch]:
    """Prefix entries of lines (n, id, doc, parity maps, prefix) as rows of ``BUNDLE``, one per bucket and about ``chunk`` entries.

    A bucket is the first ``bits`` bits of a word. Words are kept as steps from the one before, documents as distances from ``base``,
    each number in as few bytes as the chunk allows; parity maps of 128 and 256 bits go on in ``map2`` and ``map4``.
    Entries whose word may be in the filter ``without`` are left out.
    """
    names = [x.split()[0] for x in BUNDLE.split(", ")]

    def least(x: np.ndarray) -> np.ndarray:
        return x.astype(next(kind for kind in ("<u1", "<u2", "<u4", "<u8") if int(x.max()) <= np.iinfo(kind).max))

    def packed(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        tok, n, ident, doc, spot, parity = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(tok)
        tok, n, ident, doc, spot, parity = (x[order] for x in (tok, n, ident, doc, spot, parity))
        bucket = tok >> np.uint32(32 - bits)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        cuts = np.append(first, len(tok))
        gap = np.diff(tok, prepend=tok[:1])
        gap[first] = tok[first] & np.uint32((1 << (32 - bits)) - 1)
        base = int(doc.min())
        more, most = (np.flatnonzero(widths(n) >= k) for k in (2, 4))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[first].astype(np.int32)), pa.array(np.full(len(first), base, np.int64)),
                binary(gap.astype("<u2"), cuts), binary((gap >> np.uint32(16)).astype("<u2"), cuts), binary(least(n), cuts), binary(least(spot), cuts),
                binary(least(doc.view(np.uint64) - np.array(base).view(np.uint64)), cuts), binary(ident, cuts), binary(parity[:, 0], cuts),
                binary(parity[more, 1], np.searchsorted(more, cuts)), binary(parity[most, 2:], np.searchsorted(most, cuts)),
            ],
            names,
        )

    held, total = [], 0
    for batch in lines:
        flat, owner = entries_of(batch.column(7))
        if without is not None:
            ok = np.flatnonzero(~passes(without, flat >> 32))
            flat, owner = flat[ok], owner[ok]
        if not len(flat):
            continue
        n, ident, doc = (batch.column(k).to_numpy(zero_copy_only=False)[owner] for k in range(3))
        parity = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3, 7)], axis=1).view(np.uint64)[owner]
        held.append([(flat >> 32).astype(np.int32).view(np.uint32), n, ident, doc, (flat & 0x7FFFFFFF).astype(np.int32), parity])
        total += len(flat)
        if total >= chunk:
            yield packed(held)
            held, total = [], 0
    if held:
        yield packed(held)


def unbundled(rows: Iterable[pa.RecordBatch], bits: int, percent: int, keep: int, enough: int) -> Iterable[pa.RecordBatch]:
    """``search`` over rows of ``BUNDLE`` sorted by bucket: the buckets of at least ``GATHER`` entries at a time."""

    def entries(row: dict) -> list[np.ndarray]:
        ident = np.frombuffer(row["id"], "<i8")
        size = len(ident)
        less = lambda name: np.frombuffer(row[name], f"<u{len(row[name]) // size}")
        gap = np.frombuffer(row["low"], "<u2").astype(np.uint32) | (np.frombuffer(row["high"], "<u2").astype(np.uint32) << np.uint32(16))
        tok = np.cumsum(gap, dtype=np.uint32) + np.uint32(row["bucket"] << (32 - bits))
        doc = (less("doc").astype(np.uint64) + np.array(row["base"]).view(np.uint64)).view(np.int64)
        n = less("n").astype(np.int64)
        parity = np.zeros((size, 4), np.uint64)
        parity[:, 0] = np.frombuffer(row["map1"], "<u8")
        parity[n > LONG, 1] = np.frombuffer(row["map2"], "<u8")
        parity[n > 2 * LONG, 2:] = np.frombuffer(row["map4"], "<u8").reshape(-1, 2)
        return [tok, n, ident, doc, less("spot").astype(np.int64), parity]

    held: list[list[np.ndarray]] = []
    total, before = 0, None
    for batch in rows:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            if row["bucket"] != before and total >= GATHER:
                yield search(*once_each(*(np.concatenate(x) for x in zip(*held, strict=True))), percent, keep, enough)
                held, total = [], 0
            held.append(entries(row))
            total += len(held[-1][0])
            before = row["bucket"]
    if held:
        yield search(*once_each(*(np.concatenate(x) for x in zip(*held, strict=True))), percent, keep, enough)


PARITY = ["p0", "p1", "p2", "p3"]


def listed_lines(lines: DataFrame) -> DataFrame:
    """The lines with a prefix: size and id of the set, document, parity map, prefix."""
    return lines.filter("octet_length(prefix) > 0").select("n", F.col("id1").alias("id"), F.coalesce("doc_id", F.lit(int(LAST))).alias("doc"), *PARITY, "prefix")


def prefix_rows(lines: DataFrame, among=None) -> DataFrame:
    """A row per prefix entry: word, size and id of the set, document, spot (place and class bit), parity map.

    With a ``key_filter``, only entries of the words that may be in it leave their line.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            flat, owner = entries_of(batch.column(7))
            if among is not None:
                ok = np.flatnonzero(passes(among.value, flat >> 32))
                flat, owner = flat[ok], owner[ok]
            of = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array((flat >> 32).astype(np.int32)), *[c.take(of) for c in batch.columns[:3]], pa.array((flat & 0x7FFFFFFF).astype(np.int32)), *[c.take(of) for c in batch.columns[3:7]]],
                ["tok", "n", "id", "doc", "spot", *PARITY],
            )

    return listed_lines(lines).mapInArrow(run, "tok int, n int, id long, doc long, spot int, p0 long, p1 long, p2 long, p3 long")


def large_groups(lines: DataFrame) -> DataFrame:
    """The words with more than ``BLOCK`` prefix rows and the number of their blocks: tok, parts.

    Only words with a large counter are counted; there are at most as many as the rows fill blocks.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            flat, _ = entries_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array((flat[(flat & MANY) != 0] >> 32).astype(np.int32))], ["tok"])

    counts = lines.filter("many").select("prefix").mapInArrow(run, "tok int").groupBy("tok").count().filter(F.col("count") > BLOCK)
    return counts.select("tok", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))


def cut_rows(lines: DataFrame, large: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``prefix_rows`` (or the given ones) with ``part``, their block from 1 on, 0 where the group is whole, and the number ``parts``."""
    rows = list_join(prefix_rows(lines) if rows is None else rows, large, ["tok"], "left", salt_on=["id"])
    return rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), "parts") + 1, F.lit(0)))


def bucket_bits(lines: DataFrame) -> int:
    """So many that a bucket has some ten thousand entries, a few per line; from 1,024 to 65,536 buckets."""
    return min(16, max(10, (lines.count() // 4096).bit_length()))


def candidates(lines: DataFrame, percent: int) -> DataFrame:
    """Promising pairs (later, earlier, apart, more) of set ids; the order is by doc_id alone, both ways where it ties."""
    large = stored(large_groups(lines), "large")
    # Words with blocks, and the few that the filter takes for such, go as rows.
    table = None if large.isEmpty() else key_filter(large.select(F.col("tok").cast("long").alias("key")))
    bits = bucket_bits(lines)
    bundled = listed_lines(lines).mapInArrow(lambda b, chunk=CHUNK: bundles(b, bits, None if table is None else table.value, chunk), BUNDLE)
    bundled = bundled.repartition("bucket").sortWithinPartitions("bucket")
    found = bundled.mapInArrow(lambda b, keep=KEEP, sure=SURE: unbundled(b, bits, percent, keep, sure), PAIRS)
    if table is not None:
        cut = cut_rows(lines, large, prefix_rows(lines, table))
        shown = cut.select((F.shiftleft(F.col("tok").cast("long"), 24) + F.col("part")).alias("grp"), "n", "id", "doc", "spot", *PARITY)
        shown = shown.repartition("grp").sortWithinPartitions("grp", "n", "id", "doc")
        cut_found = stored(shown.mapInArrow(lambda b, keep=KEEP, sure=SURE: promising(b, percent, keep, sure), f"{PAIRS}, grp long"), "found")
        tok = F.shiftright("grp", 24).cast("int").alias("tok")
        going = cut_found.filter("earlier is null").select(tok, F.col("later").alias("id"))
        found = found.union(cut_found.filter("earlier is not null").drop("grp")).union(between_blocks(cut.filter("part > 0"), going, percent))
    return found.groupBy("later", "earlier").agg(F.min("apart").alias("apart"), F.max("more").alias("more"))


PAIRS = "later long, earlier long, apart int, more boolean"


def between_blocks(cut: DataFrame, going: DataFrame, percent: int) -> DataFrame:
    """Candidates in other blocks for the lines in ``going`` (tok, id): later, earlier, apart, more.

    Every join key holds about ``BLOCK`` rows of each side at most.
    """
    first = F.min(F.struct("doc", "spot", "n", *PARITY, "parts")).alias("x")
    each = stored(cut.groupBy("tok", "part", "id").agg(first).select("tok", "part", "id", "x.*"), "blocks")
    asks = stored(each.join(going.distinct(), ["tok", "id"], "left_semi"), "asks")
    sizes = stored(asks.groupBy("tok").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("turns")), "turns")
    side = lambda df, x, *keys: df.select("tok", *keys, *[F.col(c).alias(f"{c}_{x}") for c in ("part", "id", "doc", "spot", "n", *PARITY)])
    asks = list_join(asks, sizes, ["tok"], "inner", salt_on=["id"]).withColumn("turn", F.pmod(F.xxhash64(F.lit(1), "id"), "turns"))
    asks = asks.withColumn("block", F.explode(F.sequence(F.lit(1), "parts"))).filter("block != part")
    rows = list_join(each, sizes, ["tok"], "inner", salt_on=["id"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    rows = rows.withColumn("block", F.col("part").cast("int"))
    both = side(asks, "a", F.col("turn").cast("int").alias("turn"), "block").join(side(rows, "b", "turn", "block"), ["tok", "turn", "block"])
    one_class = F.col("spot_a").bitwiseAND(F.col("spot_b")).bitwiseAND(F.lit(1)) == 0
    ok, apart = fits(F.shiftright("spot_a", 1), F.shiftright("spot_b", 1), percent)
    return both.filter(ok & one_class).select(F.col("id_a").alias("later"), F.col("id_b").alias("earlier"), apart.alias("apart"), F.lit(False).alias("more"))


def fits(pos_a: Column, pos_b: Column, percent: int) -> tuple[Column, Column]:
    """``fit`` for joined rows with columns n, id, doc and parity maps of sides a (later) and b, and the bound on the difference."""
    na, nb = F.col("n_a"), F.col("n_b")
    least = F.ceil(percent * (na + nb) / (100 + percent))
    apart = F.lit(0)
    for p in PARITY:
        apart = apart + F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b")))
    apart = F.when(((na > LONG) != (nb > LONG)) | ((na > 2 * LONG) != (nb > 2 * LONG)), 0).otherwise(apart)
    ok = (
        (F.col("id_a") != F.col("id_b"))
        & (F.col("doc_b") <= F.col("doc_a"))
        & (100 * F.least(na, nb) >= percent * F.greatest(na, nb))
        & (F.least(na - pos_a, nb - pos_b) >= least)
        & (apart <= na + nb - 2 * least)
    )
    return ok, apart


def all_candidates(lines: DataFrame, open_: DataFrame, percent: int) -> DataFrame:
    """Every candidate (later, earlier) of the sets in ``open_`` (column id), whatever its promise."""
    own = lines.join(open_.select(F.col("id").alias("id1")), "id1", "left_semi")
    mine = stored(prefix_rows(own).dropDuplicates(["tok", "id"]), "open_rows")
    near_rows = prefix_rows(lines, key_filter(mine.select(F.col("tok").cast("long").alias("key"))))
    pos = F.shiftright("spot", 1)
    side = lambda df, x: df.withColumn("pos", pos).select("tok", *[F.col(c).alias(f"{c}_{x}") for c in ("n", "id", "doc", "pos", *PARITY)])
    near = side(near_rows.dropDuplicates(["tok", "id", "doc"]), "b")
    ok, _ = fits(F.col("pos_a"), F.col("pos_b"), percent)
    met = side(mine, "a").join(near, "tok").filter(ok)
    return met.select(F.col("id_a").alias("later"), F.col("id_b").alias("earlier")).distinct()


MAPS = ["m0", "m1", "m2", "m3"]


def words_of(docs: DataFrame, places: DataFrame, sent, percent: int) -> DataFrame:
    """The sets with a first line in ``places`` (id, first): id, size, parity map of 256 bits and the hashed words.

    A line is looked for by text and number; words of other lines are not read, but for the few that the filter takes for such.
    """
    table = key_filter(places.select(F.col("first.t").bitwiseXOR(F.col("first.line").cast("long")).alias("key")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rank, seen = sent.value[0], set()
        for batch in batches:
            t = batch.column(0).to_numpy(zero_copy_only=False)
            for at, buf, begin in blocks(texts(batch.column(1)), SMALL):
                feeds = np.flatnonzero(buf == 10)
                base = np.searchsorted(feeds, begin)  # line feeds before each text
                line = np.arange(len(feeds) + 1)
                doc = np.searchsorted(base, line, "right") - 1
                pick = np.flatnonzero(passes(table.value, t[at + doc] ^ (line - base[doc])))
                low, high, whole = np.append(0, feeds + 1)[pick].tolist(), np.append(feeds, len(buf))[pick].tolist(), buf.tobytes()
                s = line_sets(array(b"\n".join([whole[a:b] for a, b in zip(low, high, strict=True)])), rank)
                if s is None:
                    continue
                place = np.unique(s["id1"], return_index=True)[1]
                place = place[has_neighbours(s["n"][place], percent)]
                if len(seen) > SEEN:
                    seen.clear()
                place = np.array([k for k in place.tolist() if s["id1"][k] not in seen], np.int64)
                seen.update(s["id1"][place].tolist())
                size = s["n"][place]
                pick = np.repeat(s["first"][place] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                parity = signed(parities(s, np.full(len(s["n"]), 4))[place])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(s["id1"][place])), pa.array(size.astype(np.int32)), *[pa.array(parity[:, k].copy()) for k in range(4)],
                        list_column(signed(s["key"][pick]), size, pa.int64()),
                    ],
                    ["id", "n", *MAPS, "words"],
                )

    shape = "id long, n int, m0 long, m1 long, m2 long, m3 long, words array<long>"
    return docs.select(text_key(F.col("text")), "text").mapInArrow(run, shape).dropDuplicates(["id"])


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (later, earlier) whose word sets are similar."""
    both = pairs.join(sets.select(F.col("id").alias("later"), F.col("words").alias("wa")), "later")
    both = both.join(sets.select(F.col("id").alias("earlier"), F.col("words").alias("wb")), "earlier")
    common = F.size(F.array_intersect("wa", "wb"))
    return both.filter(100 * common >= percent * (F.size("wa") + F.size("wb") - common)).select("later", "earlier")


def late_ones(some: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The later sets (column id1) of pairs that are similar and in order; what the maps of 256 bits leave is compared by its words."""
    side = lambda name, x: known.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}_{x}") for c in ("first", "n", *MAPS)])
    both = some.join(side("later", "a"), "later").join(side("earlier", "b"), "earlier").filter("first_b < first_a")
    total = F.col("n_a") + F.col("n_b")
    apart = F.lit(0)
    for m in MAPS:
        apart = apart + F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b")))
    close = stored(both.filter(apart <= total - 2 * F.ceil(percent * total / (100 + percent))).select("later", "earlier"), "close")
    return stored(similar(close, sets, percent).select(F.col("later").alias("id1")).distinct(), "late")


def late_sets(docs: DataFrame, lines: DataFrame, firsts: DataFrame, sent, percent: int) -> DataFrame:
    """Ids of the sets that resemble one with an earlier first line (column id1). ``firsts`` has id1 and first."""

    def described(some: DataFrame) -> tuple[DataFrame, DataFrame]:
        """First line, size and map of each set in some pairs; their words."""
        ids = some.select(F.explode(F.array("later", "earlier")).alias("id1")).distinct()
        places = stored(firsts.join(ids, "id1", "left_semi").select(F.col("id1").alias("id"), "first"), "places")
        with short_batches(docs.sparkSession):
            sets = stored(words_of(docs, places, sent, percent), "sets")
        return stored(places.join(sets.drop("words"), "id"), "known"), sets

    pairs = stored(candidates(lines, percent), "candidates")
    known, sets = described(pairs)
    best = pairs.groupBy("later").agg(F.min(F.struct("apart", "earlier")).alias("x")).select("later", F.col("x.earlier").alias("earlier"))
    late = late_ones(best, known, sets, percent)
    rest = pairs.join(late.select(F.col("id1").alias("later")), "later", "left_anti").join(best, ["later", "earlier"], "left_anti")
    late = late.union(late_ones(rest.select("later", "earlier"), known, sets, percent))
    open_ = pairs.filter("more").select(F.col("later").alias("id")).distinct().join(late.select(F.col("id1").alias("id")), "id", "left_anti")
    open_ = stored(open_, "open")
    if open_.isEmpty():
        return late
    more = all_candidates(lines, open_, percent).join(pairs, ["later", "earlier"], "left_anti")
    more = stored(more, "more")
    if more.isEmpty():
        return late
    return late.union(late_ones(more, *described(more), percent))


def removed_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, t (hash of its text), n_lines (lines with words) and the ``removed`` line numbers.

    Line numbers count the pieces between line feeds from 0. ``n_rows`` says how many rows share id and text.
    """
    base = same_columns(docs, ["doc_id", "text"])
    with short_batches(docs.sparkSession):
        sent = docs.sparkSession.sparkContext.broadcast(rarity(base))
        lines = stored(occurrences(base, sent, percent), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t", "line")
    real = lines.filter("line >= 0")
    sets = stored(real.groupBy("id1", "id2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    late = late_sets(base, lines, sets.select("id1", "first"), sent, percent).distinct().withColumn("late", F.lit(True))
    # Only sets that occur again or lose to another one can remove a line.
    marks = sets.join(late, "id1", "left").filter("n > 1 or late").select("id1", "id2", "first", F.coalesce("late", F.lit(False)).alias("late"))
    marks = stored(marks, "marks")
    some = filtered(real.select("doc_id", "t", "line", "id1", "id2"), "id1", key_filter(marks.select(F.col("id1").alias("key"))))
    gone = some.join(marks, ["id1", "id2"]).filter(F.col("late") | (place != F.col("first"))).select("doc_id", "t", "line", F.lit(0).alias("n"))
    # A document's own row knows how many lines it has.
    return lines.filter("line < 0").select("doc_id", "t", "line", "n").union(gone).groupBy("doc_id", "t").agg(
        F.count(F.when(F.col("line") < 0, 1)).alias("n_rows"),
        F.max("n").cast("long").alias("n_lines"),
        F.array_sort(F.collect_set(F.when(F.col("line") >= 0, F.col("line")))).alias("removed"),
    )


def line_report(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per document row: doc_id, n_lines, n_removed and the removed line numbers as text."""
    found = removed_lines(docs, percent)
    each = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    return each.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed_lines"))


def without_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents without their removed lines; those that lose every line with words go as a whole.

    All columns stay. ``n_chars``, where there is one, follows the new text.
    """
    found = removed_lines(docs, percent).select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "n_lines", "removed")
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text_key(F.col("text")).alias("_key"))
    joined = rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_t")))
    left = F.filter(F.split(F.col("row.text"), "\n", -1), lambda _, i: ~F.array_contains("removed", i))
    text = F.when(F.size("removed") == 0, F.col("row.text")).otherwise(F.array_join(left, "\n"))
    kept = joined.filter("n_lines = 0 or size(removed) < n_lines").withColumn("_text", text)
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return kept.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in names])
