"""Words of whole texts as numpy arrays, for the operators that read text inside Spark tasks.

A word is a run of bytes other than space and the control characters 9 to 13, so the UTF-8 bytes give the
same words as the code points. All functions take and return plain arrays; Spark does the distribution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
# Bytes that begin a code point (all but UTF-8 continuation bytes).
HEAD = (np.arange(256) & 0xC0) != 0x80

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

# Bytes of text that are handled as one numpy block.
BLOCK = 1 << 19


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2^64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, BLOCK + 1)
        for k, base in enumerate((_ODD, _INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sums(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """Running polynomial sums: ``span_hash`` takes the hash of any byte span from them."""
    out = np.zeros(len(buf) + 1, np.uint64)
    values = (_BYTE_LOWER if lower else _BYTE).take(buf, mode="clip")
    values *= powers(len(buf))[0][:-1]
    np.cumsum(values, out=out[1:])
    return out


def span_hash(run: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    inverse = powers(len(run) - 1)[1]
    return mix((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    inside = np.zeros(len(buf) + 2, bool)
    np.logical_not(SPACE.take(buf), out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _words(buf: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = word_spans(buf)
    return starts, ends, span_hash(sums(buf, lower), starts, ends)


def words(buf: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words; ``lower`` folds A-Z.

    A text longer than a block is cut at white space, so memory follows the number of words.
    """
    if len(buf) <= 2 * BLOCK:
        return _words(buf, lower)
    parts, at = [], 0
    while at < len(buf):
        end = min(len(buf), at + BLOCK)
        while end < len(buf) and not SPACE[buf[end]]:
            end += 1
        s, e, h = _words(buf[at:end], lower)
        parts.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows; a shorter text is one window, no words give none."""
    if len(hashes) == 0:
        return hashes
    k = min(k, len(hashes))
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out + hashes[i : len(hashes) - k + 1 + i] + np.uint64(k))
    return out


def texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    return column.cast(pa.large_binary()).to_pylist()


def array(text: bytes | None) -> np.ndarray:
    return np.frombuffer(text or b"", np.uint8)


def blocks(rows: list[bytes | None], size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Join texts by line feeds to blocks of about ``size`` bytes: first row, bytes, start of each text."""
    first, held, total = 0, [], 0
    for i, text in enumerate(rows):
        held.append(text or b"")
        total += len(held[-1]) + 1
        if total >= size or i == len(rows) - 1:
            lengths = np.array([len(x) + 1 for x in held])
            yield first, array(b"\n".join(held)), np.concatenate([[0], np.cumsum(lengths)[:-1]])
            first, held, total = i + 1, [], 0


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
