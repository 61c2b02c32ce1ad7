"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And mask. Each byte of a canonical URL moves the states of
all rules at once, for all URLs of a batch side by side. ``*`` stands for any bytes, ``?`` for one byte.

The canonical form is ``.host#path``: host and path can hold no ``#``, so a rule cannot slip from one
into the other, and the leading dot lets ``.org#/`` mean a host and all its subdomains.

Defined cases: a null url or one without ``://`` has an empty host and path and canonical form ``.#``; an empty
table gives an empty one; extra columns are ignored; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from txnwatch.llm.shared import same_columns

# Rules by host and start of path; the longest that fits decides.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# Globs over the canonical form for URLs that no rule decides.
BLOCKED = (
    "*casino*#*", "*poker*#*", "*-bets.*#*", "*porn*#*", "*.adult-*#*", "*xxx*#*", "*viagra*#*", "*pills*#*", "*.spam-*#*",
    "*.ads.*#*", "*.ads-*#*", "*.adserver.*#*",
    "*#*/ads/*", "*#*/banner/*", "*#*/login*", "*#*/signup*", "*#*.exe", "*#*.zip",
)
URL = re.compile(rb"://([^/?#]*)([^?#]*)", re.S)
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    """Host (A-Z folded) and path."""
    found = URL.search(url or b"")
    return (found[1].translate(UPPER), found[2]) if found else (b"", b"")


class Automaton:
    """Masks of many globs: one bit per byte of a rule, rules one after the other over 64-bit words."""

    def __init__(self, globs: Sequence[str]) -> None:
        accept, start, loop, at = [], 0, 0, 0
        masks = [0] * 256
        for glob in globs:
            # Bit at: nothing read yet; a star keeps the bit before it alive.
            start |= 1 << at
            for byte in glob.encode():
                if byte == ord("*"):
                    loop |= 1 << at
                    continue
                at += 1
                for b in range(256) if byte == ord("?") else (byte,):
                    masks[b] |= 1 << at
            accept.append(at)
            at += 1
        self.n_words = max(1, -(-at // 64))
        self.start, self.loop = self._row(start), self._row(loop)
        self.masks = np.stack([self._row(m) for m in masks])
        self.accept = np.array(accept, np.int64)

    def _row(self, bits: int) -> np.ndarray:
        return np.array([(bits >> (64 * k)) & (2**64 - 1) for k in range(self.n_words)], np.uint64)

    def matches(self, rows: list[bytes]) -> np.ndarray:
        """A table of URLs by globs that says which match as a whole."""
        lengths = np.array([len(r) for r in rows], np.int64)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(rows) + b"\0", np.uint8)
        begin = (np.cumsum(lengths) - lengths)[order]
        size = lengths[order]
        state = np.tile(self.start, (len(rows), 1))
        one, high = np.uint64(1), np.uint64(63)
        for k in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-size, -k, "left"))  # URLs longer than k
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> high
            state[:live] = (moved & self.masks[data[begin[:live] + k]]) | (now & self.loop)
        out = np.zeros((len(rows), len(self.accept)), bool)
        out[order] = (state[:, self.accept // 64] >> (self.accept % 64).astype(np.uint64)) & one == 1
        return out


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    blocked: Sequence[str] = BLOCKED,
) -> DataFrame:
    """One row per page: page_id, url, host, path, the deciding ``rule`` and the ``verdict`` allow or block.

    ``rules`` are (verdict, host, start of path). Of several that fit the longest text wins, at equal length
    the later one. Without a fitting rule a page is blocked if a glob of ``blocked`` matches.
    """
    globs = [f"*.{host}#{path}*" for _, host, path in rules] + list(blocked)
    length = np.array([len(host + path) for _, host, path in rules], np.int64)
    names = [host + path for _, host, path in rules]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        machine = Automaton(globs)
        for batch in batches:
            urls = batch.column(1).cast(pa.large_binary()).to_pylist()
            parts = [split_url(u) for u in urls]
            hit = machine.matches([b"." + h + b"#" + p for h, p in parts])
            fits, listed = hit[:, : len(rules)], hit[:, len(rules) :].any(axis=1)
            score = np.where(fits, length * (len(rules) + 1) + np.arange(1, len(rules) + 1), 0)
            best = score.argmax(axis=1) if len(rules) else np.zeros(len(parts), np.int64)
            ruled = fits.any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(1).cast(pa.string()),
                    pa.array([h.decode() for h, _ in parts], pa.string()),
                    pa.array([p.decode() for _, p in parts], pa.string()),
                    pa.array([names[b] if r else None for r, b in zip(ruled, best, strict=True)], pa.string()),
                    pa.array(
                        [rules[b][0] if r else "block" if x else "allow" for r, b, x in zip(ruled, best, listed, strict=True)],
                        pa.string(),
                    ),
                ],
                ["page_id", "url", "host", "path", "rule", "verdict"],
            )

    return same_columns(pages, ["page_id", "url"]).mapInArrow(
        run, "page_id long, url string, host string, path string, rule string, verdict string"
    )
