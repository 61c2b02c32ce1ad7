"""Quality rules, line first: clean each line, then reject documents that lose too much text.

Every line is judged on its own by punctuation, navigation and boilerplate rules. Failing lines are removed,
and a document is rejected when the words that remain are too few. One pass over the texts, no shuffle.

Defined cases: a null or empty text has no words, no lines and is rejected; a line without a word is neither
kept nor counted; repeated rows are judged alike; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from txnwatch.llm.shared import same_columns
from txnwatch.llm.words import HEAD, SPACE, array, mix, texts, words

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_bad_lines long, kept_words long, text string"
)
SYMBOLS = b"#*$%&|<>"
ENDS = re.compile(rb"[.!?:;]|\xe2\x80\xa6")
SEPARATORS = frozenset([b"|", b"/", b"-", b">", b"\xc2\xbb", b"\xe2\x80\xba", b"\xc2\xb7", b"\xe2\x80\xa2"])
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Bounds of the rules; shares are percent of a line's or a document's words."""

    symbols: int = 20  # symbol characters
    marks: int = 25  # double exclamation or question marks
    separators: int = 20  # words that are only a separator
    bare_words: int = 8  # shorter lines need a sentence mark
    capitals: int = 50  # capitals among A-Z letters, in lines of at least capital_words words
    capital_words: int = 5
    phrase_words: int = 20  # a boilerplate phrase condemns lines up to this length
    phrases: tuple[bytes, ...] = (
        b"all rights reserved", b"privacy policy", b"terms of use", b"terms of service", b"cookie",
        b"enable javascript", b"click here", b"sign up", b"log in", b"subscribe to", b"share this",
    )
    least_words: int = 20
    repeat: int = 30
    kept: int = 50  # words that must remain


def bad_line(line: bytes, tokens: list[bytes], rules: Rules) -> bool:
    """The verdict of the punctuation, navigation and boilerplate rules on one line with words."""
    n = len(tokens)
    if 100 * sum(line.count(x) for x in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")) > rules.symbols * n:
        return True
    if 100 * (line.count(b"!!") + line.count(b"??")) > rules.marks * n:
        return True
    if n < rules.bare_words and not ENDS.search(line):
        return True
    if 100 * sum(t in SEPARATORS for t in tokens) > rules.separators * n:
        return True
    if n >= rules.capital_words:
        upper = len(line) - len(line.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        lower = len(line) - len(line.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
        if 100 * upper > rules.capitals * (upper + lower):
            return True
    low = line.lower()
    return n <= rules.phrase_words and any(p in low for p in rules.phrases)


def repeated_words(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words inside a window of ``width`` words that occurs at least twice in the text."""
    n = len(hashes) - width + 1
    if n < 2:
        return 0
    h, reach = hashes, 1
    while reach < width:
        h = mix(h[:-reach] * np.uint64(3) + h[reach:] + np.uint64(reach))
        reach *= 2
    order = np.argsort(h)
    ranked = h[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    step[at] += 1
    step[at + width] -= 1
    return int((np.cumsum(step) > 0).sum())


def judge(text: bytes | None, rules: Rules) -> tuple:
    """All measures of one text and the text without its bad lines."""
    raw = text or b""
    buf = array(raw)
    counts = np.bincount(buf, minlength=256)
    hashes = words(buf)[2]
    n = len(hashes)
    seen: set[bytes] = set()
    dup = lines = bad = kept_words = 0
    good = []
    for line in raw.split(b"\n"):
        tokens = line.split()
        if not tokens:
            continue
        lines += 1
        dup += line in seen
        seen.add(line)
        if bad_line(line, tokens, rules):
            bad += 1
        else:
            kept_words += len(tokens)
            good.append(line)
    repeats = repeated_words(hashes)
    failed = n < rules.least_words or 100 * repeats > rules.repeat * n
    return (
        n, int(counts[HEAD & ~SPACE].sum()), int(counts[list(SYMBOLS)].sum()), dup, repeats, failed,
        not failed and 100 * kept_words >= rules.kept * n, lines, bad, kept_words,
        None if text is None else b"\n".join(good).decode(),
    )


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: its measures, the verdict ``kept`` and the cleaned ``text``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()] * 3 + [pa.string()]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [judge(text, rules) for text in texts(part.column(1))]
                data = [part.column(0).cast(pa.int64())] + [
                    pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds[1:])
                ]
                yield pa.RecordBatch.from_arrays(data, names)

    return same_columns(docs, ["doc_id", "text"]).mapInArrow(run, SCHEMA)
