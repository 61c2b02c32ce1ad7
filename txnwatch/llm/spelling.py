"""Spelling variants: words within one edit of each other, found by PartEnum signatures of their letters.

A word's letter multiset is a binary vector with one dimension per (letter, occurrence). One inserted or deleted
code point changes one dimension, a replaced one two, so near words lie within Hamming distance two. The dimensions
are dealt into ``parts``; two differences touch at most two parts, so near words agree on some choice of
``parts - 2`` of them. Every such choice is a signature. One edit also leaves the first or the last half of the
shorter word as it is, so a signature is joined together with that half. Equal keys are joined in Spark and
each candidate is verified by its edit distance; nothing is capped, and a hot key is split by the join.
No join sends its words through the driver (see ``MERGE``).

Defined cases: a null or empty text has no words; a null id counts as empty text when runs are damaged; repeated
rows count each time; ties of the largest count go to the smallest word in code-point order; words of any length
are compared as a whole; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.shared import same_columns, stored
from txnwatch.llm.words import HEAD, array, list_column, mix, powers, span_hash, sums

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Distinct words a task holds before it hands its counts on.
HELD = 200_000
DISTANCE = 2
# Hint of every join on words. Spark would size written words by their compressed files, and the keys of a word as
# one row, and broadcast tables many times larger than it allows.
MERGE = "merge"


def runs(text: str) -> Counter[str]:
    """The letter runs of a text, A-Z lowered, with their number of occurrences."""
    return Counter(RUN.findall(text.translate(LOWER)))


def damaged(run: str, doc_id: str, every: int) -> str:
    """The run without one code point if the checksum of id and run is a multiple of ``every``."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, every: int | None = None) -> DataFrame:
    """Columns word, n: the words of whole texts and how often each occurs in all of them.

    ``every`` damages runs first (see ``damaged``), which plants known variants; None leaves them alone. Tasks
    add up what they have read, so a frequent word is shuffled a few times per task.
    """

    def count(batches):
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for run, n in runs(text or "").items():
                    word = run if every is None else damaged(run, "" if doc_id is None else str(doc_id), every)
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    found = same_columns(docs, ["doc_id", "text"]).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def letter_parts(words: list[str], parts: int) -> np.ndarray:
    """Per word and part, a hash of the word's vector in the dimensions of that part."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.array([len(w) for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    ordered = np.sort((owner << 21) | letters)
    place = np.arange(len(ordered))
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    occurrence = place - np.maximum.accumulate(np.where(first, place, 0))
    dimension = mix(((ordered & 0x1FFFFF).astype(np.uint64) << np.uint64(32)) + occurrence.astype(np.uint64) + np.uint64(1))
    out = np.zeros((len(words), parts), np.uint64)
    np.add.at(out, (owner, (dimension >> np.uint64(17)) % np.uint64(parts)), mix(dimension))
    return out


def halves(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words' first and last halves, as (hash, words that have it).

    A pair's half is half the length of its shorter word, so a word of even length has two of each kind.
    """
    encoded = [w.encode() for w in words]
    buf = array(b"".join(encoded))
    starts = np.concatenate([np.flatnonzero(HEAD[buf]), [len(buf)]])
    ends = np.cumsum([len(w) for w in words])
    begins = ends - np.array([len(w) for w in words], np.int64)
    powers(len(buf))
    run = sums(buf)
    found = []
    for shorter in (0, 1):
        size = (ends - begins - shorter) // 2
        mine = np.flatnonzero((size != (ends - begins) // 2) | (shorter == 0))
        b, e, s = begins[mine], ends[mine], size[mine]
        found.append((span_hash(run, starts[b], starts[b + s]), mine))
        found.append((span_hash(run, starts[e - s], starts[e]) + np.uint64(1), mine))
    return found


def signatures(words: list[str], parts: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """All join keys: 64-bit keys and the index of the word each belongs to."""
    each = letter_parts(words, parts)
    weights = mix(np.arange(1, parts + 1, dtype=np.uint64))
    keys, owners = [], []
    ends = halves(words)
    for number, chosen in enumerate(combinations(range(parts), parts - DISTANCE)):
        agreed = mix((each[:, chosen] * weights[list(chosen)]).sum(axis=1, dtype=np.uint64) + np.uint64(number))
        for half, mine in ends:
            keys.append(mix(agreed[mine] + half))
            owners.append(mine)
    return np.concatenate(keys), np.concatenate(owners)


def near_words(counts: DataFrame, parts: int = 5) -> DataFrame:
    """Pairs a, b (a before b) of words of ``counts`` that differ by one edit, with their counts a_n, b_n."""

    def keyed(batches):
        for batch in batches:
            words, n = batch.column(0), batch.column(1)
            if not len(words):
                continue
            keys, owners = signatures(words.to_pylist(), parts)
            order = np.argsort(owners, kind="stable")
            lists = list_column(keys[order].view(np.int64), np.bincount(owners, minlength=len(words)), pa.int64())
            yield pa.RecordBatch.from_arrays([lists, words, n], ["keys", "word", "n"])

    found = counts.select("word", "n").mapInArrow(keyed, "keys array<long>, word string, n long")
    rows = found.select(F.explode("keys").alias("key"), "word", "n")
    left = rows.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = rows.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    apart = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1)
    pairs = left.join(right.hint(MERGE), "key").filter(apart & (F.levenshtein("a", "b", 1) == 1))
    return pairs.groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))


def follow(forms: DataFrame) -> DataFrame:
    """Columns word, root: the end of each chain word -> form. Chains double in every round.

    Counts grow tenfold along a chain, so a few rounds are enough.
    """
    chain = forms.select("word", F.col("form").alias("root"))
    while True:
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = chain.join(further.hint(MERGE), "root", "left")
        chain = stored(moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if chain.filter("_moved").isEmpty():
            return chain.drop("_moved")
        chain = chain.drop("_moved")


def spelling_variants(counts: DataFrame, times: int = 10, parts: int = 5) -> DataFrame:
    """Groups of spelling variants among the words of ``counts`` (word, n).

    Columns word, n, n_near (number of near words), form (the near word of largest count, if that is at least
    ``times`` the word's own; else null), form_n, root (the end of the word's chain of forms).
    """
    words = stored(counts, "words")
    pairs = stored(near_words(words, parts), "near")
    both = pairs.union(pairs.select("b", "a", "b_n", "a_n"))
    best = both.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("minus"), F.col("b").alias("near"))).alias("best")
    )
    enough = -F.col("best.minus") >= times * F.col("n")
    judged = words.join(best.hint(MERGE), "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.minus")).alias("form_n"),
    )
    judged = stored(judged, "variants")
    roots = follow(judged.filter("form is not null"))
    return judged.join(roots.hint(MERGE), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_report(docs: DataFrame) -> DataFrame:
    """Variants among the words of at least seven code points of damaged texts."""
    found = spelling_variants(word_counts(docs, every=31))
    return found.select("word", "form", "root", "n", "n_near", "form_n")
