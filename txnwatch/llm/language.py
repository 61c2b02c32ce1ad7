"""Language identification by compression.

Each language has a zstandard dictionary of raw text. Texts are lower-cased and runs of anything but letters
become one space, in dictionaries and predictions alike. A text belongs to the language whose dictionary
compresses it to the fewest bytes. Where the runner-up is nearly as small the answer is marked ``rejected``.

The dictionaries come from a bounded sample: per language at most ``Settings.docs`` documents, those with the
smallest MD5 (first 32 bits) of their id among the learnable ones, and ``Settings.dictionary`` bytes. There is one dictionary per
learned value of ``lang``, at most ``Settings.languages`` of them (the commonest).

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected; without anything to learn
from every text is ``und``; ties go to the commoner language, then the smaller name; repeated rows are
treated alike; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnwatch.llm.shared import same_columns

LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Settings:
    docs: int = 96  # sampled documents per language
    longest: int = 20_000  # characters of a sampled document at most
    dictionary: int = 112 << 10
    languages: int = 512
    level: int = 6
    margin: float = 0.01  # a runner-up within this share of the smallest size rejects


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def id_hash(doc_id: Column) -> Column:
    """The first 32 bits of the MD5 of the id's text."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hash_bound(wanted: int, there: int) -> int:
    """Below this hash lie about ``wanted`` of ``there`` rows, all of them if there are few."""
    return min(1 << 32, (wanted << 32) // max(1, there) + 1)


def plain(text: str) -> bytes:
    """Lower-case letters and single spaces."""
    return OTHER.sub(" ", text.lower()).encode()


def learn(docs: DataFrame, settings: Settings = Settings()) -> list[tuple[str, bytes]]:
    """Dictionaries from the columns doc_id, text and lang, commonest language first."""
    usable = docs.filter("lang is not null and text is not null")
    counted = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(settings.languages).collect()
    order = id_hash(F.col("doc_id"))
    best = W.partitionBy("lang").orderBy("order", "doc_id")
    # A hash bound per language leaves about four times the sample, so the window ranks few rows.
    bound = F.lit(0).cast("long")
    for row in counted:
        bound = F.when(F.col("lang") == row["lang"], F.lit(hash_bound(4 * settings.docs, row["count"]))).otherwise(bound)
    sample = (
        usable.filter(F.length("text").between(1, settings.longest) & (order < bound))
        .select("lang", order.alias("order"), "doc_id", "text")
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= settings.docs)
        .orderBy("lang", F.desc("rank"))
        .collect()
    )
    pools: dict[str, dict[str, None]] = {row["lang"]: {} for row in counted}
    for row in sample:
        if row["lang"] in pools:
            pools[row["lang"]][row["text"]] = None
    return [(lang, plain(" ".join(pool))[-settings.dictionary :]) for lang, pool in pools.items() if pool]


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (share of the best under 2^-bits) and rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        machines = []
        for lang, content in sent.value:
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=settings.level)
            machines.append((lang, zstandard.ZstdCompressor(level=settings.level, dict_data=raw, write_content_size=False)))

        def judge(text: str | None) -> tuple[str, float, bool]:
            if not machines or not text or not LETTER.search(text):
                return "und", 0.0, True
            data = plain(text)
            sizes = [len(m.compress(data)) for _, m in machines]
            best = min(sizes)
            score = 1.0 / sum(2.0 ** -min(60, s - best) for s in sizes)
            second = sorted(sizes)[1] if len(sizes) > 1 else 2 * best
            return machines[sizes.index(best)][0], score, second - best < settings.margin * best

        for batch in batches:
            rows = [judge(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.float64()),
                    pa.array([r[2] for r in rows], pa.bool_()),
                ],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return same_columns(docs, ["doc_id", "text"]).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def language_id(docs: DataFrame, folds: int = 5, settings: Settings = Settings()) -> DataFrame:
    """Learn from documents outside fold 0 and predict every document; ``held_out`` marks fold 0."""
    rows = same_columns(docs, ["doc_id", "text", "lang"])
    found = learn(rows.filter(fold(F.col("doc_id"), folds) != 0), settings)
    return identify(rows, found, settings).select(
        "doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "lang_pred", "score", "rejected"
    )
