import random

import duckdb

from txnwatch.llm.quality_rules import quality_rules
from txnwatch.llm.sql import SQL

BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(doc, text):
    words, lines = (text or "").encode().split(), (text or "").split("\n")
    full = [x for x in lines if x.encode().split()]
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for at in grams.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    n = len(words)
    return (
        doc, n, sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(covered),
        n < 20 or 100 * len(covered) > 30 * n,
    )


def test_measures(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices(["a ", "b ", "cé ", "#", "\n", "\t", "|", " ", "x y z a b c d e f\n"], k=rng.randint(0, 90)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "\x1c \x85\xa0 w\x0bv"), (503, "r " * 5000), (504, "r " * 5000)]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).select(*BASE).collect()
    assert sorted(map(tuple, got)) == sorted(brute(*r) for r in rows)


def test_lines_and_verdict(spark):
    good = "The cat of the house was in, and it sat on the mat.\nAnother day it went out to the garden of a friend.\nWe saw it there at noon, asleep."
    menu = "Home\nAbout us\nContact\n"
    rows = [
        (1, good, 0), (2, menu + good + "\nAll rights reserved.", 0), (3, " | ".join(f"item{i}" for i in range(40)), 0),
        (4, " ".join(f"W{i}#" for i in range(60)), 0), (5, " ".join(f"SHOUT{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'[i]}!!" for i in range(25)), 0), (None, None, 0),
    ]
    out = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect()}
    assert [out[k].kept for k in (1, 2, 3, 4, 5, None)] == [True, True, False, False, False, False]
    assert out[2].text == good and out[2].n_bad_lines == 4 and out[None].text is None
    assert not any(out[k].base_failed for k in (1, 2, 3, 4, 5))


def test_sql_agrees(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    df = quality_rules(spark.read.parquet(path)).drop("text")
    want = duckdb.sql(f"with documents as (select * from '{path}') {SQL['op1_quality_rules'].strip().replace('with d as', ', d as', 1)}").df()[df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(x) for x in want.itertuples(index=False))


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []
