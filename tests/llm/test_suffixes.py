import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from txnwatch.llm import suffixes
from txnwatch.llm.suffixes import SPAN, deep_shallow, repeat_report


def brute(rows):
    """doc -> (bytes, removed, runs, hash of the rest), by counting every string of SPAN bytes."""
    data = [(doc, (text or "").encode()) for doc, text in rows]
    seen = Counter(t[i : i + SPAN] for _, t in data for i in range(len(t) - SPAN + 1))
    out = []
    for doc, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - SPAN + 1):
            if seen[t[i : i + SPAN]] > 1:
                gone[i : i + SPAN] = b"\1" * SPAN
        runs = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(t)))
        out.append((doc, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in repeat_report(df).collect()), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=90).map(lambda b: bytes(x & 3 for x in b)), min_size=1, max_size=25))
def test_deep_shallow_sorts(items):
    items = items + [items[0] + b"\1" * 40, items[0]]
    order = deep_shallow(items)
    assert sorted(order) == list(range(len(items)))
    assert [items[k] for k in order] == sorted(items)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 8))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passages = [prose(rng.randint(70, 250)) for _ in range(5)]
    out = []
    for doc in range(90):
        text = prose(rng.randint(0, 300))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            low = rng.randint(0, len(p) // 3)
            text += " " + p[low : low + rng.randint(200, len(p))] + " " + prose(rng.randint(0, 150))
        out.append((doc, text))
    out += [(90, out[3][1]), (91, out[3][1]), (92, "ab " * 400), (93, "x" * 399), (94, "x" * 401), (95, prose(200) + passages[0] + passages[0])]
    return out


@pytest.mark.parametrize("big", [1024, 3])
@pytest.mark.parametrize("piece", [1 << 19, 700])
def test_same_as_counting_all_strings(spark, rows, monkeypatch, big, piece):
    monkeypatch.setattr(suffixes, "BIG", big)
    monkeypatch.setattr(suffixes, "PIECE", piece)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(df) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_edge_cases(spark):
    long = "é" * 150 + "b" * 200 + "ü" * 90
    rows = [(1, None), (2, ""), (3, "a b"), (4, long), (4, long), (None, "z" + long)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, t int, anchor int")
    assert found(df) == brute(rows)


def test_empty_table(spark):
    assert repeat_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_texts_pass_python_once_at_most(spark, monkeypatch):
    """Texts without repeats stay in Spark at the end, and filters by key send Python the key alone."""
    key, seen, stored = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, suffixes.stored
    before = spark.conf.get(key)

    def watched(df, name):
        seen[name] = int(df.sparkSession.conf.get(key))
        return stored(df, name)

    monkeypatch.setattr(suffixes, "stored", watched)
    text = "".join(chr(97 + i * i % 23) for i in range(900))
    out = suffixes.remove_repeats(spark.createDataFrame([(1, text), (2, text), (3, "ä"), (4, None)], "doc_id long, text string"))
    assert out._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
    assert seen["anchors"] <= 1024 and seen["surroundings"] <= 1024 and spark.conf.get(key) == before
    rows = {r.doc_id: (r.n_bytes, len(r.runs), bytes(r.kept)) for r in out.collect()}
    assert rows == {1: (900, 1, b""), 2: (900, 1, b""), 3: (2, 0, "ä".encode()), 4: (0, 0, b"")}
