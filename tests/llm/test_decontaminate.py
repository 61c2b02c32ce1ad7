import random
from collections import Counter

import pytest

from txnwatch.llm import decontaminate
from txnwatch.llm.decontaminate import leak_report, without_leaks


def grams(words, width):
    return Counter(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(docs, items, width=5, least=0.8):
    """doc -> item ids found, by comparing every window of every item's size that shares a shingle."""
    sets = {i: (len(t.lower().encode().split()), t.lower().encode().split()) for i, t in items if (t or "").split()}
    weight = lambda g: sum(map(len, g))
    out = {}
    for doc, text in docs:
        words, found = (text or "").lower().encode().split(), []
        for item, (n, w) in sets.items():
            want = grams(w, min(width, n))
            have = set(grams(words, min(width, n))) if words else set()
            if not have & set(want):
                continue
            for s in range(max(1, len(words) - n + 1)):
                window = grams(words[s : s + n], min(width, n))
                keys = window.keys() | want.keys()
                if sum(weight(g) * min(window[g], want[g]) for g in keys) >= least * sum(weight(g) * max(window[g], want[g]) for g in keys):
                    found.append(item)
                    break
        out[doc] = sorted(found)
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(60)]
    items += [(60, items[7][1].upper()), (61, "Éa ÖB " * 9), (62, None), (63, " ")]
    docs = []
    for k in range(250):
        words = rng.choices(vocabulary, k=rng.randint(0, 150))
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items[:62])[1].split()
            for _ in range(rng.randint(0, 2)):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = part
        docs.append((k, " ".join(words)))
    return docs + [(900, None), (901, ""), (902, items[3][1])], items


@pytest.mark.parametrize("group", [20_000, 25])
def test_same_as_all_windows(spark, tables, monkeypatch, group):
    monkeypatch.setattr(decontaminate, "ITEMS", group)
    docs, items = tables
    out = leak_report(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()
    got, want = {r.doc_id: list(r.item_ids) for r in out}, brute(docs, items)
    assert len(out) == len(docs)
    assert got == want


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    out = leak_report(docs, items).collect()
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert {r.doc_id: list(r.item_ids) for r in out} == want
    assert all(r.kept == (not want[r.doc_id]) for r in out)
    assert {r.doc_id for r in without_leaks(docs, items).collect()} == {k for k, v in want.items() if not v}


def test_edge_cases(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, "x " + text + " y", 1), (1, "x " + text + " y", 1), (None, text, 1), (None, "z", 1), (2, "w " * 60000 + text, 1)], "doc_id long, text string, items int")
    items = spark.createDataFrame([(5, text, 0), (6, text, 0), (None, "z", 0)], "item_id long, text string, t int")
    assert sorted((str(r.doc_id), r.n_items) for r in leak_report(docs, items).collect()) == [("1", 2), ("1", 2), ("2", 2), ("None", 0), ("None", 2)]
    assert [(r.doc_id, r.text) for r in without_leaks(docs, items).collect()] == [(None, "z")]
    assert leak_report(docs.limit(0), items).collect() == [] and all(r.kept for r in leak_report(docs, items.limit(0)).collect())


@pytest.mark.parametrize("group", [20_000, 3, 1])
def test_repeated_rows_and_many_items(spark, monkeypatch, group):
    """The size of the item groups changes nothing, also where rows share id and text."""
    monkeypatch.setattr(decontaminate, "ITEMS", group)
    texts = [" ".join(f"q{k}x{i}" for i in range(9)) for k in range(8)]
    rows = [(1, f"{texts[0]} and {texts[5]}")] * 3 + [(None, texts[1])] * 2 + [(None, "z")] * 2 + [(None, None)] * 2 + [(2, f"{texts[0]} {texts[2]}"), (2, texts[3]), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    out = sorted(((str(r.doc_id), r.kept, r.n_items, list(r.item_ids), r.similarity) for r in leak_report(docs, items).collect()), key=str)
    assert out == sorted(
        [("1", False, 2, [0, 5], 1.0)] * 3 + [("None", False, 1, [1], 1.0)] * 2 + [("None", True, 0, [], None)] * 4
        + [("2", False, 2, [0, 2], 1.0), ("2", False, 1, [3], 1.0), ("3", True, 0, [], None)], key=str
    )
    assert sorted(((str(r.doc_id), r.text) for r in without_leaks(docs, items).collect()), key=str) == sorted([("None", "z")] * 2 + [("None", None)] * 2 + [("3", "")], key=str)


@pytest.mark.parametrize("group", [1])
def test_edge_cases_in_small_groups(spark, monkeypatch, group):
    monkeypatch.setattr(decontaminate, "ITEMS", group)
    test_edge_cases(spark)
