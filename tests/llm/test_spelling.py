import random
import zlib
from collections import Counter, defaultdict

import pytest

from txnwatch.llm import spelling
from txnwatch.llm.spelling import near_words, spelling_report, spelling_variants

LETTERS = [*"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *map(chr, range(0xC0, 0x100))]


def edit_once(word, rng, letters="abé"):
    k = rng.randrange(len(word) + 1)
    return rng.choice([word[:k] + rng.choice(letters) + word[k:], word[: max(k - 1, 0)] + word[k:], word[: max(k - 1, 0)] + rng.choice(letters) + word[k:]])


def near(word):
    """Every string one edit away over the letters a word can have."""
    low = [c for c in LETTERS if not "A" <= c <= "Z"]
    out = {word[:k] + word[k + 1 :] for k in range(len(word))}
    out |= {word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in low}
    out |= {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in low}
    return out - {word}


def tokens(text):
    run = ""
    for c in text + " ":
        if c in LETTERS:
            run += c.lower() if "A" <= c <= "Z" else c
        elif run:
            yield run
            run = ""


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in tokens(text or ""):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    links = {w: sorted(near(w) & n.keys()) if len(w) < 1000 else [] for w in n}
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(links[w]), None if form[w] is None else n[form[w]]))
    return out


def made(rows=300):
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcdé") for _ in range(rng.randint(6, 9))) for _ in range(25)]
    pool = Counter()
    for k, s in enumerate(stems):
        pool[s] += 120 if k % 3 else 8
        for _ in range(8):
            v = edit_once(s, rng)
            pool[v] += rng.choice([1, 2, 9])
            pool[edit_once(v or "x", rng)] += 1
    words = list(pool.elements())
    return [(d, " ".join(rng.choice(["", "1", "-"]) + w.title() if rng.random() < 0.2 else w for w in rng.choices(words, k=25))) for d in range(rows)]


@pytest.fixture(scope="module")
def rows():
    return made()


def found(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("held", [200_000, 3])
def test_same_as_all_edits(spark, rows, monkeypatch, held):
    monkeypatch.setattr(spelling, "HELD", held)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows)
    assert found(spelling_report(docs)) == expected
    assert any(r[1] for r in expected) and any(r[2] != r[1] for r in expected if r[1])


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(spelling_report(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("parts", [3, 5])
def test_every_pair_once_whatever_the_length(spark, parts):
    rng = random.Random(1)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(300)}
    words |= {"a" * 5000, "a" * 4999 + "b", "a" * 5001, "ab" * 2500, "ÿ×÷", "ÿ×"}
    counts = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    pairs = [(r.a, r.b) for r in near_words(counts, parts).collect()]
    short = sorted(w for w in words if len(w) < 100)
    expected = {(w, o) for w in short for o in near(w) & words if w < o}
    long = sorted(words - set(short))
    expected |= {(a, b) for a in long for b in long if a < b and (len(a), len(b)) in {(5000, 5001), (5001, 5000)} and set(a + b) == {"a"}}
    expected |= {("a" * 5000, "a" * 4999 + "b")}
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == expected


def test_ties_chains_and_hot_words(spark):
    counts = [("abcdefg", 1), ("abcdefh", 10), ("abcdefi", 10), ("abcdeff", 9), ("abcdefhh", 1000)]
    got = {r.word: r for r in spelling_variants(spark.createDataFrame(counts, "word string, n long")).collect()}
    assert got["abcdefg"].form == "abcdefh" and got["abcdefg"].root == "abcdefhh"
    assert got["abcdeff"].form is None and got["abcdeff"].root == "abcdeff" and got["abcdeff"].n_near == 3
    assert got["abcdefhh"].n_near == 1 and got["abcdefhh"].form is None


def test_edge_cases(spark):
    schema = "key int, doc_id long, n string, text string, word string"
    assert spelling_report(spark.createDataFrame([], schema)).collect() == []
    big = "wordword" * 20000
    rows = [(1, 1, "x", None, "w"), (2, 2, "x", "", "w"), (3, None, None, "Example EXAMPLE exampl", None), (3, None, None, "Example EXAMPLE exampl", None),
            (4, 7, "", f"{big} {big} 12 exämple exämple", "")]
    assert found(spelling_report(spark.createDataFrame(rows, schema))) == brute([(r[1], r[3]) for r in rows])


def test_no_join_broadcasts_words(spark, rows, monkeypatch):
    plans, stored = [], spelling.stored

    def ran(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(spelling, "stored", lambda df, name: stored(ran(df), name))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) > 1_000_000
    ran(spelling_report(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum("Join" in plan for plan in plans) >= 4
    assert not [plan for plan in plans if "Broadcast" in plan]
