import random
from math import comb

import pytest

from txnwatch.llm import near_dedup
from txnwatch.llm.near_dedup import component_report, one_of_each


def sets(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute(rows, width=2, percent=80):
    """doc_id -> (set size, smallest reachable doc_id) by comparing all pairs that share a shingle."""
    have = {doc: sets(text, width) for doc, text in rows}
    root = {doc: doc for doc in have}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for doc, s in have.items():
        near = {}
        for w in s:
            for other in index.get(w, ()):
                near[other] = near.get(other, 0) + 1
            index.setdefault(w, []).append(doc)
        for other, common in near.items():
            if 100 * common >= percent * (len(s) + len(have[other]) - common):
                a, b = sorted((find(doc), find(other)))
                root[b] = a
    return {doc: (len(s), find(doc)) for doc, s in have.items()}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for family in range(30):
        base = rng.choices(vocabulary, k=rng.randint(10, 120))
        for _ in range(rng.choice([1, 1, 2, 3, 60 if family < 2 else 4])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 14))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append((len(out), " ".join(words)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("small", "block"), [(24, 256), (3, 256), (3, 5)])
def test_same_components_as_all_pairs(spark, rows, monkeypatch, small, block):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(component_report(df)) == brute(rows)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert found(component_report(df)) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "a b c"), (7, "A  b\nc"), (7, "A  b\nc"), (None, "a b c"), (None, "z")]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, sig string, cls int")
    out = sorted([tuple(r) for r in component_report(df).collect()], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert out == [
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 2, 6, True),
        (7, 2, 6, False), (7, 2, 6, False), (None, 1, None, True), (None, 2, 6, False),
    ]
    assert sorted((r.doc_id or 0, r.cls) for r in one_of_each(df, width=2).collect()) == [(0, 7), (1, 7), (2, 7), (3, 7), (4, 7), (6, 7)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert component_report(df).collect() == [] and one_of_each(df).collect() == []


def test_one_of_each_group_by_equal_and_null_ids(spark):
    """Near copies that share an id, or have none, leave one row a group."""
    text = lambda k, end: " ".join([f"g{k}x{i}" for i in range(60)] + [end])
    rows = [(1, text(0, "a")), (1, text(0, "b")), (1, text(0, "b")), (7, text(0, "c")), (1, text(1, "a")), (None, text(2, "a")), (None, text(2, "b"))]
    rows += [(None, text(3, "a")), (None, text(3, "a")), (4, text(4, "a")), (None, text(4, "b")), (None, None), (1, " ")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, top int").repartition(3)
    kept = one_of_each(df).collect()
    assert sorted((str(r.doc_id), (r.text or " ").split("x")[0]) for r in kept) == sorted(
        [("1", "g0"), ("1", "g1"), ("None", "g2"), ("None", "g3"), ("4", "g4"), ("None", " "), ("1", " ")]
    )


def test_near_misses_leave_few_candidates(spark, monkeypatch):
    """A family of texts of similarity about 0.65 meets in blocks; what is handed on follows its size, not its square."""
    made = []
    stored = near_dedup.stored

    def watched(df, name):
        out = stored(df, name)
        if name == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "stored", watched)
    rng = random.Random(2)
    most = {}
    for size in (150, 600):
        base = [f"b{i}" for i in range(120)]
        rows = []
        for k in range(size):
            words = list(base)
            for i in rng.sample(range(120), 12):
                words[i] = f"x{rng.randrange(10**6)}"
            rows.append((k, " ".join(words)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        made.clear()
        assert found(component_report(df)) == brute(rows)
        most[size] = max(made)
    assert most[600] <= 60 * 600 and most[600] <= 8 * max(most[150], 600)


@pytest.mark.parametrize("level, least", [(3, 0.9998), (4, 0.9993), (5, 0.998), (10, 0.972), (14, 0.931)])
def test_recall_over_shared_places(level, least):
    """A pair of similarity 0.8 agrees in a binomial number of places, and all trees draw from these."""

    def kept(share):
        below = 1.0
        for _ in range(level - 1):
            below = 0.75 * share * below + 0.25 * (1 - (1 - share * below) ** 2)
        return 1 - (1 - share * below) ** near_dedup.TREES

    n = near_dedup.PLACES
    assert sum(comb(n, k) * 0.8**k * 0.2 ** (n - k) * kept(k / n) for k in range(n + 1)) >= least


@pytest.mark.parametrize("few", [8192, 0])
def test_dense_nodes_hand_on_links_only(spark, monkeypatch, few):
    """Texts of similarity about 0.76 meet in blocks and are compared there; no step makes rows for all their pairs."""
    monkeypatch.setattr(near_dedup, "FEW", few)
    made = []
    stored = near_dedup.stored

    def watched(df, name):
        out = stored(df, name)
        made.append((out.count(), name))
        return out

    monkeypatch.setattr(near_dedup, "stored", watched)
    rng = random.Random(5)
    rows = []
    for k in range(400):
        words = [f"b{i}" for i in range(120)]
        for i in rng.sample(range(120), 4):
            words[i] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(component_report(df)) == brute(rows)
    # Small nodes give some pairs a class; there are 79,800 in all.
    assert max(n for n, name in made if name in ("pairs", "turn")) <= 100 * len(rows)
    assert max(n for n, name in made if name == "links") <= 4 * len(rows)


@pytest.mark.parametrize("copies", [150, 600])
def test_candidates_are_looked_up_once(spark, monkeypatch, copies):
    """A large group of near copies: components are looked up once a candidate, not in every turn again."""
    made, looked = [], []
    stored, rooted = near_dedup.stored, near_dedup.Links.rooted

    def watched(df, name):
        out = stored(df, name)
        if name == "pairs":
            made.append(out.count())
        return out

    def counted(self, pairs):
        if not self.groups.isEmpty():
            looked.append(pairs.count())
        return rooted(self, pairs)

    monkeypatch.setattr(near_dedup, "stored", watched)
    monkeypatch.setattr(near_dedup.Links, "rooted", counted)
    rng = random.Random(7)
    rows = []
    for k in range(copies):
        words = [f"b{i}" for i in range(120)]
        words[rng.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(component_report(df)) == brute(rows)
    # ``made`` lists what the levels propose and, again, all of it.
    assert sum(looked) <= max(made) + 4 * copies
    assert max(made) <= 100 * copies


def test_blocks_are_bounded_by_shingles(spark, rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_WORDS", 200)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(component_report(df)) == brute(rows)


def test_texts_go_to_python_in_short_batches(spark, monkeypatch):
    key, seen, stored = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, near_dedup.stored
    before = spark.conf.get(key)

    def watched(df, name):
        seen[name] = int(df.sparkSession.conf.get(key))
        return stored(df, name)

    monkeypatch.setattr(near_dedup, "stored", watched)
    text = " ".join(f"w{i}" for i in range(60))
    component_report(spark.createDataFrame([(1, text + " a"), (2, text + " b")], "doc_id long, text string")).collect()
    assert seen["sketches"] <= 1024 and seen["sets"] <= 1024
    assert spark.conf.get(key) == before
