import random

import pytest
from pyspark.sql import functions as F

from txnwatch.llm import line_dedup
from txnwatch.llm.line_dedup import line_report, without_lines


def brute(rows, percent=80):
    """doc_id -> (lines with words, removed line numbers), by comparing every line with all earlier ones."""
    order = sorted({(r[0] is None, r[0], r[1]) for r in rows}, key=lambda x: (x[0], x[1] or 0))
    earlier, out = [], {}
    index = {}
    for _, doc, text in order:
        gone, n = [], 0
        for k, line in enumerate((text or "").split("\n")):
            words = frozenset(line.encode().lower().split())
            if not words:
                continue
            n += 1
            near = {i for w in words for i in index.get(w, ())}
            if any(100 * len(words & earlier[i]) >= percent * len(words | earlier[i]) for i in near):
                gone.append(k)
            for w in words:
                index.setdefault(w, []).append(len(earlier))
            earlier.append(words)
        out[doc] = (n, gone)
    return out


def found(df):
    return {r.doc_id: (r.n_lines, [int(x) for x in r.removed_lines.split(",") if x]) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(120)]
    out, pool = [], []
    for doc in range(150):
        lines = []
        for _ in range(rng.randint(0, 5)):
            if pool and rng.random() < 0.5:
                words = list(rng.choice(pool))
                for _ in range(rng.randint(0, 3)):
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            else:
                words = rng.choices(vocabulary, [1 / (i + 1) for i in range(120)], k=rng.randint(1, 25))
                if rng.random() < 0.1:
                    words = rng.sample([f"z{i}" for i in range(400)], k=rng.randint(90, 130))
            pool.append(words)
            lines.append(" ".join(words).title() if rng.random() < 0.2 else " ".join(words))
        out.append((doc, "\n".join(lines)))
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
@pytest.mark.parametrize("keep", [4, 1])
def test_same_as_comparing_all_lines(spark, rows, monkeypatch, hot, keep):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", hot)
    monkeypatch.setattr(line_dedup, "KEEP", keep)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(line_report(df)) == brute(rows)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert found(line_report(df)) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b\n\na b"), (5, "A B"), (6, "one two three\nfour"), (6, "one two three\nfour"), (None, "four")]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, line string, t int")
    out = sorted(line_report(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.n_lines, r.removed_lines) for r in out] == [
        (1, 0, ""), (2, 0, ""), (3, 0, ""), (4, 2, "2"), (5, 1, "0"), (6, 2, ""), (6, 2, ""), (None, 1, "0"),
    ]
    kept = without_lines(df).orderBy(F.col("doc_id").asc_nulls_last()).collect()
    assert [(r.doc_id, r.text) for r in kept] == [
        (1, None), (2, ""), (3, " \n\t"), (4, "a b\n"), (6, "one two three\nfour"), (6, "one two three\nfour"),
    ]
    assert kept[0].asDict().keys() == {"doc_id", "text", "line", "t"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_report(df).collect() == [] and without_lines(df).collect() == []


@pytest.mark.parametrize("percent", [80, 75, 60, 50])
def test_short_lines(spark, percent):
    """Lines of few words against the same with a word more, in both orders."""
    rows = []
    for n in range(1, 6):
        for k in range(4):
            words = [f"s{n}x{k}x{i}" for i in range(n + 1)]
            pair = [" ".join(words), " ".join(words[: k % n] + words[k % n + 1 :])]
            rows += [(len(rows), pair[k % 2]), (len(rows) + 1, pair[1 - k % 2])]
    got = found(line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent))
    assert got == brute(rows, percent)
    least = next(n for n in range(1, 6) if 100 * n >= percent * (n + 1))
    assert sum(len(gone) for _, gone in got.values()) == 4 * (6 - least)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_blocks_of_frequent_words(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", hot)
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(line_report(df)) == brute(rows)


def test_no_group_grows_with_the_input(spark, monkeypatch):
    """Lines of one length over a small vocabulary: one word and size class has many lines, few of them alike."""
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 100)
    monkeypatch.setattr(line_dedup, "BLOCK", 40)
    rng = random.Random(5)
    rows = [(k, " ".join(rng.sample([f"w{i}" for i in range(20)], k=10))) for k in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sent = spark.sparkContext.broadcast(line_dedup.rarity(df))
    lines = line_dedup.stored(line_dedup.occurrences(df, sent, 80), "lines")
    large = line_dedup.large_groups(lines)
    assert line_dedup.prefix_rows(lines).groupBy("tok").count().agg(F.max("count")).first()[0] > 400
    assert line_dedup.cut_rows(lines, large).groupBy("tok", "part").count().agg(F.max("count")).first()[0] <= 80
    assert found(line_report(df)) == brute(rows)


def test_texts_go_to_python_in_short_batches(spark, monkeypatch):
    key, seen, stored = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, line_dedup.stored
    before = spark.conf.get(key)

    def watched(df, name):
        seen[name] = int(df.sparkSession.conf.get(key))
        return stored(df, name)

    monkeypatch.setattr(line_dedup, "stored", watched)
    line_dedup.line_report(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g")], "doc_id long, text string")).collect()
    assert seen["lines"] <= 1024 and seen["sets"] <= 1024
    assert spark.conf.get(key) == before


def test_prefix_entries_go_in_bundles(spark, rows, monkeypatch):
    """Few rows are shuffled, and they hold every entry: word, size, set, document, place and parity map."""
    shuffled, seen = [], line_dedup.bundles
    more = [(None, "n1 n2 n3 n4 n5 n6"), (-5, "n1 n2 n3 n4 n5 n6 n7"), (2**62, " ".join(f"n{k}" for k in range(250)))]
    df = spark.createDataFrame(rows + more, "doc_id long, text string").repartition(5)
    sent = spark.sparkContext.broadcast(line_dedup.rarity(df))
    lines = line_dedup.stored(line_dedup.occurrences(df, sent, 80), "lines")
    expected = {tuple(r) for r in line_dedup.prefix_rows(lines).select("tok", "n", "id", "doc", "spot", "p0", "p1", "p2", "p3").collect()}
    batches = line_dedup.listed_lines(lines).toArrow().to_batches()
    for batch in seen(batches, 10, None):
        shuffled.append(batch)
    assert sum(b.num_rows for b in shuffled) <= 1024 < len(expected)
    found, search = set(), line_dedup.search

    def kept(tok, n, ident, doc, spot, parity, *rest):
        columns = [tok.view("i4"), n, ident, doc, spot, *parity.view("i8").T]
        found.update(zip(*(c.tolist() for c in columns), strict=True))
        return search(tok, n, ident, doc, spot, parity, *rest)

    monkeypatch.setattr(line_dedup, "search", kept)
    monkeypatch.setattr(line_dedup, "GATHER", 50)
    assert len(list(line_dedup.unbundled(iter(shuffled), 10, 80, 4, 2))) > 10
    least = {}
    for tok, n, ident, doc, *more in expected:
        least[tok, n, ident, *more] = min(doc, least.get((tok, n, ident, *more), doc))
    assert found == {(tok, n, ident, doc, *more) for (tok, n, ident, *more), doc in least.items()}


@pytest.mark.parametrize("chunk", [1 << 20, 64])
def test_long_lines(spark, monkeypatch, chunk):
    """Lines about the lengths where parity maps become wider, and odd document ids."""
    monkeypatch.setattr(line_dedup, "CHUNK", chunk)
    rng = random.Random(11)
    vocabulary, rows = [f"v{k}" for k in range(900)], []
    for n in (96, 101, 150, 199, 205, 260, 400):
        line = rng.sample(vocabulary, n)
        for cut in (0, 2, 3, n // 12, n // 6, n // 4):
            words = line[cut:] + rng.sample([f"x{k}" for k in range(300)], rng.randint(0, n // 20))
            rows.append((rng.choice([-1, 1]) * rng.randrange(2**62), " ".join(rng.sample(words, len(words)))))
    rows.append((None, rows[3][1] + " more"))
    got = found(line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert got == brute(rows)
    assert 10 < sum(len(gone) for _, gone in got.values()) < len(rows) - 7


def test_only_wanted_lines_are_read(spark):
    df = spark.createDataFrame([(k, "\n".join(f"a{k} b{j} c{j} d{k} e{j} f{i}" for i, j in enumerate((k, k + 1)))) for k in range(300)], "doc_id long, text string")
    sent = spark.sparkContext.broadcast(line_dedup.rarity(df))
    lines = line_dedup.stored(line_dedup.occurrences(df, sent, 80), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t", "line")
    places = lines.filter("line = 1 and doc_id < 10").select(F.col("id1").alias("id"), place.alias("first"))
    got = line_dedup.words_of(df, places, sent, 80).collect()
    wanted = {r.id for r in places.collect()}
    assert wanted <= {r.id for r in got} and len(got) < 20
    assert all(len(r.words) == r.n == 6 for r in got)
