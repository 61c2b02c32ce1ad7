import random

import duckdb
import pytest

from txnwatch.llm.mixing import mix_sources, mixture
from txnwatch.llm.sql import SQL

SHAPE = "doc_id long, text string, source string"


def oracle(rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    return con.sql(SQL["op2_mixing"])


def table(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_sorting(spark, seed):
    rng = random.Random(seed)
    sources = ["a", "B", "é", "zz", "\U0001f600", None, "tiny", ""]
    rows = [(i, "w " * rng.randint(0, 40), rng.choices(sources, [30, 9, 5, 5, 4, 3, 1, 2])[0]) for i in range(400)]
    rows += [(3, "w w w", "a"), (3, "w w w", "a"), (None, "x", "a"), (None, None, None), (9000, "q " * 900, "tiny"), (9001, None, "empty")]
    out = mix_sources(spark.createDataFrame(rows, SHAPE)).select("doc_id", "source", "size", "source_size", "target", "taken")
    got = out.collect()
    assert table(got) == table(oracle(rows).fetchall())
    taken, target, largest = {}, {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        assert r.taken <= 3 * r.size and r.target <= 3 * r.source_size
    assert abs(sum(target.values()) - sum(r.size for r in got)) < 1e-6
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in taken)


def test_columns_stay(spark):
    rows = [(i, "a b c", "s", 5) for i in range(20)]
    out = mixture(spark.createDataFrame(rows, SHAPE + ", size int"))
    assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    assert sum(r.taken for r in out.collect()) == 60


def test_edge_tables(spark):
    assert mix_sources(spark.createDataFrame([], SHAPE)).collect() == []
    out = mix_sources(spark.createDataFrame([(1, None, None), (2, "", "a")], SHAPE)).collect()
    assert sorted((r.doc_id, r.target, r.taken) for r in out) == [(1, 0.0, 0), (2, 0.0, 0)]
