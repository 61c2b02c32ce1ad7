"""Quoted line breaks, read in several tasks."""

import random

import pytest

from txnwatch.sources.ingest import read_delimited
from txnwatch.sources.quoted import _lines, ends_inside, read_quoted


def cells(df):
    return sorted(tuple("" if v is None else f"={v}" for v in r) for r in df.collect())


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)
        if k in before:
            spark.conf.set(k, before[k])


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_one_task_per_file(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    folder = tmp_path / "in"
    folder.mkdir()
    for part in range(3):
        rows = []
        for _ in range(60):
            row = []
            for _ in range(3):
                text = "".join(rng.choices(["a", "é", ",", "\n", '"', " ", "\r\n", "long " * 9, "\n\n"], k=rng.randint(0, 6)))
                plain = text.replace(",", "").replace("\n", "").replace("\r", "").strip('"')
                row.append(quoted(text) if rng.random() < 0.6 else plain)
            rows.append(",".join(["x" + row[0] if not row[0] else row[0], *row[1:]]))
        end = "\n"
        (folder / f"{part}.csv").write_bytes((("﻿" if part == 0 else "") + end.join(['id,"te\nxt",b', *rows]) + rng.choice(["", end, "\n\n"])).encode())
    whole = spark.read.csv(str(folder), header=True, quote='"', escape='"', multiLine=True)
    assert _lines(spark, str(folder)).rdd.getNumPartitions() > 10
    got = read_quoted(spark, str(folder))
    assert [c.lstrip("﻿") for c in whole.columns] == got.columns == ["id", "te\nxt", "b"]
    assert cells(got) == cells(whole)


def test_a_cell_over_many_splits(spark, tmp_path, small_splits):
    text = "\n".join(f"line {k}, with a comma" for k in range(200))
    (tmp_path / "a.csv").write_text(f"id,text\n1,{quoted(text)}\n2,x\n3,{quoted(text)}\n")
    rows = {r.id: r.text for r in read_delimited(spark, str(tmp_path / "a.csv"), multi_line=True).collect()}
    assert rows == {"1": text, "2": "x", "3": text}


def test_quotes_inside_plain_cells(spark, tmp_path, small_splits):
    lines = ["id;size;note"] + [f'{k};5" pipe;"a\nb"' if k % 3 else f'{k};;"say ""x"""' for k in range(40)]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    whole = spark.read.csv(str(tmp_path / "a.csv"), header=True, sep=";", quote='"', escape='"', multiLine=True)
    assert cells(read_delimited(spark, str(tmp_path / "a.csv"), ";", multi_line=True)) == cells(whole)
    assert cells(whole)[5][1:] == ('=5" pipe', "=a\nb")


def test_carriage_returns(spark, tmp_path, small_splits):
    """They end lines, but stay inside quotes."""
    rows = [("id", "text")] + [(str(k), f"a\r\nb {k}") for k in range(30)]
    (tmp_path / "a.csv").write_bytes("\r\n".join(f"{a},{quoted(b)}" for a, b in rows).encode() + b"\r\n\r\n")
    assert sorted(tuple(r) for r in read_quoted(spark, str(tmp_path / "a.csv")).collect()) == sorted(rows[1:])


def test_line_states():
    assert ends_inside('a,"b', False, ",") and not ends_inside('b",c', True, ",") and ends_inside('x","y', True, ",")
    assert not ends_inside('5" x,y', False, ",") and ends_inside('a""b', True, ",") and not ends_inside('""', False, ",")


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert read_quoted(spark, str(tmp_path / "a.csv")).columns == []
    (tmp_path / "b.csv").write_text("id,id,,x\n")
    got = read_quoted(spark, str(tmp_path / "b.csv"))
    assert got.columns == ["id0", "id1", "_c2", "x"] and got.count() == 0
