"""Delimited files whose quoted cells hold line breaks, read by several tasks per file (A1).

Spark's multi-line reader gives each file to one task. Here a file is read as lines, in the usual splits. Whether a split
begins inside a quoted cell depends on all text before it, so a first pass finds, for lines that hold a quote, how each
split ends if it begins inside a cell and if it does not; these are chained along the file, one small row per
split. A second pass cuts each split into records. Only records that cross a split are put together by a shuffle.

The result is that of Spark's multi-line reader with the same options. Lines end with a line feed; a carriage
return before it belongs to the line end outside of quotes and to the cell inside. Blank lines between records are skipped.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnwatch.operators.skew import stored

QUOTE = '"'
# Characters of records that a task hands on together.
HELD = 1 << 20
WHOLE, HEAD, MIDDLE, TAIL = 0, 1, 2, 3


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a line that begins inside a quoted cell, or not, ends inside one.

    A quote opens a cell only at its start; a doubled quote is part of the cell.
    """
    at = 0
    while True:
        if not inside:
            if not line.startswith(QUOTE, at):
                end = line.find(sep, at)
                if end < 0:
                    return False
                at = end + len(sep)
                continue
            at += 1
        end = line.find(QUOTE, at)
        if end < 0:
            return True
        inside = line.startswith(QUOTE, end + 1)
        if inside:
            at = end + 2
            continue
        end = line.find(sep, end + 1)
        if end < 0:
            return False
        at = end + len(sep)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _splits(lines: DataFrame, sep: str) -> DataFrame:
    """Columns file, start, open: the splits that hold a quote, and whether they begin inside a cell; then all others up to the next."""

    def run(batches):
        key, ends = None, (False, True)
        for batch in batches:
            out = []
            for file, start, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (file, start) != key:
                    if key:
                        out.append((*key, *ends))
                    key, ends = (file, start), (False, True)
                ends = tuple(ends_inside(value, e, sep) for e in ends)
            yield _rows(out)
        if key:
            yield _rows([(*key, *ends)])

    def _rows(out):
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["file", "start", "outside", "inside"])

    def chain(batches):
        file_now, state = None, False
        for batch in batches:
            out = []
            for file, start, outside, inside in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if file != file_now:
                    file_now, state = file, False
                out.append((file, start, state))
                state = inside if state else outside
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_()), strict=True)], ["file", "start", "open"])

    quoted = lines.filter(F.contains("value", F.lit(QUOTE))).mapInArrow(run, "file string, start long, outside boolean, inside boolean")
    # Splits without any quote pass on what they get.
    plain = lines.filter(~F.contains("value", F.lit(QUOTE))).select("file", "start").distinct()
    plain = plain.select("file", "start", F.lit(False).alias("outside"), F.lit(True).alias("inside"))
    both = quoted.unionByName(plain.join(quoted.select("file", "start"), ["file", "start"], "left_anti"))
    return both.repartition("file").sortWithinPartitions("file", "start").mapInArrow(chain, "file string, start long, open boolean")


def _cut(sep: str):
    """Lines in order to records and pieces of records: file, start, kind, first (of its file), text."""

    def emit(out):
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["file", "start", "kind", "first", "text"])

    def lines_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, str]]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield from zip(*[c.to_pylist() for c in batch.slice(at, 1024).columns], strict=True)

    def run(batches):
        key, inside, held, kind, first, out, size = None, False, [], WHOLE, False, [], 0
        for file, start, opened, value in lines_of(batches):
            if (file, start) != key:
                if held:
                    out.append((*key, MIDDLE if kind == HEAD else TAIL, first, "\n".join(held)))
                key, inside, held, kind, first = (file, start), opened, [], HEAD if opened else WHOLE, start == 0
            held.append(value)
            if QUOTE in value:
                inside = ends_inside(value, inside, sep)
            if not inside:
                text = "\n".join(held)
                if kind == HEAD or text.strip():
                    out.append((file, start, kind, first, text))
                    size += len(text)
                    first = first and kind == HEAD
                held, kind = [], WHOLE
                if size >= HELD:
                    yield emit(out)
                    out, size = [], 0
        if held:
            out.append((*key, MIDDLE if kind == HEAD else TAIL, first, "\n".join(held)))
        if out:
            yield emit(out)

    return run


def records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Columns file, first, text: one row per record, line breaks inside quotes kept; ``first`` marks the first of its file."""
    lines = _lines(spark, path)
    # One row per split of the input, small enough to be everywhere; the lines keep their order.
    splits = F.broadcast(stored(_splits(lines, sep), "splits"))
    marked = lines.join(splits, ["file", "start"]).select("file", "start", "open", "value")
    pieces = stored(marked.mapInArrow(_cut(sep), "file string, start long, kind int, first boolean, text string"), "records")
    # Pieces of records that cross splits: a tail, whole splits, and the head of a later split.
    broken = pieces.filter(F.col("kind") != WHOLE)
    order = W.partitionBy("file").orderBy("start", "kind")
    numbered = broken.withColumn("no", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    ranked = F.sort_array(F.collect_list(F.struct("start", "kind", "text")))
    joined = numbered.groupBy("file", "no").agg(F.bool_or(F.col("first") & (F.col("kind") == TAIL)).alias("first"), ranked.alias("parts"))
    mended = joined.select("file", "first", F.array_join(F.col("parts.text"), "\n").alias("text"))
    return pieces.filter(F.col("kind") == WHOLE).select("file", "first", "text").unionByName(mended)


def header_names(text: str, sep: str) -> list[str]:
    """Column names as Spark gives them: no byte-order mark, a number for empty and repeated names."""
    names = next(csv.reader([text.lstrip("﻿").rstrip("\r")], delimiter=sep), [])
    lower = [n.lower() for n in names]
    return [f"_c{k}" if not n else f"{n}{k}" if lower.count(n.lower()) > 1 else n for k, n in enumerate(names)]


def read_quoted(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A1: a delimited file with header and line breaks in quoted cells, every cell as text."""
    rows = records(spark, path, delimiter)
    found = rows.filter("first").orderBy("file").select("text").first()
    if found is None:
        return spark.createDataFrame([], "`_c0` string").drop("_c0")
    names = header_names(found[0], delimiter)
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    options = {"sep": delimiter, "quote": QUOTE, "escape": QUOTE, "multiLine": "true"}
    cells = F.from_csv(F.regexp_replace("text", r"\r\z", ""), schema, options)
    return rows.filter(~F.col("first")).select(cells.alias("_cells")).select("_cells.*")
