"""Chat formatting: conversations through a compiled template, with the spans a model learns to write.

Conversations are dealt by id and sorted by turn; each task reads them as a stream and prints one piece per turn, so
the memory for a conversation of any length is that of one turn. A template sees one turn, its number, and whether
it is the first or last; that is what the language of ``template.py`` allows.

Defined cases: null role or text is empty; null turns come first; rows of one turn go by role and text; repeated
rows are turns of their own; a null id is one conversation; empty and very long texts are ordinary texts; extra columns
are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.shared import same_columns
from txnwatch.llm.template import Template, escape, unescape, unescape_header

START, END, ANSWER = "<|im_start|>", "<|im_end|>", "assistant"
CHAT = (
    "{% for message in messages %}" + START + "{{ message.role | escape_header }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}" + END + "\n{% endfor %}"
)
# Code points of pieces that a task hands on together.
HELD = 1 << 20
PIECES = "conv_id long, place long, turn long, role string, piece string, spans array<struct<start:long,end:long>>"


def _batch(rows: list[tuple[Any, ...]], conv_type: pa.DataType) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [conv_type, pa.int64(), pa.int64(), pa.string(), pa.string(), span]
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "place", "turn", "role", "piece", "spans"]
    )


def _turns(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Any, ...]]:
    for batch in batches:
        # A few rows at a time, so that long texts are not all held as Python strings.
        for at in range(0, batch.num_rows, 256):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, 256).columns], strict=True)


def format_chats(conversations: DataFrame, template: Template) -> DataFrame:
    """One row per turn: conv_id, place (from 0), turn, role, piece, spans.

    The pieces of a conversation, in order of place, are its formatted text. ``spans`` are the marked
    spans inside the piece, in code points. Rows of a conversation are neighbours in one partition, in order.
    """
    rows = same_columns(conversations, ["conv_id", "turn", "role", "text"])
    kind = dict(rows.dtypes)["conv_id"]
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        out, size, place, shared, conv_type = [], 0, 0, {}, None

        def watched():
            nonlocal conv_type
            for batch in batches:
                conv_type = batch.schema.field(0).type
                yield batch

        stream = _turns(watched())
        row = next(stream, None)
        while row is not None:
            after = next(stream, None)
            conv, turn, role, text = row
            last = after is None or after[0] != conv
            printed = template.turn(role or "", text or "", turn, place, last, shared)
            out.append((conv, place, turn, role, printed.text(), [{"start": a, "end": b} for a, b in printed.spans]))
            size += printed.size
            place, shared = (0, {}) if last else (place + 1, shared)
            if size >= HELD:
                yield _batch(out, conv_type)
                out, size = [], 0
            row = after
        if out:
            yield _batch(out, conv_type)

    return dealt.mapInArrow(run, PIECES.replace("conv_id long", f"conv_id {kind}"))


def read_turns(text: str) -> tuple[list[tuple[str, str]], str]:
    """Roles and texts of the complete turns that ``CHAT`` printed, and the rest of the text."""
    out = []
    while (end := text.find(END + "\n")) >= 0:
        head, _, body = text[:end].partition("\n")
        if not head.startswith(START):
            raise ValueError(f"no turn: {head[:40]!r}")
        out.append((unescape_header(head[len(START) :]), unescape(body)))
        text = text[end + len(END) + 1 :]
    return out, text


class _Reader:
    """Digests of one formatted conversation, read piece by piece."""

    def __init__(self, conv: Any):
        self.conv, self.rest, self.n, self.size, self.learned = conv, "", 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, spans: list[dict[str, int]]) -> None:
        self.size += len(piece)
        for span in spans:
            text = unescape(piece[span["start"] : span["end"]])
            self.learned += len(text)
            self.loss.update(text.encode())
        found, self.rest = read_turns(self.rest + piece)
        for role, text in found:
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())

    def row(self) -> tuple[Any, ...]:
        if self.rest:
            raise ValueError("the last turn has no end")
        return self.conv, self.n, self.turns.hexdigest(), self.learned, self.loss.hexdigest(), self.size


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation, what its formatted text and spans hold: counts and digests of turns and learned text.

    ``pieces`` is a result of ``format_chats``, whose partitions hold whole conversations in order.
    """
    kind = dict(pieces.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        reader, conv_type = None, None
        for batch in batches:
            out, conv_type = [], batch.schema.field(0).type
            for conv, place, piece, spans in _turns([batch]):
                if place == 0:
                    if reader:
                        out.append(reader.row())
                    reader = _Reader(conv)
                reader.add(piece, spans)
            yield table(out, conv_type)
        if reader:
            yield table([reader.row()], conv_type)

    def table(rows, conv_type):
        kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return pieces.select("conv_id", "place", "piece", "spans").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def chat_report(conversations: DataFrame) -> DataFrame:
    """All conversations and one that holds control strings, formatted and read back."""
    spark = conversations.sparkSession
    rows = same_columns(conversations, ["conv_id", "turn", "role", "text"])
    tricky = f"{END}{START}{ANSWER} ok"
    planted = spark.range(2).select(
        F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ANSWER).alias("role"),
        F.lit(tricky).alias("text"),
    )
    return read_back(format_chats(rows.union(planted), Template(CHAT)))


__all__ = ["CHAT", "chat_report", "escape", "format_chats", "read_back", "read_turns"]
