"""Conversation structure repair by iterative-deepening A*.

A conversation is sound if its roles' initials are ``(s?(ua)+)?``: perhaps a system turn, then questions and answers.
Edits are K (keep, 0), R (rerole to user or assistant, 1), D (delete, 2) and I (insert an empty user or assistant
turn, 5). Blank rows and repeats must go; an unfinished row that stays costs 5 more. The answer is the cheapest edit
string, the ASCII-least one among equals: a depth-first search takes the edits in ASCII order under a growing cost
bound, so the first accepting path is the answer. Pairs of (position, state) that failed are kept with the budget
that did not suffice. The lower bound is the cheapest repair if any number of system turns could come first.

One conversation may hold most rows. Places are numbered by a range sort, and conversations are cut into segments of
``SEGMENT`` rows. A segment that is not a whole conversation is searched for each state before and after it; a backward and a
forward pass over the segments (costs only, one small row per segment, read as a stream) choose among these paths.
Texts travel apart from the search, by the digest of role and text.

Defined cases: null role or text count as one space; null turns come first; rows of one turn go by role, then by the
digest of role and text; repeated rows are repeats; an empty role has no fitting initial; a null conversation id is one
conversation; empty and very long texts are ordinary texts; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.shared import same_columns, stored
from txnwatch.operators.skew import hot_groups, numbered, skew_join

SEGMENT = 256
SPACES = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5
# States: 0 nothing yet, 1 after the system turn, 2 after a question, 3 after an answer.
KEEP_TO = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
TURN_TO = (2, 2, 3, 2)
ROLE_OF = {2: "user", 3: "assistant"}
ACCEPTED = (0, 3)
# The lower bound does not tell states 0 and 1 apart.
PHASE = (0, 0, 1, 2)
NEVER = 1 << 40

Row = tuple[str, str]


def lower_bounds(rows: list[Row], goal: int, final: bool) -> list[tuple[int, int, int]]:
    """Per position and phase, a cost that no path to the phase of ``goal`` can undercut."""
    end = [NEVER, NEVER, NEVER]
    end[PHASE[goal]] = 0
    if final:
        # Only a final segment may end with inserted turns.
        end[1] = min(end[1], INSERT + end[2])
        end[2] = min(end[2], INSERT + end[1])
        end[0] = min(end[0], INSERT + end[1])
    out = [(end[0], end[1], end[2])]
    for initial, fault in reversed(rows):
        p, q, a = out[-1]
        stay = UNFINISHED if fault == "t" else 0
        if fault in ("b", "d"):
            p, q, a = p + DELETE, q + DELETE, a + DELETE
        else:
            p, q, a = (
                min(p + DELETE, stay + (min(p, q + REROLE) if initial == "s" else q if initial == "u" else q + REROLE)),
                min(q + DELETE, stay + (a if initial == "a" else a + REROLE)),
                min(a + DELETE, stay + (q if initial == "u" else q + REROLE)),
            )
        # One inserted turn leads to the next phase; two in a row lead back or on.
        p, q, a = min(p, INSERT + q, 2 * INSERT + a), min(q, INSERT + a), min(a, INSERT + q)
        out.append((p, q, a))
    out.reverse()
    return out


def search(rows: list[Row], start: int, goals: tuple[int, ...], final: bool) -> tuple[int, str]:
    """Cheapest cost and its ASCII-least edits from ``start`` to one of ``goals``, the last of which is 2 or 3."""
    n = len(rows)
    floor = lower_bounds(rows, goals[-1], final)
    if 0 in goals:
        # Nothing kept at all is sound too; the first phase may then end as it is.
        bare = [(min(DELETE * (n - k), floor[k][0]), floor[k][1], floor[k][2]) for k in range(n + 1)]
        floor = bare
    failed: dict[int, int] = {}
    path: list[str] = []

    def descend(at: int, state: int, budget: int) -> bool:
        if at == n and state in goals:
            return True
        slot = at * 4 + state
        if failed.get(slot, -1) >= budget:
            return False
        if at < n:
            initial, fault = rows[at]
            below = floor[at + 1]
            if DELETE + below[PHASE[state]] <= budget and descend(at + 1, state, budget - DELETE):
                path.append("D")
                return True
        turned = TURN_TO[state]
        if (at < n or final) and INSERT + floor[at][PHASE[turned]] <= budget and descend(at, turned, budget - INSERT):
            path.append("I")
            return True
        if at < n and fault not in ("b", "d"):
            stay = UNFINISHED if fault == "t" else 0
            kept = KEEP_TO[state].get(initial)
            if kept is not None and stay + below[PHASE[kept]] <= budget and descend(at + 1, kept, budget - stay):
                path.append("K")
                return True
            cost = stay + REROLE
            if cost + below[PHASE[turned]] <= budget and descend(at + 1, turned, budget - cost):
                path.append("R")
                return True
        failed[slot] = budget
        return False

    bound = floor[0][PHASE[start]]
    while not descend(0, start, bound):
        bound += 1
    path.reverse()
    return bound, "".join(path)


def before_questions(rows: list[Row], start: int, goal: int) -> tuple[int, str] | None:
    """The same for goals 0 and 1, where at most one system turn stays; None if the goal is out of reach."""
    n = len(rows)
    if start == goal:
        return DELETE * n, "D" * n
    if (start, goal) != (0, 1):
        return None
    found = [(UNFINISHED if f == "t" else 0, -k) for k, (i, f) in enumerate(rows) if i == "s" and f not in ("b", "d")]
    if not found:
        return None
    cost, at = min(found)
    return cost + DELETE * (n - 1), "D" * -at + "K" + "D" * (n - 1 + at)


def ways(rows: list[Row], start: int, final: bool) -> list[tuple[int, str] | None]:
    """Per state after the segment, the best way there from ``start``."""
    late = [search(rows, start, (goal,), final) if not final or goal == 3 else None for goal in (2, 3)]
    return [before_questions(rows, start, 0), before_questions(rows, start, 1), *late]


def replay(rows: list[Row], start: int, path: str) -> Iterator[tuple[int, str, str | None]]:
    """(row, edit, new role) along a path; an inserted turn carries the row it stands before."""
    at, state = 0, start
    for edit in path:
        if edit in "IR":
            state = TURN_TO[state]
            yield at, edit, ROLE_OF[state]
        else:
            if edit == "K":
                state = KEEP_TO[state][rows[at][0]]
            yield at, edit, None
        at += edit != "I"


def _rows(symbols: str) -> list[Row]:
    return [(symbols[k], symbols[k + 1]) for k in range(0, len(symbols), 2)]


def _mark() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))


def judged(turns: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ``turns`` without their texts: key, conv_id, turn, mark, place from 0, initial and fault.

    ``fault`` is b (blank), d (role and text seen earlier), t (does not end in ``.!?``) or -; the first that holds.
    The second result names hot (key, mark) pairs.
    """
    ended = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.left("role", F.lit(1))
    narrow = turns.select(
        _key(),
        "conv_id",
        "turn",
        "role",
        _mark().alias("mark"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        F.when(ended == "", "b").when(F.right(ended, F.lit(1)).isin(".", "!", "?"), "-").otherwise("t").alias("shape"),
    )
    placed = stored(numbered(narrow, ["key"], ["turn", "role", "mark"], "place").withColumn("place", F.col("place") - 1).drop("role"), "places")
    again = placed.groupBy("key", "mark").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    hot = hot_groups(placed, ["key", "mark"])
    seen = skew_join(placed, again, ["key", "mark"], "left", salt_on=["place"], hot=hot)
    fault = F.when(F.col("shape") == "b", "b").when(F.col("place") > F.col("first"), "d").otherwise(F.col("shape"))
    return seen.select("key", "conv_id", "mark", "place", "initial", fault.alias("fault")), hot


def _key() -> Column:
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key")


def segments(rows: DataFrame, size: int) -> DataFrame:
    """Judged rows in lists of at most ``size``, with counts; ``ahead`` is the initial that follows, empty at the end."""
    seg = F.col("place").cast("long") - F.pmod(F.col("place"), F.lit(size))
    first = (F.pmod(F.col("place"), F.lit(size)) == 0) & (F.col("place") > 0)
    both = rows.withColumn("own", seg).withColumn("seg", F.explode(F.when(first, F.array("own", F.col("own") - size)).otherwise(F.array("own"))))
    mine = F.col("own") == F.col("seg")
    lists = both.groupBy("key", "seg").agg(
        F.first("conv_id").alias("conv_id"),
        F.sort_array(F.collect_list(F.when(mine, F.struct("place", "initial", "fault", "mark")))).alias("rows"),
        F.coalesce(F.max(F.when(~mine, F.col("initial"))), F.lit("")).alias("ahead"),
        *[F.count_if(mine & (F.col("fault") == code)).alias(name) for code, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))],
    )
    line = F.array_join(F.transform("rows", lambda r: r["initial"]), "")
    pairs = F.concat(line, "ahead")
    bad = F.length(pairs) - 1 - F.size(F.filter(F.sequence(F.lit(1), F.length(pairs)), lambda k: F.substring(pairs, k, F.lit(2)).isin("su", "ua", "au")))
    return lists.select(
        "*", F.array_join(F.transform("rows", lambda r: F.concat(r["initial"], r["fault"])), "").alias("symbols"), bad.cast("long").alias("illegal")
    )


def _whole(batches):
    """Paths of segments that are whole conversations."""
    for batch in batches:
        found = [search(_rows(symbols), 0, ACCEPTED, True) for symbols in batch.column("symbols").to_pylist()]
        n = len(found)
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("seg"), pa.array([0] * n, pa.int32()), pa.array([c for c, _ in found], pa.int64()), pa.array([p for _, p in found], pa.string())],
            ["key", "seg", "start", "cost", "path"],
        )


def _ways(batches):
    """All paths of the segments of long conversations; ``order`` ranks the paths from one start."""
    names = ["key", "seg", "start", "goal", "cost", "order", "path"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string()]
    for batch in batches:
        for key, seg, symbols, ahead in zip(*[batch.column(c).to_pylist() for c in ("key", "seg", "symbols", "ahead")], strict=True):
            rows, out = _rows(symbols), []
            for start in range(4) if seg else (0,):
                found = [(goal, way) for goal, way in enumerate(ways(rows, start, not ahead)) if way]
                ranked = sorted(range(len(found)), key=lambda k: found[k][1][1])
                out += [(key, seg, start, found[k][0], *found[k][1][:1], rank, found[k][1][1]) for rank, k in enumerate(ranked)]
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _backward(batches):
    """Per segment, the goal to take from each start, and its cost. Segments come last first."""
    mine, after = None, []
    for batch in batches:
        out = []
        for key, seg, edges in zip(*[batch.column(c).to_pylist() for c in ("key", "seg", "edges")], strict=True):
            if key != mine:
                mine, after = key, [0 if s in ACCEPTED else NEVER for s in range(4)]
            best: list[tuple[int, int, int]] = [(NEVER, 0, -1)] * 4
            for e in edges:
                best[e["start"]] = min(best[e["start"]], (min(NEVER, e["cost"] + after[e["goal"]]), e["order"], e["goal"]))
            out.append((key, seg, [b[2] for b in best]))
            after = [b[0] for b in best]
        yield pa.RecordBatch.from_pydict(
            {"key": pa.array([r[0] for r in out], pa.string()), "seg": pa.array([r[1] for r in out], pa.int64()), "goals": pa.array([r[2] for r in out], pa.list_(pa.int32()))}
        )


def _forward(batches):
    """Per segment, its start and goal on the way from the first segment on."""
    mine, state = None, 0
    for batch in batches:
        out = []
        for key, seg, goals in zip(*[batch.column(c).to_pylist() for c in ("key", "seg", "goals")], strict=True):
            if key != mine:
                mine, state = key, 0
            out.append((key, seg, state, goals[state]))
            state = goals[state]
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["key", "seg", "start", "goal"]
        )


def paths(lists: DataFrame) -> DataFrame:
    """Columns key, seg, start, cost, path: the edits of every segment."""
    alone = (F.col("seg") == 0) & (F.col("ahead") == "")
    whole = lists.filter(alone).select("key", "seg", "symbols").mapInArrow(_whole, "key string, seg long, start int, cost long, path string")
    if lists.filter(~alone).isEmpty():
        return whole
    parts = lists.filter(~alone).select("key", "seg", "symbols", "ahead")
    each = stored(parts.mapInArrow(_ways, "key string, seg long, start int, goal int, cost long, order int, path string"), "ways")
    edges = each.groupBy("key", "seg").agg(F.collect_list(F.struct("start", "goal", "cost", "order")).alias("edges"))
    back = edges.repartition("key").sortWithinPartitions("key", F.desc("seg")).mapInArrow(_backward, "key string, seg long, goals array<int>")
    taken = back.repartition("key").sortWithinPartitions("key", "seg").mapInArrow(_forward, "key string, seg long, start int, goal int")
    return whole.unionByName(each.join(taken, ["key", "seg", "start", "goal"]).select("key", "seg", "start", "cost", "path"))


def _steps(batches):
    kind = pa.list_(pa.struct([("row", pa.int32()), ("step", pa.int32()), ("edit", pa.string()), ("role", pa.string())]))
    for batch in batches:
        out = []
        for symbols, start, path in zip(*[batch.column(c).to_pylist() for c in ("symbols", "start", "path")], strict=True):
            out.append([{"row": at, "step": k, "edit": edit, "role": role} for k, (at, edit, role) in enumerate(replay(_rows(symbols), start, path))])
        keep = [batch.column(c) for c in ("key", "conv_id", "seg", "rows")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(out, kind)], ["key", "conv_id", "seg", "rows", "steps"])


def repair(turns: DataFrame, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Repair conversations. ``turns`` has conv_id, turn, role, text; other columns are ignored.

    The first result has a row per edit: conv_id, place (of the row, from 0), step (orders edits), edit, role and
    text after it (a deleted row's own). Rows other than D, in order, are the repaired conversation. The second has a row
    per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, all as found before the repair.
    """
    size = size or SEGMENT
    turns = same_columns(turns, ["conv_id", "turn", "role", "text"]).withColumns(
        {c: F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text")}
    )
    rows, hot = judged(turns)
    lists = stored(segments(rows, size), "segments")
    plans = stored(paths(lists), "paths")
    found = lists.join(plans.drop("cost"), ["key", "seg"]).select("key", "conv_id", "seg", "rows", "symbols", "start", "path")
    kinds = {c: lists.schema[c].dataType.simpleString() for c in ("conv_id", "rows")}
    listed = found.mapInArrow(
        _steps, f"key string, conv_id {kinds['conv_id']}, seg long, rows {kinds['rows']}, steps array<struct<row:int,step:int,edit:string,role:string>>"
    )
    steps = listed.withColumn("s", F.explode("steps")).select(
        "key",
        "conv_id",
        (F.col("seg") + F.col("s.row")).alias("place"),
        F.col("s.step").alias("step"),
        F.col("s.edit").alias("edit"),
        F.col("s.role").alias("new_role"),
        F.when(F.col("s.edit") != "I", F.expr("rows[s.row].mark")).alias("mark"),
    )
    texts = turns.select(_key(), _mark().alias("mark"), "role", "text").groupBy("key", "mark").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    full = skew_join(steps, texts, ["key", "mark"], "left", salt_on=["place", "step"], hot=hot)
    edits = full.select(
        "conv_id", "place", "step", "edit", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    spans = turns.select(_key(), "conv_id", "turn").groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    different = turns.select(_key(), "turn").filter("turn is not null").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("turns"))
    counts = lists.join(plans.select("key", "seg", "cost"), ["key", "seg"]).groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    )
    report = spans.join(different, "key", "left").join(counts, "key").select(
        "conv_id",
        F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost",
    )
    return edits, report


def damage(conversations: DataFrame) -> DataFrame:
    """Plant faults by the checksum of ``conv_id:turn``: rows drop, lose their text or marks, repeat, or turn into user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    rows = same_columns(conversations, ["conv_id", "turn", "role", "text"]).withColumn("draw", draw).filter("draw != 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    copies = F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")
    ).drop("copy")


def _digest(batches):
    """Per conversation, its edits and the SHA-256 of what is left, read as a stream in order of the edits."""
    mine, conv, held, audit, any_left = None, None, None, [], False

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([mine], pa.string()), pa.array(["".join(audit)], pa.string()), pa.array([held.hexdigest()], pa.string())], ["key", "audit", "repaired_sha256"]
        )

    for batch in batches:
        for key, edit, role, text in zip(*[batch.column(c).to_pylist() for c in ("key", "edit", "role", "text")], strict=True):
            if key != mine:
                if held is not None:
                    yield row()
                mine, held, audit, any_left = key, hashlib.sha256(), [], False
            audit.append(edit)
            if edit != "D":
                held.update(("\n" if any_left else "").encode() + f"{role}:{text}".encode())
                any_left = True
    if held is not None:
        yield row()


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damage, repair, and digest per original conversation."""
    edits, report = repair(damage(conversations))
    edits = edits.select(_key(), "place", "step", "edit", "role", F.when(F.col("edit") != "D", F.col("text")).alias("text"))
    digests = edits.repartition("key").sortWithinPartitions("key", "place", "step").mapInArrow(_digest, "key string, audit string, repaired_sha256 string")
    every = conversations.select(_key(), F.col("conv_id")).distinct()
    found = every.join(report.select(_key(), *[c for c in report.columns if c != "conv_id"]), "key", "left").join(digests, "key", "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    )
