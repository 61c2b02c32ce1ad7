import hashlib
import heapq
import random
import re
import zlib

import pytest

from txnwatch.llm.turn_repair import damage, repair, repair_report, search, ways

SPACE = " \t\n\x0b\x0c\r"
SOUND = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """(cost, edits, roles) by uniform cost search in order of (cost, edits). rows: (role, fault)."""
    heap = [(0, "", 0, ())]
    done = set()
    while heap:
        cost, edits, at, roles = heapq.heappop(heap)
        line = "".join((r[0] or " ")[:1] for r in roles)
        if at == len(rows) and SOUND.match(line):
            return cost, edits, roles
        # Only what may still become sound goes on.
        if not re.match(r"(s?(ua)*u?)?\Z", line):
            continue
        state = (at, line[-1:], len(line) > 0)
        if (state, "seen") in done:
            continue
        done.add((state, "seen"))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, edits + "I", at, (*roles, (role, None))))
        if at < len(rows):
            role, fault = rows[at]
            heapq.heappush(heap, (cost + 2, edits + "D", at + 1, roles))
            if fault not in ("b", "d"):
                stay = 5 if fault == "t" else 0
                heapq.heappush(heap, (cost + stay, edits + "K", at + 1, (*roles, (role, at))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + stay + 1, edits + "R", at + 1, (*roles, (new, at))))
    raise AssertionError


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        cell = lambda v: " " if v is None else str(v)
        draw = zlib.crc32(f"{cell(conv)}:{cell(turn)}".encode()) % 20
        role, text = cell(role), cell(text)
        if draw == 0:
            continue
        if draw == 1:
            text = ""
        if draw == 2:
            text = "".join(c for c in text if c not in ".!?")
        if draw == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if draw == 3 else 1)
    return out


def mark(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    left = damaged(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], mark(r[2], r[3])))
        seen, judged = set(), []
        for _, _, role, text in mine:
            fault = "b" if not text.strip(SPACE) else "d" if (role, text) in seen else "-" if text.strip(SPACE)[-1] in ".!?" else "t"
            seen.add((role, text))
            judged.append((role, fault))
        turns = [r[1] for r in mine if r[1] is not None]
        line = [(r or " ")[0] for r, _ in judged]
        cost, edits, roles = cheapest(judged)
        text = "\n".join(f"{role}:{'' if at is None else mine[at][3]}" for role, at in roles)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[sum(f == c for _, f in judged) for c in "bdt"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(line, line[1:], strict=False)),
            cost, edits, hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def found(df):
    rows = df.collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def test_search_is_cheapest_and_least():
    rng = random.Random(5)
    for _ in range(1500):
        rows = [(rng.choice("suaax"), rng.choice("---tbd")) for _ in range(rng.randint(0, 9))]
        assert search(rows, 0, (0, 3), True) == cheapest(rows)[:2], rows


def test_ways_join_to_the_same_answer():
    """The best chain over two segments is the answer of the whole."""
    rng = random.Random(6)
    for _ in range(400):
        rows = [(rng.choice("ssuaax"), rng.choice("---tbd")) for _ in range(rng.randint(2, 8))]
        cut = rng.randint(1, len(rows) - 1)
        chains = []
        for goal, way in enumerate(ways(rows[:cut], 0, False)):
            for end, rest in enumerate(ways(rows[cut:], goal, True)):
                if way and rest and end in (0, 3):
                    chains.append((way[0] + rest[0], way[1] + rest[1]))
        assert min(chains) == cheapest(rows)[:2], rows


def test_long_segment_needs_few_bounds():
    rng = random.Random(2)
    rows = [(rng.choice("sua"), rng.choice("--------tbd")) for _ in range(256)]
    for start in range(4):
        assert len([w for w in ways(rows, start, False) if w]) >= 2


def conversations(rng, n=120, longest=14):
    words = ["Yes.", "No", "why?", "", " \n", "A b c!", "ok"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "assistant", "system", "tool", None, ""]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(words) if rng.random() < 0.4 else None if rng.random() < 0.05 else f"text {rng.random()}" + rng.choice([".", "", "! "])
            rows.append((conv if conv else None, rng.choice([turn, None]) if rng.random() < 0.1 else turn + (turn > 4), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("size", [256, 3, 1])
def test_same_as_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr("txnwatch.llm.turn_repair.SEGMENT", size)
    rows = conversations(random.Random(size))
    assert found(repair_report(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert found(repair_report(table)) == brute([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])


def test_hot_conversation_with_copies(spark, tiny_hot):
    rng = random.Random(9)
    rows = [(1, t, ("user", "assistant")[t % 2] if rng.random() < 0.9 else "system", f"t{t}.") for t in range(1500)]
    rows += [(1, 7, "user", "t7.")] * 300 + conversations(rng, 20)
    assert found(repair_report(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_repaired_rows_are_sound(spark):
    rows = conversations(random.Random(4), 60)
    edits, report = repair(spark.createDataFrame(rows, SCHEMA))
    left = {}
    for r in sorted(edits.collect(), key=lambda r: (r.place, r.step)):
        if r.edit != "D":
            left.setdefault(r.conv_id, []).append(r.role[:1])
    assert all(SOUND.match("".join(x)) for x in left.values())
    assert report.count() == 60


def test_edge_cases(spark):
    schema = "key string, place int, conv_id long, turn long, role string, text string, mark int"
    assert repair_report(spark.createDataFrame([], schema)).collect() == []
    long = "x" * 300_000 + "."
    rows = [("a", 1, 5, None, None, None, 1), ("a", 1, 5, None, "user", long, 1), ("a", 1, 5, 2, "assistant", long, 2), (None, None, None, None, None, None, None)]
    assert found(repair_report(spark.createDataFrame(rows, schema))) == brute([r[2:6] for r in rows])
    # Every row of a conversation is dropped.
    gone = [(c, 0, "user", "Hi.") for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    expected = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert gone and set(found(repair_report(spark.createDataFrame(gone, SCHEMA))).values()) == {expected}
    assert damage(spark.createDataFrame(gone, SCHEMA)).count() == 0
