"""Repaired conversations against every sequence of edits, and the query against a plain reading of its rules."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

pytest.importorskip("runloom.llm")
from runloom.llm import queries  # noqa: E402
from runloom.llm import turn_repair as T  # noqa: E402

SHAPE = re.compile(r"(s?(ua)+)?")
SHA = lambda x: hashlib.sha256(x.encode()).hexdigest()


def faults_of(rows: list[tuple]) -> list:
    seen, out = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows: list[tuple]) -> tuple[int, str, list[tuple[str, str]]]:
    """By full recursion over rows and states, comparing (cost, initials) of whole sequences; inserts: two in a row at most."""
    faults = faults_of(rows)
    steps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    @cache
    def best(i: int, q: int, inserted: int) -> tuple:
        ways = [(0, "", ())] if i == len(rows) and q in (0, 3) else []
        if inserted < 2:
            for role in ("user", "assistant"):
                if role[0] in steps[q] and (b := best(i, steps[q][role[0]], inserted + 1)):
                    ways.append((b[0] + 2, "I" + b[1], ((role, ""), *b[2])))
        if i < len(rows):
            _, role, text = rows[i]
            if b := best(i + 1, q, 0):
                ways.append((b[0] + 3, "D" + b[1], b[2]))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                for letter, cost, new in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                    if new[:1] in steps[q] and (b := best(i + 1, steps[q][new[:1]], 0)):
                        ways.append((b[0] + cost + extra, letter + b[1], ((new, text), *b[2])))
        return min(ways, default=())

    for i in range(len(rows), 0, -100):  # else the recursion of a long conversation is too deep
        for q in steps:
            best(i, q, 0)
    return best(0, 0, 0)


def report(rows: list[tuple]) -> tuple:
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    cost, audit, turns = cheapest(rows) if rows else (0, "", ())
    faults = faults_of(rows)
    assert SHAPE.fullmatch("".join(r[:1] for r, _ in turns))
    at = [t for t, _, _ in rows if t is not None]
    pairs = ["".join(x[1][:1] for x in p) for p in itertools.pairwise(rows)]
    gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, SHA("\n".join(f"{r}:{t}" for r, t in turns))


def test_no_sequence_of_edits_is_better():
    """cheapest() itself against all strings of edits that fit."""
    rng = random.Random(1)
    for _ in range(40):
        rows = [(k, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["a.", "b", "", "c!"])) for k in range(rng.randint(0, 2))]
        faults, found = faults_of(rows), []
        for size in range(len(rows) + 4):
            for edits in itertools.product([("D", ""), ("K", ""), ("R", "user"), ("R", "assistant"), ("I", "user"), ("I", "assistant")], repeat=size):
                if sum(e != "I" for e, _ in edits) != len(rows):
                    continue
                i, cost, out = 0, 0, []
                for e, role in edits:
                    if e == "I":
                        cost += 2
                        out.append(role)
                        continue
                    if e == "D":
                        cost += 3
                    else:
                        cost += {"K": 0, "R": 2}[e] + (faults[i] == "truncated") + 99 * (faults[i] in ("blank", "duplicate"))
                        out.append(role or rows[i][1])
                    i += 1
                if cost < 99 and SHAPE.fullmatch("".join(r[0] for r in out)):
                    found.append((cost, "".join(e for e, _ in edits)))
        assert min(found) == cheapest(rows)[:2], rows


def made(rng: random.Random, n: int) -> list[tuple]:
    roles = ["user", "assistant"] * 6 + ["system", "tool", "", "unknown", " "]
    return [(rng.choice([None, *range(n + 3)]), rng.choice(roles), rng.choice(["a.", "b!", "b ", "", " \t", "longer text?", "no end", "é."])) for _ in range(n)]


def test_structure_equals_full_recursion(spark):
    rng = random.Random(13)
    talks = {c: made(rng, rng.choice([1, 2, 3, 4, 5, 6, 9, 17, 40])) for c in range(120)} | {None: made(rng, 7)}
    rows = [(c, *r, "x") for c, turns in talks.items() for r in turns]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cid string").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in T.structure(df).collect()}
    assert set(got) == set(talks)
    for c, turns in talks.items():
        assert got[c] == report(turns), (c, turns)
    assert T.structure(df.where("false")).count() == 0


def test_long_conversation_is_cut_into_blocks(spark):
    rng = random.Random(4)
    rows = [(7, k, rng.choice(["user", "assistant", "system"]), f"{k}" + rng.choice([".", ""])) for k in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = T.faults(df).cache()
    assert turns.select("block").distinct().count() == 30 and turns.groupBy("block").count().agg({"count": "max"}).first()[0] == 30
    (row,) = T.structure(df).collect()
    assert tuple(row)[1:] == report([r[1:] for r in rows])


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["One. Two!", "x", None, "?!.", "same."])) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "q."), (99, None, "user", "q.")]
    rows = [r for r in rows if r[0] != 5 or zlib.crc32(f"{r[0]}:{r[1]}".encode()) % 20 == 0]  # 5: rows that are dropped, if any
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    talks: dict = {}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        talks.setdefault(c, []).extend([(t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    got = {r.conv_id: tuple(r)[1:] for r in queries.op13_turn_repair(spark, str(tmp_path)).collect()}
    assert got == {c: report(turns) for c, turns in talks.items()}
