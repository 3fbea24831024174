"""Repairs of conversations against a search through all edits, cheapest first."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from chemloom.llm import queries, repair

WHOLE, BEGUN = re.compile(r"(s?(ua)+)?\Z"), re.compile(r"s?(ua)*u?\Z")


def searched(turns, roles, texts):
    """What one_conversation() returns, found by trying all edits in the order of their cost, then their initials."""
    seen, faults = set(), []
    for row in zip(roles, texts):
        rest = row[1].rstrip(" \t\n\v\f\r")
        faults.append("blank" if not rest else "duplicate" if row in seen else "" if rest[-1] in ".!?" else "truncated")
        seen.add(row)
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, out, lines = heapq.heappop(heap)
        if i == len(roles) and WHOLE.match(out):
            break
        if (i, out[-1:]) in done:
            continue
        done.add((i, out[-1:]))
        name = {"u": "user", "a": "assistant"}
        edits = [("I", 3, x, i, f"{name[x]}:") for x in "ua"]
        if i < len(roles):
            edits.append(("D", 4, "", i + 1, None))
            more = 3 * (faults[i] == "truncated")
            if faults[i] not in ("blank", "duplicate"):
                edits += [("K", more, roles[i][:1] or "?", i + 1, f"{roles[i]}:{texts[i]}")] + [("R", 3 + more, x, i + 1, f"{name[x]}:{texts[i]}") for x in "ua"]
        for e, c, x, to, line in edits:
            if BEGUN.match(out + x):
                heapq.heappush(heap, (cost + c, audit + e, to, out + x, lines + (() if line is None else (line,))))
    known = [t for t in turns if t is not None]
    pairs = [a[:1] + b[:1] for a, b in zip(roles, roles[1:])]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, "\n".join(lines)


def some(rng, most=9):
    n = rng.randrange(most)
    turns = sorted(rng.randrange(12) for _ in range(n))
    return turns, [rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", " "]) for _ in turns], [rng.choice(["a.", "b", "", "c!", " ", "d?", "e "]) for _ in turns]


def test_least_audits():
    rng = random.Random(3)
    for _ in range(1500):
        c = some(rng)
        assert repair.one_conversation(*c) == searched(*c)


def test_tables_are_few():
    t = repair.tables()
    assert t["block"].shape == (len(t["vectors"]), repair.SYMBOLS**repair.BLOCK) and len(t["vectors"]) < 100


def table_of(conversations, spark):
    rows = [(k, *r) for k, c in conversations.items() for r in zip(*c)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, id string").repartition(5)


@pytest.mark.parametrize("most", [100, 6, 0])
def test_tables_of_conversations(spark, most):
    """Also with conversations of over six rows, and with all, taken in stretches."""
    rng = random.Random(9)
    found = {}
    for k in (*range(60), None):
        turns, roles, texts = some(rng, 14)
        rows = sorted(zip(turns, roles, texts))
        if rows:
            found[k] = tuple(list(x) for x in zip(*rows))
    if most == 6:
        found[77] = ([1] * 40 + [2] * 300, ["user"] * 40 + ["assistant"] * 300, ["same."] * 40 + sorted(f"t{i}" for i in range(300)))
    got = {r["id"]: r for r in repair.repair(table_of(found, spark), most=most).collect()}
    assert set(got) == set(found)
    for k, c in found.items():
        want = repair.one_conversation(*c) if len(c[0]) > 100 else searched(*c)
        assert tuple(got[k][x] for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")) == want[:7], k
        assert got[k]["repaired_sha256"] == hashlib.sha256(want[7].encode()).hexdigest()
        assert got[k]["repaired"] == (want[7] if len(c[0]) <= most else None)


@pytest.mark.parametrize("most", [100, 0])
def test_null_turns_come_first(spark, most):
    rows = [(1, None, "user", "hi."), (1, 0, "assistant", "ho."), (1, None, None, None), (2, None, "assistant", "x.")]
    got = {r["id"]: tuple(r)[1:8] for r in repair.repair(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), most=most).collect()}
    assert got == {1: (0, 1, 0, 0, 1, 4, "DKK"), 2: (0, 0, 0, 0, 0, 3, "IK")}
    assert repair.repair(spark.createDataFrame([], "conv_id int, turn int, role string, text string"), most=most).collect() == []


def test_query(spark, tmp_path, sf_dir):
    rng = random.Random(4)
    rows = [(k if k else None, t if t < 6 else None, rng.choice(["system", "user", "assistant", None]), rng.choice(["a b.", "c", None, "d!"])) for k in range(150) for t in range(rng.randrange(1, 8))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    damaged = {k: [] for k, *_ in rows}
    for k, t, role, text in rows:
        n = zlib.crc32(f"{' ' if k is None else k}:{' ' if t is None else t}".encode()) % 20
        text = "" if n == 1 else re.sub("[.!?]", "", text or " ") if n == 2 else text or " "
        damaged[k] += [(t, "user" if n == 4 else role or " ", text)] * (0 if n == 0 else 2 if n == 3 else 1)
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op13_four_russians_conversation_repair(spark, str(tmp_path)).collect()}
    want = {}
    for k, r in damaged.items():
        r.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        *head, lines = searched(*(list(x) for x in zip(*r))) if r else (0, 0, 0, 0, 0, 0, "", "")
        want[k] = (*head, hashlib.sha256(lines.encode()).hexdigest())
    assert got == want
