"""Cheapest repairs of conversations, by Four-Russians tables of blocks of turns.

A turn is one of nine symbols: to be deleted, or its role's initial (s, u, a, another) with or without a truncated text. A state tells which
initial came last in the repaired conversation. The costs to finish from each state, less the least of them, take few values, so
what a block of symbols does to them is looked up in a table; the edits of a block are found by going back through it from the
costs at its end, then choosing forward."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, join_unique

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
BLOCK, SYMBOLS, STATES = 4, 9, 4
#: States: nothing yet, after s, after u, after a. The state that each initial leads to, and the only one to insert or rerole to.
AFTER = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
NEXT = [2, 2, 3, 2]
INITIALS = "sua"
ROLE = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\v\f\r"


def symbol(initial: str, delete: bool, truncated: bool) -> int:
    return 0 if delete else 1 + (INITIALS.index(initial) if initial and initial in INITIALS else 3) + 4 * truncated


def _edits(sym: int, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, state after) of the edits that use up the turn, in the order of their initials."""
    out = [("D", DELETE, state)]
    if sym:
        extra, initial = TRUNCATED * (sym > 4), (INITIALS + "-")[(sym - 1) % 4]
        if initial in AFTER[state]:
            out.append(("K", extra, AFTER[state][initial]))
        out.append(("R", REROLE + extra, NEXT[state]))
    return out


def _inserted(costs: list[int]) -> tuple[int, ...]:
    """Costs that may begin with inserted turns."""
    out = list(costs)
    for _ in range(STATES):
        out = [min(c, INSERT + out[NEXT[q]]) for q, c in enumerate(out)]
    return tuple(out)


def _before(costs: tuple[int, ...], sym: int) -> tuple[int, ...]:
    """Costs to finish before a turn, by those after it."""
    return _inserted([min(c + costs[to] for _, c, to in _edits(sym, q)) for q in range(STATES)])


@cache
def tables() -> dict[str, np.ndarray | list]:
    """vectors: the normalised costs, the first those at the end; one, rise: by vector and symbol, the vector before it and what was
    subtracted; block, block_rise: the same for blocks of BLOCK symbols, their first symbol the highest digit; piece, to: by vector
    after a turn, its symbol and the state before it, the least initials of cheapest edits through it, and the state they lead to."""
    end = _inserted([0, 1 << 20, 1 << 20, 0])
    vectors, number = [end], {end: 0}
    one, rise = [], []
    for v in vectors:  # grows
        before = [_before(v, x) for x in range(SYMBOLS)]
        rise.append([min(b) for b in before])
        one.append([])
        for b, low in zip(before, rise[-1], strict=True):
            b = tuple(c - low for c in b)
            if b not in number:
                number[b] = len(vectors)
                vectors.append(b)
            one[-1].append(number[b])
    step, up = np.array(one), np.array(rise)
    digits = np.indices((SYMBOLS,) * BLOCK).reshape(BLOCK, -1)
    block = np.repeat(np.arange(len(vectors))[:, None], digits.shape[1], axis=1)
    block_rise = np.zeros_like(block)
    for d in digits[::-1]:
        block_rise += up[block, d]
        block = step[block, d]
    piece = [[[_forward(v, x, q) for q in range(STATES)] for x in range(SYMBOLS)] for v in vectors]
    to = np.array([[[p[1] for p in by_state] for by_state in by_symbol] for by_symbol in piece])
    return {"vectors": vectors, "one": step, "rise": up, "block": block, "block_rise": block_rise, "piece": piece, "to": to}


def _forward(after: tuple[int, ...], sym: int, state: int) -> tuple[str, int, list[int]]:
    """(initials, state after, states that an insertion or a new role leads to): D before I before K before R, as each is cheapest."""
    costs, said, made = _before(after, sym), "", []
    while True:
        fits = {e: to for e, c, to in _edits(sym, state) if c + after[to] == costs[state]}
        edit = "D" if "D" in fits else "I" if INSERT + costs[NEXT[state]] == costs[state] else min(fits)
        said += edit
        if edit in "IR":
            made.append(NEXT[state])
        state = NEXT[state] if edit == "I" else fits[edit]
        if edit != "I":
            return said, state, made


def _codes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first len % BLOCK symbols one by one, the others as codes of whole blocks."""
    head = len(symbols) % BLOCK
    blocks = symbols[head:].reshape(-1, BLOCK).astype(np.int64)
    return symbols[:head], blocks @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))


def backward(symbols: np.ndarray, last: int = 0) -> tuple[list[int], int, int]:
    """(vectors at the end of each whole block, from the first; the vector before the first symbol; what was subtracted), going back from the vector ``last``."""
    t = tables()
    head, codes = _codes(symbols)
    at, v, total = [], last, 0
    for code in codes[::-1].tolist():
        at.append(v)
        total += int(t["block_rise"][v, code])
        v = int(t["block"][v, code])
    for x in head[::-1].tolist():
        total += int(t["rise"][v, x])
        v = int(t["one"][v, x])
    return at[::-1], v, total


def trace(symbols: np.ndarray, last: int = 0, state: int = 0) -> tuple[list[tuple[str, int, list[int]]], int]:
    """(the piece of each turn, the state after the last), from ``state``, ending at the vector ``last``. A block's edits are chosen
    forward once its vectors are known, which are found backward from the one at its end."""
    t = tables()
    ends, _, _ = backward(symbols, last)
    head = len(symbols) % BLOCK
    first, out = backward(symbols[head:], last)[1] if head else 0, []
    stretches = [(symbols[:head], first)] if head else []
    stretches += [(symbols[head + BLOCK * i : head + BLOCK * (i + 1)], v) for i, v in enumerate(ends)]
    for part, v in stretches:
        inside = [v]
        for x in part[:0:-1].tolist():
            inside.append(int(t["one"][inside[-1], x]))
        for x, after in zip(part.tolist(), inside[::-1], strict=True):
            out.append(t["piece"][after][x][state])
            state = out[-1][1]
    return out, state


def finish(state: int) -> list[int]:
    """States of the turns that are inserted at the end."""
    return [2, 3] if state == 1 else [3] if state == 2 else []


def told(pieces: list[tuple[str, int, list[int]]], roles: list[str], texts: list[str]) -> Iterator[str]:
    """The lines of the repaired turns."""
    for (said, _, made), role, text in zip(pieces, roles, texts, strict=True):
        new = iter(made)
        for edit in said:
            if edit == "K":
                yield f"{role}:{text}"
            elif edit == "R":
                yield f"{ROLE[next(new)]}:{text}"
            elif edit == "I":
                yield f"{ROLE[next(new)]}:"


def fault(text: str, seen: bool) -> str:
    rest = text.rstrip(SPACE)
    return "blank" if not rest else "duplicate" if seen else "truncated" if rest[-1] not in ".!?" else ""


def one_conversation(turns: list, roles: list[str], texts: list[str]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines joined by newlines) of turns in their order."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for row in zip(roles, texts, strict=True):
        faults.append(fault(row[1], row in seen))
        seen.add(row)
    symbols = np.array([symbol(r[:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(roles, faults, strict=True)], np.int64)
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a[:1] + b[:1] not in LEGAL for a, b in pairwise(roles))
    pieces, state = trace(symbols)
    _, v, total = backward(symbols)
    tail = finish(state)
    audit = "".join(p[0] for p in pieces) + "I" * len(tail)
    lines = [*told(pieces, roles, texts), *(f"{ROLE[q]}:" for q in tail)]
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, total + tables()["vectors"][v][0], audit, "\n".join(lines)


FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _small(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations that a task can hold, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, out = ([], [], []), None, []

        def packed() -> pa.RecordBatch:
            names = ["id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
            types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        id_type, size = None, 0
        for batch in batches:
            id_type = batch.schema.field("id").type
            for id_, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("id", "turn", "role", "text")), strict=True):
                if held[0] and id_ != now:
                    out.append((now, *one_conversation(*held)))
                    size += len(out[-1][-1])
                    held = ([], [], [])
                    if len(out) == 2000 or size > 1 << 24:
                        yield packed()
                        out, size = [], 0
                now = id_
                for to, x in zip(held, (turn, role, text), strict=True):
                    to.append(x)
        if held[0]:
            out.append((now, *one_conversation(*held)))
        if out:
            yield packed()

    ordered = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    return ordered.mapInArrow(run, f"id {kind}, {FIELDS}, repaired string").withColumn("repaired_sha256", F.sha2(F.col("repaired").cast("binary"), 256))


def summary(symbols: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """For each vector at a stretch's end: the vector before the stretch, what was subtracted, and the states after it by those before it."""
    t = tables()
    head, codes = _codes(symbols)
    v = np.arange(len(t["vectors"]))
    rise, ends = np.zeros(len(v), np.int64), []
    for code in codes[::-1].tolist():
        ends.append(v)
        rise += t["block_rise"][v, code]
        v = t["block"][v, code]
    first = v
    for x in head[::-1].tolist():
        rise += t["rise"][v, x]
        v = t["one"][v, x]
    state = np.tile(np.arange(STATES), (len(v), 1))
    stretches = [(head, first)] if len(head) else []
    stretches += [(symbols[len(head) + BLOCK * i : len(head) + BLOCK * (i + 1)], e) for i, e in enumerate(ends[::-1])]
    for part, e in stretches:
        inside = [e]
        for x in part[:0:-1].tolist():
            inside.append(t["one"][inside[-1], x])
        for x, after in zip(part.tolist(), inside[::-1], strict=True):
            state = t["to"][after[:, None], x, state]
    return v.tolist(), rise.tolist(), state.ravel().tolist()


def _judged(t: pd.DataFrame) -> pd.DataFrame:
    """A stretch's distinct rows in order, with the fault of each one's first copy and how many more copies there are.

    Later copies have to be deleted, as blanks or duplicates. That adds a D and its cost and changes neither a state nor a vector, so
    they are counted, not made, however many there are."""
    t = t.sort_values("place").reset_index(drop=True)
    return t.assign(found=[fault(x, s) for x, s in zip(t["text"], t["seen"], strict=True)], more=t["copies"] - 1)


def _symbols(t: pd.DataFrame) -> np.ndarray:
    return np.array([symbol(r[:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(t["role"], t["found"], strict=True)], np.int64)


def _large(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations that are dealt to many tasks in stretches of their turns; only a stretch's summary is put together with others."""
    spark = rows.sparkSession
    once = rows.groupBy("id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    once, p0 = cut(once.withColumn("same", F.sha2(F.concat_ws("\0", F.length("role"), "role", "text"), 256)))
    first = once.groupBy(F.struct("id").alias("k"), "same").agg(F.min(F.struct("turn")).alias("least"), F.count("*").alias("n"))
    marked = join_unique(once.withColumn("k", F.struct("id")), first, ["k", "same"], "n", once.count())
    marked = marked.select("id", "turn", "role", "text", "copies", (F.struct("turn") != F.col("least")).alias("seen"))
    dealt = marked.repartitionByRange("id", "turn", "role", "text").sortWithinPartitions("id", "turn", "role", "text")
    dealt, p1 = cut(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))

    def look(t: pd.DataFrame) -> pd.DataFrame:
        t = _judged(t)
        v, rise, state = summary(_symbols(t))
        roles, more = t["role"].tolist(), int(t["more"].sum())
        illegal = more + sum(a[:1] + b[:1] not in LEGAL for a, b in pairwise(roles))
        n = {x: int((t["found"] == x).sum()) for x in ("blank", "duplicate", "truncated")}
        blank = int(t["more"][t["found"] == "blank"].sum())
        return pd.DataFrame([(t["id"].iloc[0], t["part"].iloc[0], v, [r + DELETE * more for r in rise], state, roles[0][:1], roles[-1][:1], illegal, n["blank"] + blank, n["duplicate"] + more - blank, n["truncated"])])

    seen = dealt.groupBy("id", "part").applyInPandas(look, f"id {kind}, part int, v array<int>, rise array<long>, state array<int>, first string, last string, illegal long, blank long, duplicate long, truncated long")

    def join(t: pd.DataFrame) -> pd.DataFrame:
        """The vector after each stretch and the state before it; the conversation's own figures on its first stretch."""
        t = t.sort_values("part").reset_index(drop=True)
        ends, v, cost = [], 0, 0
        for i in range(len(t) - 1, -1, -1):
            ends.append(v)
            cost += t["rise"][i][v]
            v = t["v"][i][v]
        cost += tables()["vectors"][v][0]
        starts, state = [], 0
        for i, e in enumerate(ends[::-1]):
            starts.append(state)
            state = int(t["state"][i][STATES * e + state])
        illegal = t["illegal"].sum() + sum(a + b not in LEGAL for a, b in zip(t["last"][:-1], t["first"][1:], strict=True))
        own = {"cost": cost, "illegal": illegal, **{c: t[c].sum() for c in ("blank", "duplicate", "truncated")}}
        last = t["part"].iloc[-1]
        return pd.DataFrame({"id": t["id"], "part": t["part"], "end": ends[::-1], "start": starts, "final": t["part"] == last, **own})

    plan, p2 = cut(seen.groupBy("id").applyInPandas(join, f"id {kind}, part int, end int, start int, final boolean, cost long, illegal long, blank long, duplicate long, truncated long"))

    def mend(t: pd.DataFrame) -> pd.DataFrame:
        """A stretch's initials and repaired lines, some at a time, each with its newline but the conversation's first."""
        end, start, final = t["end"].iloc[0], t["start"].iloc[0], t["final"].iloc[0]
        t = _judged(t)
        pieces, state = trace(_symbols(t), end, start)
        said = "".join(p[0] + "D" * n for p, n in zip(pieces, t["more"], strict=True))
        lines = list(told(pieces, t["role"].tolist(), t["text"].tolist()))
        if final:
            said += "I" * len(finish(state))
            lines += [f"{ROLE[q]}:" for q in finish(state)]
        out, size, held = [], 0, []
        for line in lines:
            held.append("\n" + line)
            size += len(line)
            if size > 1 << 18:
                out, held, size = [*out, "".join(held)], [], 0
        out.append("".join(held))
        return pd.DataFrame({"id": t["id"].iloc[0], "part": t["part"].iloc[0], "at": range(len(out)), "said": [said] + [""] * (len(out) - 1), "lines": out})

    known = dealt.withColumn("k", F.struct("id")).join(F.broadcast(plan.select(F.struct("id").alias("k"), "part", "end", "start", "final")), ["k", "part"]).drop("k")
    mended = known.groupBy("id", "part").applyInPandas(mend, f"id {kind}, part int, at int, said string, lines string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes a conversation's lines as they come, in order."""
        now, sha, audit, id_type, new = None, None, [], None, True

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], id_type), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], names=["id", "audit", "repaired_sha256"])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for i in range(batch.num_rows):
                id_, said, lines = (batch.column(c)[i].as_py() for c in ("id", "said", "lines"))
                if sha is not None and id_ != now:
                    yield done()
                    sha = None
                if sha is None:
                    now, sha, audit, new = id_, hashlib.sha256(), [], True
                audit.append(said)
                if lines:
                    sha.update(lines[new:].encode())  # without the first newline of all
                    new = False
        if sha is not None:
            yield done()

    sums = mended.repartition("id").sortWithinPartitions("id", "part", "at").select("id", "said", "lines").mapInArrow(digest, f"id {kind}, audit string, repaired_sha256 string")
    turns = once.groupBy("id", "turn").agg(F.lit(1).alias("x")).groupBy("id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    own = plan.filter("final").select(F.struct("id").alias("k"), "blank", "duplicate", "truncated", "illegal", "cost")
    whole = own.join(turns.select(F.struct("id").alias("k"), "gaps"), "k").join(sums.select(F.struct("id").alias("k"), "audit", "repaired_sha256"), "k")
    found, _ = cut(whole.select("k.id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
    discard(spark, p0, p1, p2)
    return found.withColumn("repaired", F.lit(None).cast("string"))


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most: int = 100_000) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired, repaired_sha256) of every conversation: its faults, the cheapest
    edits that make its role initials s?(ua)+ or nothing, as initials (K, R, D, I; of several the least string), and the turns they leave.

    Turns are taken by number, nulls first, equal numbers by role and text. Null roles and texts count as one blank; null ids are one
    conversation; repeated rows are duplicates; an empty table gives an empty result; other columns are ignored. A conversation of up
    to ``most`` rows is held by one task. Larger ones are dealt to tasks in stretches, and ``repaired`` is null for them (its hash is there):
    only the hash, which has to read turns one after the other, is one task's stream, holding one piece at a time and the audit."""
    kind = dict(rows.dtypes)[id_col]
    fill = lambda c: F.coalesce(F.col(c), F.lit(" "))
    t = rows.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), fill(role_col).alias("role"), fill(text_col).alias("text"))
    columns = ["id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired", "repaired_sha256"]
    large = t.groupBy("id").count().filter(F.col("count") > most).select("id")
    large, path = cut(large)
    if large.isEmpty():
        discard(rows.sparkSession, path)
        return _small(t, kind).select(*columns)
    key = F.broadcast(large.select(F.col("id").alias("big")))
    is_large = F.col("id").eqNullSafe(F.col("big"))
    small = _small(t.join(key, is_large, "left_anti"), kind)
    return small.select(*columns).unionByName(_large(t.join(key, is_large, "left_semi"), kind).select(*columns))
