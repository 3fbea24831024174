"""Periodic runs against a walk over all periods."""

import random
import zlib

from chemloom.llm import queries, runs


def walked(w, least=12):
    """(start, length, period) of every maximal run, by comparing words q apart for every q."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(rng):
    w = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 10])) for _ in range(rng.randrange(90))]
    if len(w) > 20 and rng.random() < 0.6:
        a = rng.randrange(len(w))
        p = rng.randrange(1, max(2, (len(w) - a) // 2))
        w[a:] = [w[a + i % p] for i in range(len(w) - a)]
    return w


def test_runs_of_random_texts():
    rng = random.Random(5)
    for _ in range(150):
        texts = [periodic(rng) for _ in range(rng.randrange(10))]
        least = rng.choice([2, 5, 12])
        assert [[tuple(r) for r in x.tolist()] for x in runs.runs_of_texts(texts, least)] == [walked(t, least) for t in texts]


def test_small_steps_give_the_same(monkeypatch):
    monkeypatch.setattr(runs, "AT_ONCE", 7)
    rng = random.Random(6)
    texts = [periodic(rng) for _ in range(40)]
    assert [[tuple(r) for r in x.tolist()] for x in runs.runs_of_texts(texts)] == [walked(t) for t in texts]


def test_multiples_of_a_period_are_no_runs():
    got = runs.runs_of_texts([[b"a"] * 20, [b"a", b"b"] * 8 + [b"c"] * 12])
    assert [x.tolist() for x in got] == [[[0, 20, 1]], [[0, 16, 2], [16, 12, 1]]]
    assert runs.collapse([b"a", b"b"] * 8 + [b"c"] * 12, got[1]) == b"a b c"


def test_table(spark):
    rows = [(1, "x y " * 6, "i"), (1, "x y " * 6, "j"), (None, None, "k"), (2, "", "l"), (3, " \t\n", "m"), (4, "é  " * 13, "n"), (None, "a " * 11, "o"), (5, "w " * 30000 + "tail", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = sorted((r["id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(docs).collect())
    assert got == sorted([(1, 12, [(0, 12, 2)], "x y")] * 2 + [(0, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 13, [(0, 13, 1)], "é "), (0, 11, [], "a a a a a a a a a a a"), (5, 30001, [(0, 30000, 1)], "w tail")])
    assert runs.periodic_runs(docs.limit(0)).collect() == []


def test_damage(spark):
    rows = [(i, " ".join(f"w{i * j % 7}" for j in range(i % 40))) for i in range(300)] + [(None, "a b c"), (10, None)]
    got = {(r["doc_id"], r["text"]) for r in queries.with_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = set()
    for i, t in rows:
        w = (t or "").split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            t = " ".join([*w[:a], *(w[a + (k - a) % p] for k in range(a, len(w)))])
        want.add((i, t))
    assert got == want
