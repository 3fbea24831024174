"""Links of weak credential parts against a look at all pairs; null ids and repeated rows in the operators that group by text."""

import random
import re
from collections import Counter

from chemloom.llm import decontam, secrets, simhash

PATTERNS = [secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.WEAK_ID, secrets.WEAK_SECRET, secrets.ENDPOINT]


def scanned(text, scope):
    """(base, spans) of a text: every weak part is compared with every part."""
    found = [(m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if k or len(m[2]) >= 6]
    role = {0: "secret", 1: "id", 2: "secret", 3: "id", 4: "secret"}
    near = lambda w, p: p[0] - w[2] <= scope and w[0] - p[2] <= scope and (p[0], p[2]) != (w[0], w[2])
    has = lambda w, r: any(role.get(p[1]) == r and near(w, p) for p in found)
    kept = [w for w in found if w[1] >= 3 and {3: has(w, "secret"), 4: has(w, "id"), 5: has(w, "id") and has(w, "secret")}[w[1]]]
    told = lambda x: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(x))
    return told([x for x in found if x[1] < 3]), told([x for x in found if x[1] < 3] + kept)


def text_of(rng):
    parts = [
        lambda: "password=" + "x" * rng.randrange(4, 9), lambda: "AKIA" + "Z" * rng.randrange(14, 19), lambda: "ab12" * rng.randrange(5, 8), lambda: f"user: bob{rng.randrange(9)}",
        lambda: "aB3+" * 10, lambda: f"https://h{rng.randrange(9)}.org:80", lambda: "é" * rng.randrange(30), lambda: "client_id = zzz",
    ]
    return "".join(rng.choice(parts)() + " " * rng.choice([1, 3, 20, 49, 50, 51, 120]) for _ in range(rng.randrange(9)))


def test_links_by_all_pairs(spark):
    rng = random.Random(8)
    texts = [text_of(rng) for _ in range(250)]
    rows = [*enumerate(texts), (None, texts[0]), (None, texts[1]), (None, texts[1]), (3, texts[3]), (3, texts[4]), (None, None), (None, "")]
    got = Counter((r["id"], r["base"], r["spans"]) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), scope=50).collect())
    assert got == Counter((i, *scanned(t or "", 50)) for i, t in rows)
    assert sum("weak" in x[2] or "endpoint" in x[2] for x in got) > 40


def test_null_ids_and_repeated_rows(spark):
    """Rows that agree in id and text each come back, with what others of the text have."""
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(None, long), (None, long), (None, "other words of this text here"), (5, long), (5, long), (2, long + " end"), (None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    near = [(r["id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert Counter(i for i, *_ in near) == Counter(i for i, _ in rows)
    assert {c for i, f, c in near if f == "0" * 16} == {7}
    same = {f"{simhash.simhash(t.encode()):016x}" for t in (long, long + " end")}
    assert {c for _, f, c in near if f in same} <= {2, 5}
    bench = spark.createDataFrame([("a", long), ("a", long), (None, "other words of this text here")], "item_id string, text string")
    for limit in (1 << 20, 60):
        found = Counter((r["id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in decontam.decontaminate(docs, bench, max_pattern_bytes=limit).collect())
        hit = lambda t, n: (n, 40, ("a",), True) if t.startswith("word0") else (n, 0, (), False)
        assert found == Counter((i, *hit(t or "", len((t or "").split()))) for i, t in rows)
