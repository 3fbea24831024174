"""The ten operators against brute force, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chemloom.llm import ann, components, decontam, licenses, mixing, pst, secrets, sharding, simhash, substring, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, id string, t string, key long, n_chars long"


def frame(spark, texts, sources=None):
    """Rows with extra columns whose names clash with the operators' own."""
    rows = [(i, t, (sources or ["a"] * len(texts))[i], "x", "y", 7, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa la mu nu".split()) + str(rng.randrange(40)) for _ in range(n))


ODD = [None, "", "   \n\t", "one", "Ünïcödé wörds ß 漢字 𝒳", "a" * 5000, "x " * 3000]


# 1


def test_sharding_is_balanced_and_gapless(spark):
    texts = [prose(i, 5 + i % 60) for i in range(300)] + ["same text again"] * 200 + ODD + ODD
    got = sharding.shard(frame(spark, texts), 8, per_pack=32).collect()
    assert sorted(r["id"] for r in got) == list(range(len(texts)))
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        body = (texts[r["id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(body) + 1, zlib.crc32(body))
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert sorted(slots) == list(range(8))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 6000
    again = {r["id"]: (r["shard"], r["slot"]) for r in sharding.shard(frame(spark, texts).repartition(7), 8, per_pack=32).collect()}
    assert again == {r["id"]: (r["shard"], r["slot"]) for r in got}
    assert sharding.shard(frame(spark, ["x"]).limit(0)).count() == 0


def test_sharding_balances_all_three(spark):
    texts = [prose(i, 5 + i * 7 % 60) for i in range(600)] + ["same text again"] * 300
    got = sharding.shard(frame(spark, texts), 8, per_pack=256).collect()
    for of in (lambda r: r["size"], lambda r: r["tokens"], lambda r: 1):
        sums = Counter()
        for r in got:
            sums[r["shard"]] += of(r)
        assert max(sums.values()) <= 1.06 * min(sums.values())


def test_packing_puts_items_where_room_is():
    bins = sharding.pack(np.array([[4.0, 1], [1, 4], [4, 1], [1, 4]]), 2)
    assert bins[0] != bins[2] and bins[1] != bins[3]


# 2


def brute_windows(texts, window):
    docs = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window, most", [(35, 100_000), (12, 100_000), (35, 3), (20, 1)])
def test_substring_dedup(spark, window, most):
    shared = prose(1, 50)
    texts = [prose(100 + i, 80) for i in range(30)]
    texts += [f"{prose(i, 9)} {shared} {prose(i + 1, i % 50)}" for i in range(200, 230)] + [f"{shared[:-9]} end", "p q r " * 60, prose(5, 90)]
    texts += [prose(5, 90)] * 20 + ODD + ODD
    rows = substring.dedup(frame(spark, texts), window=window, most=most, group_rows=500).collect()
    got = {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows}
    assert got == dict(enumerate(brute_windows(texts, window)))
    assert all(sum(x["to"] - x["from"] for x in r["removed"]) == r["n_removed"] for r in rows)
    kept = {r["doc_id"]: r["text"] for r in substring.kept_texts(frame(spark, texts), window=window, most=most).collect()}
    for i, (_, removed, digest) in got.items():
        assert kept[i] == texts[i] if not removed else hashlib.sha256(kept[i].encode()).hexdigest() == digest
    assert substring.dedup(frame(spark, ["x"]).limit(0)).count() == 0


def test_substring_dedup_with_null_ids_and_repeated_rows(spark):
    texts = [prose(i, 60) for i in range(4)] + [prose(9, 20) + " " + prose(0, 60), prose(3, 60), None, ""]
    rows = [(None if i % 2 else 5, t) for i, t in enumerate(texts)] * 2 + [(None, prose(70, 50)), (5, prose(71, 50))]
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"mark": F.lit(1), "n": F.lit(2), "removed": F.lit(3)})).collect()
    want = brute_windows([t for _, t in rows], 35)
    assert Counter((r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == Counter((i, *w) for (i, _), w in zip(rows, want))


def test_deep_nodes_are_classes_of_equal_suffixes():
    rng = np.random.default_rng(4)
    symbols = rng.integers(-2, 2, (500, 4))
    node = substring.deep_nodes(symbols)
    by_node = defaultdict(set)
    for n, s in zip(node.tolist(), map(tuple, symbols.tolist())):
        by_node[n].add(s)
    assert all(len(x) == 1 for x in by_node.values()) and len(by_node) == len(set(map(tuple, symbols.tolist())))
    assert substring.symbol_places(35, 8) == [0, 8, 16, 24, 27] and substring.symbol_places(16, 8) == [0, 8]


# 3


def brute_print(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark):
    texts = [prose(i, 60) for i in range(40)]
    texts += [re.sub(r"alpha\d+", "Alpha0", t, count=1) for t in texts] + [texts[0]] * 10 + ODD
    prints = [brute_print(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    for tile in (2000, 3):
        marks = simhash.near_links(simhash.fingerprints(frame(spark, texts)).select("fp").distinct(), tile=tile)
        assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 4 for r in marks.collect())
    got = {r["id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert got == {i: (f"{p:016x}", g) for i, (p, g) in enumerate(zip(prints, group))}
    kept = {r["doc_id"] for r in simhash.one_of_each(frame(spark, texts)).collect()}
    assert kept == set(group)
    assert simhash.near_duplicates(frame(spark, ["x"]).limit(0)).count() == 0


def test_one_of_each_with_shared_and_null_ids(spark):
    near = re.sub(r"alpha\d+", "Alpha0", prose(0, 60), count=1)
    rows = [(None, prose(i, 60)) for i in range(3)] + [(7, prose(i, 60)) for i in range(3, 6)] + [(9, prose(6, 60)), (8, prose(3, 60)), (None, prose(1, 60)), (None, near)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("group", F.lit("x"))
    got = Counter((r["doc_id"], r["text"]) for r in simhash.one_of_each(df).collect())
    link = (brute_print(prose(0, 60)) ^ brute_print(near)).bit_count() <= 4
    assert link and set(got.values()) == {1} and all(r in rows for r in got)
    assert sorted(0 if t == near else [prose(i, 60) for i in range(7)].index(t) for _, t in got) == list(range(7))


def test_hot_bucket_in_tiles_loses_no_link(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(400)}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    want = components.connected_components(simhash.near_links(df)).select("component").distinct().count()
    got = components.connected_components(simhash.near_links(df, tile=40)).select("component").distinct().count()
    assert got == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


# 4


def test_targets_share_and_stop():
    assert mixing.targets([10, 10, 100], [5, 2, 1], 180, 2) == [20, 20, 140]
    assert sum(mixing.targets([7, 30, 50, 0], [5, 2, 1, 5], 130.5, 2)) == pytest.approx(130.5)


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 9)) == list(range(n))


def test_draws_follow_the_need():
    need, limit = np.array([400.0, 0, 28, 132.4]), np.array([400, 10, 300, 300])
    got = mixing.draw_counts(need, limit, 40, 1)
    assert (got.sum(axis=0) <= limit).all() and got.sum() == round(need.sum()) and got[:, 1].sum() == 0
    assert (abs(got.sum(axis=0) - need) <= 5 * np.sqrt(need / 40 + 1)).all() and got.sum(axis=1).max() - got.sum(axis=1).min() <= 1
    assert len({tuple(r) for r in got}) > 5 and (mixing.draw_counts(need, limit, 40, 2) != got).any()
    assert mixing.draw_counts(np.array([9.0, 9]), np.array([4, 4]), 3, 1).sum() == 8  # no more than there is


def brute_targets(size, weight, total, cap):
    """Targets by repeated sharing of what sources at their stop leave."""
    goal, full = {}, set()
    while True:
        left = total - sum(goal[s] for s in full)
        free = [s for s in size if s not in full]
        goal |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if goal[s] > cap * size[s]]
        if not over:
            return goal
        for s in over:
            goal[s] = cap * size[s]
            full.add(s)


def test_mixing(spark):
    rng = random.Random(1)
    texts = [prose(i, rng.randrange(400)) for i in range(200)] + ODD + ["same words here"] * 30
    sources = [rng.choice(["b", "a", "é", None, "B"]) for _ in texts]
    df = frame(spark, texts, sources)
    got = {r["id"]: r for r in mixing.mix(df, block=16).collect()}
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    order = [*sorted({s for s in sources if s is not None}), None]
    total = {s: sum(size[i] for i in size if sources[i] == s) for s in order}
    goal = brute_targets(total, {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}, 1.5 * sum(size.values()), 2)
    taken, of_slot, of_source = Counter(), {}, defaultdict(Counter)
    for i, r in got.items():
        assert (r["size"], r["source_size"]) == (size[i], total[sources[i]])
        assert r["target"] == pytest.approx(goal[sources[i]])
        assert r["taken"] == sum(p["to"] - p["from"] for p in r["pieces"])
        covered = Counter((p["pass"], w) for p in r["pieces"] for w in range(p["from"], p["to"]))
        assert set(covered.values()) <= {1} and max((p for p, _ in covered), default=0) <= 1  # a word twice at most, once a pass
        taken[sources[i]] += r["taken"]
        for p in r["pieces"]:
            assert of_slot.setdefault((p["shard"], p["slot"]), sources[i]) == sources[i]
            of_source[sources[i]][p["shard"], p["slot"]] += p["to"] - p["from"]
    assert len(got) == len(texts) and all(abs(taken[s] - goal[s]) <= 16 * 8 for s in order)
    # Slots are gapless in each shard, hold a block each, and sources get what was drawn.
    in_shard = defaultdict(list)
    for shard, slot in of_slot:
        in_shard[shard].append(slot)
    assert all(sorted(x) == list(range(len(x))) for x in in_shard.values())
    for s in order:
        n = -(-total[s] // 16)
        assert all(w == 16 or w == total[s] - (n - 1) * 16 for w in of_source[s].values())
    need = np.array([goal[s] * -(-total[s] // 16) / total[s] for s in order])
    drawn = mixing.draw_counts(need, np.array([2 * -(-total[s] // 16) for s in order]), 256, 42)
    assert [[sum(k == s and x[0] == j for x, k in of_slot.items()) for s in order] for j in range(0, 256, 17)] == drawn[::17].tolist()
    again = {r["id"]: r["taken"] for r in mixing.mix(df.repartition(5), block=16).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}
    other = {r["id"]: r["taken"] for r in mixing.mix(df, block=16, draw_seed=7).collect()}
    assert other != again  # the draws alone decide what is taken
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def test_mixing_sends_no_blocks_through_the_driver(spark):
    df = frame(spark, [prose(i, 3000) for i in range(8)], ["a", "b"] * 4)
    for plan in (mixing.mix(df), mixing.mixed_documents(df)):
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()  # Spark takes a text's 94 blocks for one small row


@pytest.mark.parametrize("cap, share", [(2.0, 1.5), (3.5, 3.0), (1.5, 1.2)])
def test_mixed_documents(spark, cap, share):
    rng = random.Random(2)
    rows = [(rng.choice([None, 3, k]), prose(k % 25, rng.randrange(1, 90)), rng.choice(["a", "b", None]), k, "s", "p", 5, 0) for k in range(60)]
    rows += [rows[3], rows[3], (None, None, "a", 1, "s", "p", 5, 0), (None, "", "a", 1, "s", "p", 5, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` int, _same string, pieces string, `pass` int, n_chars int").repartition(3)
    got = mixing.mix(df, block=8, cap=cap, share=share).collect()
    want = sorted(sum(p["to"] - p["from"] for p in r["pieces"] if p["pass"] == k) for r in got for k in {p["pass"] for p in r["pieces"]})
    out = mixing.mixed_documents(df, block=8, cap=cap, share=share)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    out = out.collect()
    assert sorted(len(WORD.findall(r["text"])) for r in out) == want and max(Counter(p["pass"] for r in got for p in r["pieces"])) <= cap
    by_key = defaultdict(list)
    for r in rows:
        by_key[r[0], r[2], r[3]].append(set(WORD.findall(r[1] or "")))
    assert all(r["n_chars"] == len(r["text"]) and (r["_same"], r["pieces"], r["pass"]) == ("s", "p", 5) for r in out)
    assert all(any(set(WORD.findall(r["text"])) <= w for w in by_key[r["doc_id"], r["source"], r["a.b"]]) for r in out)


# 5


def brute_nearest(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float)
    out = {}
    for q in good:
        if q % 20 == 0:
            near = sorted((-float(np.dot(good[q], v)), i) for i, v in good.items() if i != q)[:k]
            out[q] = [i for _, i in near]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(8))]) for i in range(400)]
    rows += [(i, rows[40][1]) for i in range(400, 500)]
    rows += [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [None] * 8), (1080, [1.0] * 3), (None, [1.0] * 8), (20, rows[20][1]), (1100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit(2), "node": F.lit(3)})
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 20 == 0, leaf=60, trees=4, links=20, rounds=1).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["id"])
    want = brute_nearest(rows, 20)
    assert set(got) == set(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * sum(map(len, want.values()))
    assert got[40] == want[40]  # copies: ties to the smaller id
    few = ann.nearest(df.filter("vec_id in (0, 1, 2)"), F.col("id") % 20 == 0).collect()
    assert len(few) == 2
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("n", [600, 4000])
def test_nearest_with_outlier_norms(spark, n):
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((n, 16)) * np.exp(rng.standard_normal((n, 1)))
    rows[7] *= 1e6
    rows[11, 3] = 3e9
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in ann.nearest(df, F.col("id") % 20 == 0, leaf=100).collect():
        found[r["query_id"]].add(r["id"])
    asked = np.arange(0, n, 20)
    scores = rows[asked] @ rows.T
    scores[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len(found[q] & set(w)) / 20 for q, w in zip(asked.tolist(), want.tolist())]) >= 0.95


# 6


def brute_base(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


def test_secrets(spark):
    key, bare = "AKIA" + "Q7" * 8, "aB3" * 13 + "x"
    texts = [
        f"id {key} then {bare} at https://s3.example.com/x",
        f"{bare} alone",
        f"{key} {'z ' * 700}{bare}",
        "user = bob password: 'hunter22' https://h.example",
        "secret: token: abcdefgh",
        'API_KEY="abc" apikey=abcdef PASSWORD = 1234567',
        "𝒳é token = " + "0f" * 20,
        "AKIASHORT AKIA" + "A" * 16 + " " + "ab" * 12,
        f"https://h.example {key}",
        *ODD,
    ] * 2
    got = {r["id"]: r for r in secrets.scan(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute_base(t)
        assert got[i]["base"] == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
    kinds = lambda i: [s.split(":")[0] for s in got[i]["spans"].split(",") if s]
    assert kinds(0) == ["access", "weak_secret", "endpoint"]
    assert kinds(1) == [] and kinds(2) == ["access"]
    assert kinds(3) == ["weak_id", "assign", "endpoint"]
    assert kinds(8) == ["access"]
    assert secrets.scan(frame(spark, ["x"]).limit(0)).count() == 0


# 7


def brute_tree(train, held, least, z):
    """log10 probabilities from counts of contexts in a dictionary, the longest kept context found anew at each symbol."""
    count = defaultdict(Counter)
    for t in train:
        s = ["^"] * 5 + list(t) + ["$"]
        for i in range(5, len(s)):
            for d in range(6):
                count[tuple(s[i - d : i])][s[i]] += 1
    often = {c for c, n in count.items() if not c or n.total() >= least}
    keep = {()}
    for c in often:
        if c and c[1:] in often:
            own, up = count[c], count[c[1:]]
            g = 2 * sum(n * np.log((n / own.total()) / (up[x] / up.total())) for x, n in own.items())
            free = max(1, len(up) - 1)
            if g > free + z * np.sqrt(2 * free):
                keep |= {c[i:] for i in range(len(c) + 1)}

    def p(c, x):
        own, up = count[c], p(c[1:], x) if c else 1 / 257
        kinds = max(1, len(own))
        return (own[x] + kinds * up) / (own.total() + kinds)

    out = []
    for t in held:
        s, total = ["^"] * 5 + list(t) + ["$"], 0.0
        for i in range(5, len(s)):
            total += np.log10(p(next(c for c in (tuple(s[i - d : i]) for d in range(5, -1, -1)) if c in keep), s[i]))
        out.append(total)
    return out, len(keep)


@pytest.mark.parametrize("most", [100_000, 60])
def test_suffix_tree_scores(spark, most):
    texts = [prose(i, 1 + i % 70) for i in range(150)] + ODD + [prose(1, 40)] * 5
    df = frame(spark, texts)
    df = df.unionByName(df.filter("doc_id < 3")).unionByName(df.filter("doc_id < 4").withColumn("doc_id", F.lit(None).cast("long")))
    rows = [*enumerate(texts), *((i, texts[i]) for i in range(3)), *((None, texts[i]) for i in range(4))]
    got = pst.score(df, often_share=0.01, least_count=20, most_contexts=most).collect()
    assert len(got) == len(rows)
    low = {i: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] for i, (_, t) in enumerate(rows)}
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    count = Counter(x for k, w in low.items() if not held[k] for x in [*w, None])
    n, v = sum(count.values()), len(count)
    models, kept = brute_tree([" ".join(w).encode() for k, w in low.items() if not held[k]], [" ".join(w).encode() for w in low.values()], 20, 3.1)
    assert kept > 60
    want = []
    for k, (i, _) in enumerate(rows):
        tokens = [*low[k], None]
        want.append((i, held[k], len(tokens), sum(count[x] > 0 for x in tokens), n, sum(np.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens), models[k]))
    order = lambda rows: sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[2], r[5]))
    for g, w in zip(order([tuple(r[c] for c in ("id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in got]), order(want), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-4)
    assert pst.score(frame(spark, ["x"]).limit(0)).count() == 0


def test_tree_is_a_distribution_and_segments_agree():
    texts = [pst._symbols(prose(i, 60).encode().split()) for i in range(20)]
    codes, n = pst._gram_counts(texts)
    rows = Counter()
    for c, k in zip(codes.tolist(), n.tolist()):
        for d in range(pst.DEPTH + 1):
            rows[d, (c >> pst.BITS) & ((1 << pst.BITS * d) - 1), c & 511] += k
    tree = pst.SuffixTree(np.array([(*a, b) for a, b in rows.items()]))
    assert tree.kept > 5
    p = 10 ** tree.log.astype(float)
    p[:, tree.classes[pst.BEGIN]] = 0
    p[:, -1] *= pst.END + 1 - (tree.width - 2)  # the last column stands for all symbols that weren't seen
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    assert np.allclose(tree.score(texts, span=7), tree.score(texts, span=10_000), rtol=1e-5)


# 8


def brute_hits(text, items):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    doc = words(text)
    hit, own = set(), set()
    for name, item in items:
        w = words(item)
        size = min(13, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            for i in range(len(doc) - size + 1):
                if doc[i : i + size] == w[k : k + size]:
                    hit |= set(range(i, i + size))
                    own.add(name)
    return len(doc), len(hit), sorted(own), bool(hit) and 20 * len(hit) >= len(doc)


@pytest.mark.parametrize("limit", [4 << 20, 600])
def test_decontamination(spark, limit):
    items = [(f"i{k}", prose(900 + k, 30)) for k in range(12)] + [("short", "Only Five-words, here now"), ("one", "zzz"), ("none", "..."), ("null", None), ("i0b", prose(900, 30)), ("rep", "ha ha ha")]
    bench = spark.createDataFrame([*items, (None, "x y")], "item_id string, text string")
    texts = [prose(k, 50) for k in range(20)] + [prose(1, 40) + " " + prose(903, 30).upper().replace(" ", ", "), prose(2, 700) + " " + prose(904, 13), "only five words here now", "a zzz b", "ha ha ha ha", *ODD, *ODD]
    got = {r["id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontam.decontaminate(frame(spark, texts), bench, max_pattern_bytes=limit).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    kept = decontam.without_contaminated(frame(spark, texts), bench, max_pattern_bytes=limit)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, x in got.items() if not x[3]} and kept.columns == frame(spark, ["x"]).columns
    assert decontam.decontaminate(frame(spark, texts), bench.limit(0)).filter("n_hit > 0").count() == 0


# 9


def test_toxicity(spark):
    rng = random.Random(4)
    texts, marks = [], []
    for i in range(600):
        bad = rng.random() < 0.3
        w = prose(i, 40).split()
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["grubnak", "vorptil", "zosskin"]))
        texts.append(" ".join(w))
        marks.append((i, int(bad)))
    texts += ODD
    labels = spark.createDataFrame([*marks, (3, None), (None, 1), (5, marks[5][1])], "doc_id long, toxic int")
    got = {r["id"]: r for r in toxicity.score(frame(spark, texts), labels).collect()}
    assert len(got) == len(texts)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    out = [i for i, _ in marks if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == marks[i][1] for i in out) >= 0.97 * len(out)
    kept = {r["doc_id"] for r in toxicity.without_toxic(frame(spark, texts), labels).collect()}
    assert kept == {i for i in got if not got[i]["predicted"]}
    assert {r["score"] for r in toxicity.score(frame(spark, texts[:5]), labels.limit(0)).collect()} == {0.5}
    assert toxicity.score(frame(spark, ["x"]).limit(0), labels).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    vecs = []
    for _ in range(300):
        t = np.unique(np.minimum(rng.zipf(1.4, rng.integers(1, 30)), 80) - 1)
        w = rng.random(len(t)) + 0.01
        vecs.append((t, w / np.sqrt((w**2).sum())))
    vecs[7] = (np.empty(0, np.int64), np.empty(0))
    index = toxicity.BlockMaxIndex(vecs, rng.integers(0, 2, 300), np.arange(300), 80, size=8)
    assert 0 < len(index.dense) < 80
    dense = np.zeros((300, 80))
    for i, (t, w) in enumerate(vecs):
        dense[i, t] = w
    for i, (place, cos) in enumerate(index.nearest(vecs[:90], 10, list(range(90)))):
        every = np.delete(dense @ dense[i], i)
        want = np.sort(every[every > 1e-12])[::-1][:10]
        assert np.allclose(cos, want) and i not in index.keys[place]
        assert np.allclose(dense[index.keys[place]] @ dense[i], cos)


def brute_toxic(texts, marks, k):
    """Scores by plain sums: weights, cosines with every example, votes, and a logistic curve found by small steps."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = {i: Counter(split(t)) for i, t in texts.items()}
    examples, seen = [], set()
    for i, y in marks.items():
        if zlib.crc32(str(i).encode()) % 5 and i in texts and (texts[i] or "", y) not in seen:
            seen.add((texts[i] or "", y))
            examples.append((texts[i] or "", docs[i], y))
    df = Counter(w for d in docs.values() for w in d)
    pos, neg = Counter(w for _, d, y in examples if y for w in d), Counter(w for _, d, y in examples if not y for w in d)
    terms = set(pos) | set(neg)
    base = (sum(y for *_, y in examples) + 0.5) / (len(examples) + 1)
    weight = {}
    for w in terms:
        n = pos[w] + neg[w]
        p = (pos[w] + 2 * base) / (n + 2)
        g = n * (p * np.log(p / base) + (1 - p) * np.log((1 - p) / (1 - base)))
        weight[w] = (np.log((1 + len(docs)) / (1 + df[w])) + 0.1) * max(0.02, min(1, (g - np.log(len(terms)) / 2) / 20))

    def unit(d):
        v = {w: (1 + np.log(n)) * weight[w] for w, n in d.items() if w in weight}
        size = np.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / size for w, x in v.items()}

    known = [(t, unit(d), y) for t, d, y in examples]

    def share(v, skip=None):
        near = sorted((-sum(x * u.get(w, 0) for w, x in v.items()), y) for t, u, y in known if t != skip)[:k]
        near = [(-c, y) for c, y in near if c < -1e-12]
        return sum(y / (1.1 - c) for c, y in near) / sum(1 / (1.1 - c) for c, _ in near) if near else 0.0

    x, y = np.array([share(u, t) for t, u, _ in known]), np.array([y for *_, y in known])
    a = b = 0.0
    for _ in range(40_000):
        p = 1 / (1 + np.exp(-(a * x + b)))
        a, b = a + ((x * (y - p)).sum() - 0.01 * a) / len(x), b + ((y - p).sum() - 0.01 * b) / len(x)
    return {i: 1 / (1 + np.exp(-(a * share(unit(d)) + b))) for i, d in docs.items()}


def test_toxicity_against_brute_force(spark):
    rng = random.Random(9)
    texts, marks = {}, {}
    for i in range(220):
        w = prose(i, 25).split()
        if i % 4 == 0:
            w += rng.sample(["grubnak", "vorptil", "zosskin", "quend", "mirdle"], 2)
        texts[f"d{i}"] = " ".join(w)
        marks[f"d{i}"] = int(i % 4 == 0)
    texts |= {"null": None, "empty": "", "other": "none of these", "again": texts["d4"]}
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string").withColumns({"id": F.lit(1), "score": F.lit(2), "row": F.lit(3)}).repartition(3)
    labels = spark.createDataFrame(list(marks.items()), "doc_id string, toxic int")
    got = {r["id"]: r for r in toxicity.score(df.unionByName(df.filter("doc_id = 'again'")), labels, k=7).collect()}
    want = brute_toxic({**texts, "again2": texts["again"]}, marks, 7)
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r["score"] == pytest.approx(want[i], abs=2e-3)
        assert all(e["example"] in marks and e["toxic"] == marks[e["example"]] for e in r["evidence"])
    nulls = df.unionByName(df.withColumn("doc_id", F.lit(None).cast("string")).limit(3))
    kept = toxicity.without_toxic(nulls, labels, k=7)
    assert kept.columns == df.columns and kept.filter("doc_id is null").count() <= 3


# 10


def test_licences(spark):
    texts = [prose(i, 30) for i in range(40)]
    texts += [f"{prose(1, 9)}\nReleased under the MIT License.\n{prose(2, 9)}", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "The driver lost her license last week.", *ODD] * 2
    got = {r["id"]: (r["family"], r["confirmed"], r["n_licence"]) for r in licenses.scan(frame(spark, texts)).collect()}
    assert [got[i] for i in range(40, 44)] == [("MIT", True, 1), ("GPL-3.0", True, 1), ("CC-BY-NC", True, 1), ("Apache-2.0", True, 1)]
    assert all(got[i] == ("unknown", False, 0) for i in [*range(40), *range(44, 44 + 1 + len(ODD))])
    assert len(got) == len(texts)
    assert licenses.scan(frame(spark, ["x"]).limit(0)).count() == 0


def test_licences_of_wrapped_and_negated_notices(spark):
    grant = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files,\n  to deal in the Software without restriction."
    texts = [f"{prose(1, 9)}.\n\n{grant}\n\n{prose(2, 9)}", "The software is not licensed under the MIT License.", "This essay is about the history of the Apache License.", "Redistribution and use in source and binary forms, with or without modification, are permitted\r\nprovided that the following conditions are met.", "All rights reserved.", "Licensed under the Mozilla Public License, version 2.0"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (0, texts[1]), (0, texts[0]), *((100 + i, prose(i, 40) + ".") for i in range(60))]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumns({"row": F.lit(1), "place": F.lit(2), "label": F.lit(3)})
    found = licenses.scan(df).collect()
    got = Counter((r["id"], r["family"], r["confirmed"]) for r in found if r["id"] is None or r["id"] < 100)
    assert got == Counter({(0, "MIT", True): 2, (0, "unknown", False): 1, (None, "MIT", True): 1, (1, "unknown", False): 1, (2, "unknown", False): 1, (3, "BSD", True): 1, (4, "Proprietary", True): 1, (5, "MPL-2.0", True): 1})
    assert all(r["family"] == "unknown" for r in found if (r["id"] or 0) >= 100)


def test_licence_probabilities_by_brute_force(spark):
    texts = [f"{prose(i, 12)}. {t}" for i, t in enumerate(t for ts in licenses.TEMPLATES.values() for t in ts)] + [prose(i, 30) for i in range(40)]
    df = frame(spark, texts)
    model = licenses.fit(df, "doc_id", "text", 4000)
    got = {r["id"]: r for r in licenses.scan(df, floor=0.05, model=model).collect()}
    assert np.allclose(model["w"], licenses.fit(df, "doc_id", "text", 4000)["w"], atol=1e-9)
    for i, t in enumerate(texts):
        w = re.findall(licenses.WORD, t.lower())
        grams = {" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)}
        z = model["b"] + sum((model["w"][:, k] for k, term in enumerate(model["terms"]) if term in grams), np.zeros(len(model["b"])))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = int(p[:-1].argmax())
        if p[best] >= 0.05:
            assert got[i]["family"] == model["names"][best] and got[i]["probability"] == pytest.approx(p[best], abs=1e-6)
        else:
            assert got[i]["family"] == "unknown"


def test_pattern_of_strings():
    words = ["mit", "mpl-2.0", "mpl", "a", "ab"]
    p = re.compile(licenses.one_of(words) + "$")
    assert all(p.match(w) for w in words) and not any(p.match(w) for w in ("mi", "mpl-2x0", "abc", ""))


@pytest.mark.parametrize("ids", ["one", "null", "own"])
def test_sharding_of_repeated_rows(spark, ids):
    """2000 texts and 3000 copies of one row: the copies are dealt out even where they agree in id and text."""
    rows = [(i, f"text {i:05} " + "x" * (i % 50)) for i in range(2000)]
    rows += [({"one": 7, "null": None, "own": 10**6 + i}[ids], "the same text") for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 8).collect()
    assert sorted(((r["id"] is None, r["id"] or 0, r["size"]) for r in got)) == sorted(((i is None, i or 0, len(t) + 1) for i, t in rows))
    sizes, counts = [0] * 8, [[] for _ in range(8)]
    for r in got:
        sizes[r["shard"]] += r["size"]
        counts[r["shard"]].append(r["slot"])
    assert all(sorted(c) == list(range(len(c))) for c in counts)
    assert max(sizes) <= 1.01 * sum(sizes) / 8 and min(sizes) >= 0.99 * sum(sizes) / 8 and max(map(len, counts)) <= 1.05 * len(rows) / 8


def test_sharding_of_one_text(spark):
    got = sharding.shard(spark.createDataFrame([(None, "a b")] * 4000 + [(1, None)], "doc_id long, text string"), 8).collect()
    counts = [sum(r["shard"] == k for r in got) for k in range(8)]
    assert sum(counts) == 4001 and max(counts) <= 520 and all(sorted(r["slot"] for r in got if r["shard"] == k) == list(range(counts[k])) for k in range(8))
