"""The pipeline, each stage judged on its own input by brute force."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from test_ops import WORD, brute_hits, brute_print

from chemloom.llm import mixing, toxicity


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], sf_dir).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    assert all(d.columns == columns for d in seen[:-1])
    start, clean, single, kept, mixed, shards = (rows_of(d) for d in seen)

    toxic = {r["id"] for r in toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("predicted = 1").collect()}
    by_id = lambda rows: sorted(rows, key=lambda r: r["doc_id"])
    assert by_id(clean) == by_id([r for r in start if r["doc_id"] not in toxic])

    ordered = by_id(clean)
    prints = [brute_print(r["text"]) for r in ordered]
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if group[i] != group[j] and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    assert by_id(single) == [ordered[g] for g in sorted(set(group))]

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r for r in single}
    assert by_id(kept) == by_id([r for r in single if not brute_hits(r["text"], [(str(n), t) for n, t in items])[3]]) and texts

    size = Counter()
    for r in kept:
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted(size)
    goal = dict(zip(order, mixing.targets([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 1.5 * sum(size.values()), 2), strict=True))
    taken, copies = Counter(), Counter()
    known = {r["doc_id"]: r for r in kept}
    for r in mixed:
        words = WORD.findall(r["text"] or "")
        taken[r["source"]] += len(words)
        copies[r["doc_id"]] += 1
        own = known[r["doc_id"]]
        assert r["text"] == own["text"] or set(words) <= set(WORD.findall(own["text"]))
        assert r["n_chars"] == len(r["text"])
    assert max(copies.values()) <= 2 and all(abs(taken[s] - goal[s]) <= 128 for s in order)

    slots = defaultdict(list)
    for r in shards:
        slots[r["shard"]].append(r["slot"])
    assert len(shards) == len(mixed) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert Counter(r["text_crc32"] for r in shards) == Counter(zlib.crc32(r["text"].encode()) for r in mixed)
    sums = Counter()
    for r in shards:
        sums[r["shard"]] += r["size"]
    assert len(sums) == 8 and max(sums.values()) <= 1.1 * min(sums.values())
