"""Mixing sources to target weights: fixed-length blocks, multinomial source counts per shard, permuted block indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, cut, discard, each_text, per_batch


def targets(sizes: list[float], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares ``total`` by weight; a source stops at cap * size and its excess goes to the others by weight."""
    limit = [cap * s for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: limit[i] / weights[i])
    left, weight, out = min(total, sum(limit)), sum(weights), [0.0] * len(sizes)
    for n, i in enumerate(order):
        if limit[i] / weights[i] > left / weight:
            for j in order[n:]:
                out[j] = left * weights[j] / weight
            break
        out[i] = limit[i]
        left, weight = left - limit[i], weight - weights[i]
    return out


def draw_counts(need: np.ndarray, limit: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each output shard, (shards, sources): one multinomial draw for each shard.

    A shard's chances are what each source is short of its part of ``need`` up to this shard, so a draw that falls short is
    made up for by the next ones: totals differ from ``need`` by the chance of about one shard. No total exceeds ``limit``;
    what a source may not take any more is drawn again from the others."""
    rng, drawn, out = np.random.default_rng(seed), np.zeros(len(need), np.int64), np.zeros((shards, len(need)), np.int64)
    for k in range(shards):
        part = (k + 1) / shards
        left = round(need.sum() * part) - int(drawn.sum())
        due = np.minimum(np.maximum(need * part - drawn, 0.0), limit - drawn)
        while left > 0 and (drawn < limit).any():
            chance = due if due.sum() > 0 else (limit - drawn).astype(float)
            got = np.minimum(rng.multinomial(left, chance / chance.sum()), limit - drawn)
            out[k] += got
            drawn += got
            left -= int(got.sum())
            due = np.where(drawn < limit, np.maximum(due - got, 0.0), 0.0)
    return out


def permute(x: np.ndarray, n: int | np.ndarray, key: int | np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n-1: a four-round Feistel network whose results beyond n are sent through again. Each of x may
    have an n and a key of its own."""
    v = x.astype(np.uint64)
    n, key = np.broadcast_to(np.asarray(n, np.int64), v.shape), np.broadcast_to(np.asarray(key, np.int64), v.shape).astype(np.uint64)
    bits = np.frexp(np.maximum(n - 1, 2).astype(float))[1]  # as int.bit_length(), below 2**53
    half = np.maximum((bits + 1) // 2, 1).astype(np.uint64)
    over = np.arange(len(v))
    while len(over):
        h, k, one = half[over], key[over] * np.uint64(4), np.uint64(1)
        mask = (one << h) - one
        a, b = v[over] >> h, v[over] & mask
        for r in range(4):
            f = (b + ((k + np.uint64(r + 1)) & np.uint64(0xFFFFFFFF))) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(32)) & mask)
        v[over] = (a << h) | b
        over = over[v[over] >= n[over].astype(np.uint64)]
    return v.astype(np.int64)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int | None = None, shards: int = 256, seed: int = 42, per_bucket: int = 2048, draw_seed: int = 42) -> DataFrame:
    """(id, same, size, source, source_size, target, taken, pieces) of every row.

    size counts the words of the text (null: none). Sources in code point order, null last, have the weights in turn; their
    targets share ``share`` times all words, none above ``cap`` times its source's. A source's rows, in the order of a hash,
    form a stream that is cut into blocks of ``block`` words: 32, or as many as leave some 2**28 blocks of all words, so that rows of the
    join don't grow with a very large corpus. Each output shard draws how many of its slots each source gets
    (draw_counts(), by ``draw_seed``). A source's slots are numbered through the shards; slot i is block perm(i mod n) under
    the permutation of pass i div n (by ``seed``), and blocks and slots are joined by index. ``pieces`` lists the ranges of
    words taken, with pass, shard and place in the shard; a pass takes a word once at most, and ``cap`` rounded up is the
    number of passes. ``taken`` sums the pieces up. ``same`` is a hash of the text.

    Ties and repeated rows each have their own place; sources without words have target 0; an empty table gives an empty
    result; other columns are ignored; reruns agree. One row for each source goes through the driver, none for a document.
    Rows that agree in id and text share a bucket of the prefix sums.
    """
    spark = docs.sparkSession
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACE_WORD)).cast("long")
    rows, rows_at = cut(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("same"), F.col(source_col).cast("string").alias("source"), words.alias("size")))
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    block = block or max(32, -(-sum(sizes) // (1 << 28)))
    goal = targets([float(s) for s in sizes], [float(weights[i % len(weights)]) for i in range(len(found))], share * sum(sizes), cap)
    blocks = np.array([-(-s // block) for s in sizes], np.int64)
    need = np.array([g * b / s if s else 0.0 for g, b, s in zip(goal, blocks, sizes, strict=True)])
    of_source = spark.createDataFrame([(i, r["source"], r["size"], goal[i]) for i, r in enumerate(found)], "src int, source string, source_size long, target double")

    # Where each row's words begin in its source's stream: sums by bucket, then inside the bucket.
    buckets = max(1, -(-sum(r["n"] for r in found) // per_bucket))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "same", F.lit(seed)), F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    bases = bases.alias("b").join(F.broadcast(of_source).alias("o"), F.expr("b.source <=> o.source")).select("b.*", "src", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("id", "same", "size")
    placed = rows.withColumns({"place": F.row_number().over(inside), "ahead": F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}).alias("r")
    # Joins of rows are merged: Spark judges a table by its files, and what these hold many times over would pass through the driver whole.
    placed = placed.hint("merge").join(bases.alias("b"), F.expr("r.source <=> b.source and r.bucket = b.bucket")).select("id", "same", "r.source", "size", "src", "r.bucket", "place", "source_size", "target", (F.col("base") + F.col("ahead")).alias("start"))
    placed, _ = cut(placed)
    discard(spark, rows_at)

    counts = draw_counts(need, np.floor(cap * blocks).astype(np.int64), shards, draw_seed)
    taken_slots = slots(spark, counts, blocks, seed)
    blocks_of = placed.filter("size > 0").select("src", "bucket", "place", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    begin = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    end = F.least((F.col("block") + 1) * block - F.col("start"), F.col("size"))
    # Spark takes the blocks for as small as the table they are listed from, and would broadcast them all through the driver.
    pieces = blocks_of.hint("merge").join(taken_slots, ["src", "block"]).select("src", "bucket", "place", F.struct(begin.alias("from"), end.alias("to"), "pass", "shard", "slot").alias("p"))
    taken = pieces.groupBy("src", "bucket", "place").agg(F.sum(F.col("p.to") - F.col("p.from")).alias("taken"), F.array_sort(F.collect_list("p")).alias("pieces"))
    none = F.array().cast("array<struct<from:bigint,to:bigint,pass:int,shard:int,slot:bigint>>")
    return placed.hint("merge").join(taken, ["src", "bucket", "place"], "left").select("id", "same", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("pieces", none).alias("pieces"))


def slots(spark: SparkSession, counts: np.ndarray, blocks: np.ndarray, seed: int, step: int = 1 << 16) -> DataFrame:
    """(src, block, pass, shard, slot): the block of each slot of the output shards.

    counts(shards, sources) are runs of a source's indexes, taken in the order of the shards; each index goes through the
    permutation of its pass. Inside a shard, slots are dealt by another permutation, so that its sources lie mixed. Runs of more than
    ``step`` slots are cut; a task expands some 250,000 slots at once, of whatever runs. No counts, no slots."""
    first, ahead, sizes = np.cumsum(counts, axis=0) - counts, np.cumsum(counts, axis=1) - counts, counts.sum(axis=1)
    runs = [(int(s), int(k), int(first[k, s]), int(ahead[k, s]), int(counts[k, s]), int(blocks[s]), int(sizes[k])) for k, s in zip(*np.nonzero(counts), strict=True)]
    dealt = spark.createDataFrame(runs, "src int, shard int, at long, ahead long, n long, blocks long, size long")
    dealt = dealt.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))))
    dealt = dealt.select("src", "shard", (F.col("at") + F.col("from")).alias("at"), (F.col("ahead") + F.col("from")).alias("ahead"), F.least(F.col("n") - F.col("from"), F.lit(step)).alias("n"), "blocks", "size")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            chunk = (t["n"].cumsum() - 1) // 250_000
            for _, c in t.groupby(chunk.to_numpy()):
                src, shard, at, before, count, n, size = (c[x].to_numpy() for x in ("src", "shard", "at", "ahead", "n", "blocks", "size"))
                of = np.repeat(np.arange(len(c)), count)
                inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                i = at[of] + inside
                rounds = i // n[of]
                block = permute(i % n[of], n[of], seed * 1_000_003 + src[of].astype(np.int64) * 101 + rounds)
                slot = permute(before[of] + inside, size[of], seed * 7919 + shard[of].astype(np.int64))
                yield pd.DataFrame({"src": src[of].astype(np.int32), "block": block, "pass": rounds.astype(np.int32), "shard": shard[of].astype(np.int32), "slot": slot})

    total = int(counts.sum())
    tasks = max(total // 250_000 + 1, min(spark.sparkContext.defaultParallelism, total // 10_000 + 1))
    return dealt.repartition(tasks, "src", "shard", "at").mapInPandas(run, "src int, block long, pass int, shard int, slot long")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars", **options) -> DataFrame:
    """The rows of docs as the mix has them: a row for each pass of the mix that takes some of its words.

    A row whose words are all taken keeps its text as it is; else its text is the taken words, joined by blanks. ``length_col``,
    if docs has it, is set to the new text's length. Rows of which nothing is taken, as null and empty texts, go. Rows that
    agree in id, text and source are matched with their takings by a hash of the whole row. An empty table gives an empty
    result; all other columns come back as they are, whatever their names."""
    got = mix(docs, id_col, text_col, source_col, **options).filter("taken > 0")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("same"), F.col(source_col).cast("string").alias("source"))
    on = "d.id <=> g.id and d.same = g.same and d.source <=> g.source"
    if not rows.groupBy("id", "same").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        key = Window.partitionBy("id", "same", "source")
        rows = rows.withColumn("rank", F.row_number().over(key.orderBy(F.xxhash64("row"))))
        got = got.withColumn("rank", F.row_number().over(key.orderBy("pieces")))
        on += " and d.rank = g.rank"
    full = rows.alias("d").hint("merge").join(got.alias("g"), F.expr(on)).select("d.row", "g.size", "g.pieces")
    full = full.withColumn("pass", F.explode(F.array_distinct(F.transform("pieces", lambda p: p["pass"]))))
    full = full.withColumn("pieces", F.filter("pieces", lambda p: p["pass"] == F.col("pass")))
    cover = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + p["to"] - p["from"])
    names, kinds = docs.columns, [t for _, t in docs.dtypes]
    text_at, length_at = names.index(text_col), names.index(length_col) if length_col in names else None

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [batch.column(i) for i in range(len(names))]
        texts = []
        for text, pieces, whole in zip(each_text(batch), batch.column("pieces").to_pylist(), batch.column("whole").to_pylist(), strict=True):
            if not whole:
                w = text.split()
                text = b" ".join(b" ".join(w[p["from"] : p["to"]]) for p in pieces)
            texts.append(text.decode("utf-8", "replace"))
        cols[text_at] = pa.array(texts, pa.string())
        if length_at is not None:
            cols[length_at] = pa.array([len(t) for t in texts]).cast(cols[length_at].type)
        return pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(names))])

    own = [F.col("row").getField(n).alias(f"c{i}") for i, n in enumerate(names)]
    ready = full.select(*own, F.transform("pieces", lambda p: F.struct(p["from"].alias("from"), p["to"].alias("to"))).alias("pieces"), F.col("row").getField(text_col).cast("binary").alias("t"), (cover >= F.col("size")).alias("whole"))
    return per_batch(ready, work, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))).toDF(*names)
