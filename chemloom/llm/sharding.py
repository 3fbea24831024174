"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, cut, discard, equal_text_key, join_unique, text_bytes

DIMS = ("bytes", "tokens", "rows")


def pack(loads: np.ndarray, shards: int) -> np.ndarray:
    """A bin for each item: the largest items first, each where the dot product with the residual capacity is highest.

    The capacity of every bin is an equal part of each dimension's sum; loads and residues are measured in it."""
    capacity = np.maximum(loads.sum(axis=0) / shards, 1e-9)
    scaled = loads / capacity
    residue = np.ones((shards, loads.shape[1]))
    out = np.zeros(len(loads), np.int32)
    for i in np.argsort(-scaled.sum(axis=1), kind="stable"):
        k = int(np.argmax(residue @ scaled[i]))
        out[i] = k
        residue[k] -= scaled[i]
    return out


def even_out(loads: np.ndarray, bins: np.ndarray, shards: int, rounds: int = 64, close: float = 1e-3) -> np.ndarray:
    """Swaps items between the bins with most and fewest bytes, one for one, while that brings their bytes nearer.

    A swap must not set the two bins further apart in any other dimension than they are, or than ``close`` of the mean."""
    bins = bins.copy()
    for _ in range(rounds):
        sums = np.stack([np.bincount(bins, weights=c, minlength=shards) for c in loads.T], axis=1)
        high, low = int(sums[:, 0].argmax()), int(sums[:, 0].argmin())
        gap = sums[high] - sums[low]
        a, b = np.flatnonzero(bins == high), np.flatnonzero(bins == low)
        if gap[0] <= close * sums[:, 0].mean() or not len(a) or not len(b):
            break
        moved = loads[a][:, None] - loads[b][None, :]
        good = (moved[..., 0] > 0) & (moved[..., 0] < gap[0])
        good &= (np.abs(gap - 2 * moved) <= np.maximum(np.abs(gap), close * sums.mean(axis=0)))[..., 1:].all(axis=-1)
        if not good.any():
            break
        i, j = np.unravel_index(np.where(good, np.abs(moved[..., 0] - gap[0] / 2), np.inf).argmin(), good.shape)
        bins[a[i]], bins[b[j]] = low, high
    return bins


def _packed(items: DataFrame, shards: int) -> DataFrame:
    """items(pack, item, bytes, tokens, rows) -> the same with bin; one task holds one pack at a time."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("item", kind="stable")
        loads = t[list(DIMS)].to_numpy(float)
        return t.assign(bin=even_out(loads, pack(loads, shards), shards))

    kinds = dict(items.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("pack", "item", *DIMS))
    return items.select("pack", "item", *DIMS).groupBy("pack").applyInPandas(run, f"{schema}, bin int")


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.sum(d).alias(d) for d in DIMS])


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", per_pack: int = 4096, grain: int = 64) -> DataFrame:
    """(id, size, text_crc32, tokens, group, shard, slot) of every row.

    Rows with equal texts are a group and stay together unless the group is over 1/``grain`` of a shard in bytes, tokens or
    rows; then its rows are dealt out in as many parts as it takes, by id, and by place where several share one. Groups are dealt by hash to packs of
    about ``per_pack``; each pack is packed into ``shards`` bins, whose bytes are then brought nearer by swaps, and the bins are packed
    again as items of the next level, until one pack is left. So every task holds a bounded number of groups, at any size. Slots count
    from 0 in each shard without gaps: rows inside their item, items inside their bin, bins inside their shard.

    size is UTF-8 bytes plus 1; null texts have none, form a group with empty ones and have the CRC of no bytes. Repeated rows
    each get a slot; null ids are allowed; an empty table gives an empty result; other columns are ignored.
    """
    b = text_bytes(text_col)
    rows = docs.select(F.col(id_col).alias("id"), *equal_text_key(text_col), F.crc32(b).alias("text_crc32"), (F.octet_length(b) + 1).cast("long").alias("bytes"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACE_WORD)).cast("long").alias("tokens"))
    rows = rows.withColumns({"rows": F.lit(1).cast("long"), "group": F.xxhash64("key_a", "key_b", "key_n")}).drop("key_a", "key_b", "key_n")
    rows, seen_at = cut(rows.withColumn("place", F.monotonically_increasing_id()))  # fixed by being written
    groups = _sums(rows, "group")
    whole = rows.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIMS]).first()
    limit = {d: max(1.0, whole[d] / (shards * grain)) for d in DIMS}
    parts = F.greatest(*[F.ceil(F.col(d) / limit[d]) for d in DIMS], F.lit(1)).cast("long")
    rows = join_unique(rows, groups.select("group", parts.alias("parts"), F.col("rows").alias("n")), ["group"], "n", whole["rows"])
    # A group is dealt out by id, so that reruns agree; copies that share an id, by their places.
    rows = rows.withColumn("named", F.xxhash64(F.col("id").cast("string")))
    shared = rows.filter("parts > 1").groupBy("group", "named").agg(F.count("*").alias("n"), F.lit(True).alias("shared")).filter("n > 1")
    rows = join_unique(rows, shared, ["group", "named"], "n", whole["rows"], "left")
    part = F.pmod(F.when(F.col("shared"), F.col("place")).otherwise(F.col("named")), F.col("parts"))
    rows = rows.withColumn("item", F.when(F.col("parts") == 1, F.col("group")).otherwise(F.xxhash64("group", part)))
    rows, _ = cut(rows.drop("place", "named", "shared"))
    discard(docs.sparkSession, seen_at)
    items, n = _sums(rows, "item"), rows.select("item").distinct().count()

    packs = -(-n // per_pack) or 1
    level, _ = cut(_packed(items.withColumn("pack", F.pmod(F.xxhash64("item"), F.lit(packs))), shards))
    place = level.select("item", F.col("pack").alias("pack0"), F.col("bin").alias("bin0"), (F.col("pack") * shards + F.col("bin")).alias("node"))
    trail = place
    while packs > 1:
        bins = _sums(level.withColumn("item", F.col("pack") * shards + F.col("bin")), "item")
        packs = -(-packs * shards // per_pack) or 1
        level, _ = cut(_packed(bins.withColumn("pack", F.pmod(F.xxhash64("item"), F.lit(packs))), shards))
        up = level.select(F.col("item").alias("node"), (F.col("pack") * shards + F.col("bin")).alias("next"))
        trail = trail.join(up, "node").drop("node").withColumnRenamed("next", "node")
    shard_of = trail.select("item", "pack0", "bin0", F.col("node").cast("int").alias("shard"))

    placed, _ = cut(rows.join(shard_of, "item"))
    counts, _ = cut(placed.groupBy("shard", "pack0", "bin0", "item").agg(F.count("*").alias("n")))
    ahead = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = counts.groupBy("shard", "pack0", "bin0").agg(F.sum("n").alias("n")).withColumn("before", ahead(["shard"], ["pack0", "bin0"]))
    offsets = counts.withColumn("inside", ahead(["shard", "pack0", "bin0"], ["item"])).join(bins.drop("n"), ["shard", "pack0", "bin0"])
    offsets = offsets.select("item", (F.col("before") + F.col("inside")).alias("offset"))
    slots = placed.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy("id", "text_crc32"))).join(offsets, "item")
    return slots.select("id", F.col("bytes").alias("size"), "text_crc32", "tokens", "group", "shard", (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"))
