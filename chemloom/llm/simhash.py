"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, each_text, join_unique, per_batch, text_bytes
from .components import connected_components

#: Bit masks of byte values: row b holds the 8 bits of b, highest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def simhash(text: bytes, width: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the hashes of the text's shingles; 0 for a text without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[i:j], seed) for i, j in spans), np.uint64, len(words) - width + 1)
    octets = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(h) < 2000:
        ones = np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, same, fp long): a hash of the text, and the fingerprint's 64 bits, as a signed number, of every whole text; null and
    empty texts have fingerprint 0. Repeated rows each come back; ids may be null; an empty table gives an empty result."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([simhash(t, width, seed) for t in each_text(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("same"), pa.array(fp)], names=["id", "same", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return per_batch(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("same"), text_bytes(text_col).alias("t")), work, f"id {kind}, same long, fp long")


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of all choices of blocks - distance out of the blocks: fingerprints within the distance agree under one at least."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def _forest(fp: np.ndarray, other: np.ndarray | None, distance: int) -> np.ndarray:
    """Links that connect what lies within the distance, inside fp or between fp and other: at most one for each row joined."""
    whole = fp if other is None else np.concatenate([fp, other])
    label = np.arange(len(whole))
    out = []
    for x in range(len(fp)):
        near = np.flatnonzero(np.bitwise_count(whole ^ fp[x]) <= distance)
        own, first = np.unique(label[near], return_index=True)
        if len(own) > 1:  # one link to each component that wasn't joined yet
            out += [(fp[x], whole[y]) for c, y in zip(own, near[first], strict=True) if c != label[x]]
            label[np.isin(label, own)] = own[0]
    return np.array(out, np.uint64).reshape(-1, 2)


def near_links(prints: DataFrame, distance: int = 4, blocks: int = 6, tile: int = 2000) -> DataFrame:
    """prints(fp long, distinct) -> (a, b): links between fingerprints at the distance or closer, enough to connect all such.

    Every fingerprint gets a row for each choice of blocks - distance of its blocks. Rows of a bucket are compared in tiles of
    about ``tile`` x ``tile``: larger buckets are dealt to several tiles, so no task takes a whole hot bucket, and a tile
    returns a spanning forest of its links, not all pairs. No prints, no links; a fingerprint alone has none.
    """
    masks = block_masks(distance, blocks)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("mask", "block"))
    sizes = keyed.groupBy("mask", "block").agg(F.count("*").alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / tile).cast("int"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    full = join_unique(keyed, sizes.withColumn("share", F.col("n")), ["mask", "block"], "n", len(masks) * prints.count()).withColumn("part", part)
    # Tile (i, j), i <= j, takes parts i and j; part p goes to the tiles (min(p, q), max(p, q)) of all q.
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(q, F.col("part")).alias("i"), F.greatest(q, F.col("part")).alias("j")))
    dealt = full.select("mask", "block", "fp", "part", F.explode(tiles).alias("tile"))
    dealt = dealt.select("fp", "part", "tile.i", F.xxhash64("mask", "block", "tile.i", "tile.j").alias("room"))
    shares = max(1, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def link(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A partition's rows come sorted by room; a room may span two batches."""
        held = None
        for got in rows:
            held = got if held is None else pd.concat([held, got])
            last = held["room"].to_numpy()[-1]
            done, held = held[held["room"] != last], held[held["room"] == last]
            yield rooms(done)
        if held is not None:
            yield rooms(held)

    def rooms(t: pd.DataFrame) -> pd.DataFrame:
        fp, room, first = t["fp"].to_numpy().view(np.uint64), t["room"].to_numpy(), (t["part"] == t["i"]).to_numpy()
        bounds = np.flatnonzero(np.diff(room)) + 1
        found = [np.empty((0, 2), np.uint64)]
        pair = np.diff(np.concatenate(([0], bounds, [len(fp)]))) == 2
        starts = np.concatenate(([0], bounds))
        x = starts[pair] if len(fp) else starts[:0]
        x = x[np.bitwise_count(fp[x] ^ fp[x + 1]) <= distance]
        found.append(np.stack([fp[x], fp[x + 1]], axis=1))
        for s, e in zip(starts[~pair], np.concatenate((bounds, [len(fp)]))[~pair], strict=True) if len(fp) else ():
            here, left = fp[s:e], first[s:e]
            found.append(_forest(here, None, distance) if left.all() else _forest(here[left], here[~left], distance))
        both = np.concatenate(found).view(np.int64)
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    return dealt.repartition(shares, "room").sortWithinPartitions("room").mapInPandas(link, "a long, b long").distinct()


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, width: int = 4, seed: int = 42, blocks: int = 6) -> DataFrame:
    """What near_duplicates() returns, and ``group``, the component's smallest fingerprint: components whose smallest ids are equal or null differ in it."""
    prints, _ = cut(fingerprints(docs, id_col, text_col, width, seed))
    nodes, _ = cut(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    parts = connected_components(near_links(nodes.select("fp"), distance, blocks))
    least, _ = cut(nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("group")))
    smallest = least.groupBy("group").agg(F.min("least").alias("component_id"), F.count("*").alias("prints"))
    of_print, _ = cut(join_unique(least, smallest, ["group"], "prints", least.count()).select("fp", "component_id", "group", "n"))
    whole = join_unique(prints, of_print, ["fp"], "n", prints.count())
    return whole.select("id", "same", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "group")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, width: int = 4, seed: int = 42, blocks: int = 6) -> DataFrame:
    """(id, same, fingerprint, component_id) of every row: components of the links between fingerprints ``distance`` or fewer bits apart.

    component_id is the smallest id reachable, itself included. Null or empty texts have fingerprint 0 and link like any other;
    repeated rows each come back; an empty table gives an empty result; other columns are ignored. Equal fingerprints are one
    node, so copies are never paired with each other.
    """
    return grouped(docs, id_col, text_col, distance, width, seed, blocks).drop("group")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs for each near-duplicate group: that of the smallest id (and text hash, if an id has several texts).

    Null ids come first. Groups are told apart by their fingerprints, so unrelated texts whose ids are null or equal all stay.
    Null and empty texts are one group; of rows that agree in id and text one stays; an empty table gives an empty result.
    All columns come back as they are, whatever their names."""
    found, _ = cut(grouped(docs, id_col, text_col, **options))
    kept = found.groupBy("group").agg(F.min(F.struct("id", "same")).alias("k")).select("k.id", "k.same").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("same")).alias("d")
    rows = rows.join(kept.alias("k"), F.expr("d.id <=> k.id and d.same = k.same"), "left_semi")
    # A row that is repeated with its id stays once; the rows are gathered by key only where there are any such.
    repeated = found.groupBy("id", "same").agg(F.count("*").alias("n")).filter("n > 1")
    return (rows if repeated.isEmpty() else rows.dropDuplicates(["id", "same"])).select("row.*")
