"""Approximate nearest neighbours: NN-descent builds a neighbour graph by iterative joins, a greedy search walks it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

#: A node's neighbours, nearest first, and which of them the step that made the list has brought.
LIST = "ids array<long>, sims array<float>"
MERGED = f"node long, {LIST}, fresh array<boolean>"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>): rows whose vector has the commonest length, finite components and one that isn't 0; an id once."""
    v = F.col(vec_col).cast("array<double>")
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(good).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.filter(F.size("v") == (common["d"] if common else 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _matrix(packed: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float32).reshape(len(packed), -1)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """The packed vectors of an Arrow column as one matrix."""
    cells = column.combine_chunks().cast(pa.large_binary())
    at = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset : cells.offset + len(cells) + 1]
    flat = np.frombuffer(cells.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(cells) else np.zeros(0, np.uint8)
    return flat.view(np.float32).reshape(len(cells), len(flat) // 4 // max(1, len(cells)))


def _lists(names: list, lengths: list, *flat: list) -> list[pa.Array]:
    """A column of names and, for each of ``flat``, one of lists of these lengths."""
    ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *lengths]))]).astype(np.int32))
    kinds = (np.int64, np.float32, bool)
    return [pa.array(np.concatenate([np.zeros(0, np.int64), *names]))] + [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, t), *x]).astype(t))) for t, x in zip(kinds, flat, strict=False)]


def _top(ids: np.ndarray, sims: np.ndarray, old: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of a list other than ``own``, an id once, nearest first, ties to the smaller id; and which weren't there before."""
    order = np.lexsort((ids, -sims))
    was, ids, sims = ids[old], ids[order], sims[order]
    first = np.sort(np.unique(ids, return_index=True)[1])
    first = first[ids[first] != own][:k]
    return ids[first], sims[first], ~np.isin(ids[first], was)


def plant_trees(sample: np.ndarray, trees: int, levels: int, seed: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Random-projection trees: each level has one direction, and each branch splits at the sample's median along it, at 0 if
    no row of the sample is there. A level costs one sort of the sample, whatever the number of its branches."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        way = rng.standard_normal((levels, sample.shape[1])).astype(np.float32)
        leaf, cuts = np.zeros(len(sample), np.int64), []
        for d in range(levels):
            x = sample @ way[d]
            order = np.lexsort((x, leaf))
            ends = np.searchsorted(leaf[order], np.arange((1 << d) + 1))
            low, high = (ends[:-1] + ends[1:] - 1) // 2, (ends[:-1] + ends[1:]) // 2
            inside = x[order][np.minimum(np.stack([low, high]), len(x) - 1)].mean(axis=0)
            median = np.where(ends[1:] > ends[:-1], inside, 0).astype(np.float32)
            leaf = leaf * 2 + (x > median[leaf])
            cuts.append(median)
        out.append((way, cuts))
    return out


class Graph:
    """nodes(node, vec packed) and, for each, the k nearest nodes found so far."""

    def __init__(self, nodes: DataFrame, k: int, leaf: int, trees: int, rounds: int, settled: float, seed: int, sample: int = 20_000):
        self.spark, self.nodes, self.k = nodes.sparkSession, nodes, k
        self.n, width = nodes.agg(F.count("*"), F.coalesce(F.max(F.octet_length("vec")), F.lit(0))).first()
        self.parts = self.n * (2 * k * (width + 16) + 64) // (16 << 20) + 1
        self.lists, path = cut(self._first(leaf, trees, seed, sample))
        while True:
            new, new_path = cut(self._round())
            discard(self.spark, path)
            self.lists, path, rounds = new, new_path, rounds - 1
            self.spark.sparkContext._jvm.System.gc()  # the round's shuffle files go once its plans are collected
            # Lists only get nearer, so the number of fresh neighbours comes to 0 in the end.
            if rounds <= 0 and (new.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0] or 0) <= settled * self.n * k:
                break
        self.beside = self.adjacency().persist()

    def _merged(self, known: DataFrame | None, found: DataFrame, k: int) -> DataFrame:
        """known(node, ids, sims), one list of each node, and found, many for a node -> one list of the k nearest for each node."""
        rows = found.select("node", "ids", "sims", F.transform("ids", lambda x: F.lit(False)).alias("old"))
        if known is not None:
            rows = known.select("node", "ids", "sims", F.transform("ids", lambda x: F.lit(True)).alias("old")).unionByName(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                names = batch.column("node").to_numpy()
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("ids")).to_numpy())])
                ids, sims, old = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "sims", "old"))
                got = []
                for own, a, b in zip(names, ends[:-1], ends[1:], strict=True):
                    if b - a <= k and old[a:b].all():  # nothing was found
                        got.append((ids[a:b], sims[a:b], np.zeros(b - a, bool)))
                    else:
                        got.append(_top(ids[a:b], sims[a:b], old[a:b], k, own))
                lengths = np.array([len(g[0]) for g in got], np.int64)
                yield pa.RecordBatch.from_arrays(_lists([names], [lengths], *zip(*got, strict=True)), ["node", "ids", "sims", "fresh"])

        both = rows.groupBy("node").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("ids", "sims", "old")])
        return both.mapInArrow(run, MERGED)

    def _first(self, leaf: int, trees: int, seed: int, sample: int) -> DataFrame:
        """Neighbours inside the leaves of random trees, whose splits are fitted on a bounded sample."""
        k = self.k
        levels = max(0, int(np.ceil(np.log2(max(1, self.n) / leaf))))
        rows = self.nodes.orderBy(F.xxhash64("node")).limit(sample).select("vec").toPandas()  # bounded
        forest = self.spark.sparkContext.broadcast(plant_trees(_matrix(rows["vec"]), trees if levels else 1, levels, seed) if len(rows) else [])

        def leaves(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for t in parts:
                x = _matrix(t["vec"])
                for tree, (way, cuts) in enumerate(forest.value):
                    at = np.zeros(len(x), np.int64)
                    for d, median in enumerate(cuts):
                        at = at * 2 + (x @ way[d] > median[at])
                    yield pd.DataFrame({"node": t["node"], "vec": t["vec"], "leaf": at * len(forest.value) + tree})

        dealt, dealt_at = cut(self.nodes.mapInPandas(leaves, "node long, vec binary, leaf long"))
        sizes = dealt.groupBy("leaf").agg(F.ceil(F.count("*") / (2 * leaf)).cast("long").alias("parts"))
        dealt = dealt.join(sizes, "leaf").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))

        def near(t: pd.DataFrame) -> pd.DataFrame:
            x, names = _matrix(t["vec"]), t["node"].to_numpy()
            ids, sims = [], []
            for i in range(0, len(x), 512):
                s = x[i : i + 512] @ x.T
                best = np.argpartition(-s, min(k, len(x) - 1), axis=1)[:, : k + 1]
                for own, b, row in zip(names[i : i + 512], best, s, strict=True):
                    b = b[names[b] != own]
                    ids.append(names[b])
                    sims.append(row[b])
            return pd.DataFrame({"node": names, "ids": ids, "sims": sims})

        found = dealt.select("leaf", "part", "node", "vec").groupBy("leaf", "part").applyInPandas(near, f"node long, {LIST}")
        merged, _ = cut(self._merged(None, found, k))
        discard(self.spark, dealt_at)
        return merged

    def adjacency(self) -> DataFrame:
        """(v, w, fresh, way, bucket): each node's neighbours and up to k of the nodes that have it as one, a row each, with their vectors."""
        ahead = self.lists.select("node", F.explode(F.arrays_zip("ids", "sims", "fresh")).alias("x")).select(F.col("node").alias("v"), F.col("x.ids").alias("w"), F.col("x.sims").alias("sim"), F.col("x.fresh").alias("fresh"))
        best = Window.partitionBy("v").orderBy(F.desc("sim"), "w")
        back = ahead.select(F.col("w").alias("v"), F.col("v").alias("w"), "sim", "fresh").withColumn("r", F.row_number().over(best)).filter(f"r <= {self.k}").drop("r")
        edges = ahead.unionByName(back).groupBy("v", "w").agg(F.bool_and("fresh").alias("fresh"))
        full = edges.join(self.nodes.select(F.col("node").alias("w"), F.col("vec").alias("way")), "w")
        return self.dealt(full.select("v", "w", "fresh", "way"), "v")

    def dealt(self, rows: DataFrame, by: str) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(self.parts))).repartition(int(self.parts), "bucket")

    def expand(self, frontier: DataFrame, beside: DataFrame, keep: int) -> DataFrame:
        """frontier(node, vec, floor, fresh, v) -> (node, ids, sims): of v's neighbours, the ``keep`` nearest to node above its
        floor. Only fresh neighbours count where v isn't fresh itself: node has met the others before."""

        def visit(front: pa.Table, graph: pa.Table) -> pa.Table:
            f_at = np.lexsort((front["node"].to_numpy(), front["v"].to_numpy()))
            g_at = np.lexsort((graph["w"].to_numpy(), graph["v"].to_numpy()))
            f_v, own, floor, whole = (front[c].to_numpy()[f_at] for c in ("v", "node", "floor", "fresh"))
            g_v, near, fresh = (graph[c].to_numpy()[g_at] for c in ("v", "w", "fresh"))
            x, way = _vectors(front["vec"])[f_at], _vectors(graph["way"])[g_at]
            both = np.intersect1d(f_v, g_v)
            bounds = [np.searchsorted(at, both, side).tolist() for at in (f_v, g_v) for side in ("left", "right")]
            nodes, lengths, ids, sims = [], [], [], []
            for a, b, c, d in zip(*bounds, strict=True):
                s = x[a:b] @ way[c:d].T
                s[(s <= floor[a:b, None]) | (near[c:d] == own[a:b, None]) | ~(whole[a:b, None] | fresh[c:d])] = -np.inf
                rows = np.flatnonzero(s.max(axis=1) > -np.inf)
                if not len(rows):
                    continue
                s = s[rows]
                best = np.argpartition(-s, keep - 1, axis=1)[:, :keep] if d - c > keep else np.broadcast_to(np.arange(d - c), s.shape)
                s = np.take_along_axis(s, best, axis=1)
                there = np.isfinite(s)
                nodes.append(own[a:b][rows])
                lengths.append(there.sum(axis=1))
                ids.append(near[c:d][best[there]])
                sims.append(s[there])
            return pa.Table.from_arrays(_lists(nodes, lengths, ids, sims), ["node", "ids", "sims"])

        return self.dealt(frontier, "v").groupBy("bucket").cogroup(beside.groupBy("bucket")).applyInArrow(visit, f"node long, {LIST}")

    def _round(self) -> DataFrame:
        """A round of NN-descent: every node meets the neighbours of its nearest neighbours and keeps what is nearer. Pairs of an
        old neighbour and its old neighbour have met in a round before."""
        full = self.lists.join(self.nodes, "node")
        floor = F.when(F.size("sims") < self.k, F.lit(float("-inf"))).otherwise(F.array_min("sims")).cast("float")
        way = F.explode(F.slice(F.arrays_zip("ids", "fresh"), 1, max(1, self.k // 2))).alias("x")
        frontier = full.select("node", "vec", floor.alias("floor"), way).select("node", "vec", "floor", F.col("x.fresh").alias("fresh"), F.col("x.ids").alias("v"))
        return self._merged(self.lists, self.expand(frontier, self.adjacency(), 8), self.k)

    def search(self, starts: DataFrame, beam: int, step: int, pool: int) -> DataFrame:
        """starts(node) -> (node, ids): greedy search from each node's own place in the graph.

        Every step visits the nearest ``step`` nodes of the pool not yet visited, until the nearest ``beam`` all are, of every
        search: a step visits new nodes and pools only get nearer, so each search ends."""
        state = starts.join(self.lists, "node").select("node", "ids", "sims", F.array("node").alias("seen"))
        state, path = cut(state.join(self.nodes, "node"))

        def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for t in parts:
                todo = [ids[:beam][~np.isin(ids[:beam], seen)][:step] for ids, seen in zip(t["ids"], t["seen"], strict=True)]
                low = [np.float32(s[pool - 1]) if len(s) >= pool else np.float32(-np.inf) for s in t["sims"]]
                yield pd.DataFrame({"node": t["node"], "vec": t["vec"], "floor": low, "todo": todo})

        while True:
            todo, todo_at = cut(state.mapInPandas(pick, "node long, vec binary, floor float, todo array<long>").filter("size(todo) > 0"))
            if todo.isEmpty():
                break
            found = self.expand(todo.select("node", "vec", "floor", F.lit(True).alias("fresh"), F.explode("todo").alias("v")), self.beside, 32)
            lists = self._merged(state, found, pool)
            seen = state.select("node", "vec", "seen").join(todo.select("node", "todo"), "node", "left")
            seen = seen.select("node", "vec", F.concat("seen", F.coalesce("todo", F.array().cast("array<bigint>"))).alias("seen"))
            new, new_path = cut(lists.join(seen, "node").select("node", "ids", "sims", "seen", "vec"))
            discard(self.spark, path, todo_at)
            state, path = new, new_path
        return state.select("node", "ids")


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, links: int = 40, leaf: int = 256, trees: int = 8, rounds: int = 2, beam: int = 160, step: int = 160, pool: int = 200, seed: int = 42, settled: float = 0.02) -> DataFrame:
    """(query_id, rank, id, score): for each query row its k nearest other rows by inner product, nearest first, ties to the
    smaller id. ``queries`` is a condition on the column ``id``.

    Equal vectors are one node of the graph; of a node's rows only the k + 1 smallest ids can be among anyone's k nearest, so
    those are kept. NN-descent takes ``rounds`` rounds at least and goes on until one replaces ``settled`` of all neighbours or
    less. The graph and the search use single precision; the nearest ``pool`` nodes found are scored anew from the original
    vectors in double precision. Vectors that are null, zero, of another length than most, or hold null
    or non-finite components take no part; repeated ids count once; fewer rows than k give all; an empty table gives an empty
    result; other columns are ignored.
    """
    rows, _ = cut(usable(vectors, id_col, vec_col).withColumns({"h": F.xxhash64("v"), "g": F.hash("v")}))
    salted = Window.partitionBy("h", "g", "salt").orderBy("id")
    ids = rows.select("h", "g", "id").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", F.row_number().over(salted)).filter(f"r <= {k + 1}")
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("h", "g").orderBy("id"))).filter(f"r <= {k + 1}")
    same = ids.groupBy("h", "g").agg(F.min("id").alias("node"), F.array_sort(F.collect_list("id")).alias("members"))
    classes, _ = cut(same.join(rows.select("id", "v"), F.col("id") == F.col("node")).select("h", "g", "node", "members", "v"))
    top = classes.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            # The largest component becomes 2^56: neither products of large ones nor of those 1e35 times smaller leave the range.
            yield pd.DataFrame({"node": t["node"], "vec": [np.ldexp(np.asarray(v, float) / top, 56).astype(np.float32).tobytes() for v in t["v"]]})

    nodes, _ = cut(classes.select("node", "v").mapInPandas(packed, "node long, vec binary"))
    graph = Graph(nodes, links, leaf, trees, rounds, settled, seed)
    asked = rows.filter(queries).select(F.col("id").alias("query_id"), "h", "g")
    asked, _ = cut(asked.join(classes.select("h", "g", "node"), ["h", "g"]).select("query_id", "node"))
    found = graph.search(asked.select("node").distinct(), beam, step, pool)
    pairs = found.select("node", F.explode(F.array_union("ids", F.array("node"))).alias("other"))
    of_node = classes.select("node", F.col("v").alias("a"))
    of_other = classes.select(F.col("node").alias("other"), F.col("v").alias("b"), "members")
    scored = pairs.join(of_node, "node").join(of_other, "other").select("node", dot("a", "b").alias("score"), "members")
    kept = scored.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), F.col("members")[0]))).filter(f"r <= {k + 1}").drop("r")
    kept, _ = cut(kept)
    graph.beside.unpersist()
    out = asked.join(kept, "node").select("query_id", "score", F.explode("members").alias("id")).filter("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
