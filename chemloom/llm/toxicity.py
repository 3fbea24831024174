"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, votes weighted by nearness."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, cut, each_text, text_bytes

Vector = tuple[np.ndarray, np.ndarray]


def words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, A-Z in lower case."""
    return text.translate(ALNUM).split()


class Numbers(dict):
    """Term -> number, -1 for other words."""

    def __missing__(self, word: bytes) -> int:
        return -1


def vector(text: bytes, number: Numbers, weight: np.ndarray) -> Vector:
    """Terms in order, and the unit vector of (1 + log tf) times the terms' weights; empty for a text without known words."""
    own = words(text)
    t, n = np.unique(np.fromiter(map(number.__getitem__, own), np.int64, len(own)), return_counts=True)
    if len(t) and t[0] < 0:
        t, n = t[1:], n[1:]
    w = (1 + np.log(n)) * weight[t]
    return t, w / max(1e-12, np.sqrt((w**2).sum()))


def gains(pos: np.ndarray, neg: np.ndarray, positives: int, negatives: int, least: float = 0.02, full: float = 20.0) -> np.ndarray:
    """How much a term counts beside its idf, from ``least`` to 1: by the divergence of its examples' labels from all examples'.

    The divergence is n times the relative entropy of the term's smoothed label share, less what the most extreme of so many
    terms reaches by chance; ``full`` of it give 1. No term is left out."""
    base = (positives + 0.5) / (positives + negatives + 1)
    n = pos + neg
    p = (pos + 2 * base) / (n + 2)
    g = n * (p * np.log(p / base) + (1 - p) * np.log((1 - p) / (1 - base)))
    return np.maximum(least, np.minimum(1.0, (g - np.log(max(1, len(n))) / 2) / full))


class BlockMaxIndex:
    """Posting lists of the examples, ordered by label and heaviest term so that a block's examples are alike.

    For each term, the largest weight in each block of ``size`` examples bounds what the block's examples can gain from it.
    The blocks of highest bound are read first; of the rest only those whose bound reaches the k-th best cosine found so far
    are read: the k nearest are exact. Lists of over 1/``wide`` of the examples are kept as rows of a matrix; what a text
    gains from them is summed for all examples at once, and its maximum in each block is part of the bound."""

    def __init__(self, vectors: list[Vector], labels: np.ndarray, keys: np.ndarray, terms: int, size: int = 256, wide: int = 8):
        order = sorted((i for i, (t, _) in enumerate(vectors) if len(t)), key=lambda i: (labels[i], int(vectors[i][0][np.argmax(vectors[i][1])]), i))
        self.labels, self.keys, self.size, self.blocks = labels[order], keys[order], size, -(-len(order) // size)
        place = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        term = np.concatenate([np.empty(0, np.int64), *[vectors[i][0] for i in order]])
        weight = np.concatenate([np.empty(0), *[vectors[i][1] for i in order]])
        often = np.bincount(term, minlength=terms) * wide > max(len(order), size)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((int(often.sum()), self.blocks * size))
        far = often[term]
        self.dense[self.row[term[far]], place[far]] = weight[far]
        place, term, weight = place[~far], term[~far], weight[~far]
        by_term = np.lexsort((place, term))
        self.place, self.weight, term = place[by_term].astype(np.int32), weight[by_term], term[by_term]
        cell = term * self.blocks + self.place // size
        # The first posting of each term in each block, and the bounds, rounded up.
        self.begin = np.zeros(terms * self.blocks + 1, np.int32)
        np.cumsum(np.bincount(cell, minlength=terms * self.blocks), out=self.begin[1:])
        self.bound = np.zeros(terms * self.blocks, np.float32)
        np.maximum.at(self.bound, cell, np.nextafter(self.weight.astype(np.float32), np.float32(2)))
        self.bound = self.bound.reshape(terms, self.blocks)

    def _cosines(self, t: np.ndarray, w: np.ndarray, base: np.ndarray, blocks: np.ndarray) -> Vector:
        """Places of the blocks' examples with a cosine over 0, and the cosines; others don't count."""
        if 2 * len(blocks) > self.blocks:  # lists are read whole: that is less work than to skip parts
            start, end, each = self.begin[t * self.blocks], self.begin[(t + 1) * self.blocks], w
        else:
            cells = (t[:, None] * self.blocks + blocks[None, :]).ravel()
            start, end, each = self.begin[cells], self.begin[cells + 1], np.repeat(w, len(blocks))
        n = end - start
        at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
        cos = np.bincount(self.place[at], weights=self.weight[at] * np.repeat(each, n), minlength=len(base))
        place = (blocks[:, None] * self.size + np.arange(self.size)).ravel()
        cos = cos[place] + base[place]
        own = cos > 1e-12
        return place[own], cos[own]

    def nearest(self, texts: list[Vector], k: int, skip: list[int] | None = None, first: int = 4, together: int = 64) -> Iterator[Vector]:
        """For each text: places and cosines of its k nearest with a cosine over 0, ties to the smaller key. ``skip`` names a
        key for each text whose examples are left out."""
        for at in range(0, len(texts), together):
            some = texts[at : at + together]
            q = np.zeros((len(some), len(self.dense)))
            for i, (t, w) in enumerate(some):
                r = self.row[t]
                q[i, r[r >= 0]] = w[r >= 0]
            base = q @ self.dense
            peak = base.reshape(len(some), self.blocks, self.size).max(axis=2) if self.blocks else base
            for i, (t, w) in enumerate(some):
                listed = self.row[t] < 0
                yield self._one(t[listed], w[listed], base[i], peak[i], k, first, None if skip is None else skip[at + i])

    def _one(self, t: np.ndarray, w: np.ndarray, base: np.ndarray, peak: np.ndarray, k: int, first: int, skip: int | None) -> Vector:
        best = np.empty(0, np.int64), np.empty(0)
        if not self.blocks:
            return best
        upper = peak + w @ self.bound[t]
        order = np.argsort(-upper, kind="stable")
        order = order[upper[order] > 0]
        while len(order):
            got = self._cosines(t, w, base, order[:first])
            if skip is not None:
                own = self.keys[got[0]] != skip
                got = got[0][own], got[1][own]
            place, cos = np.concatenate([best[0], got[0]]), np.concatenate([best[1], got[1]])
            if len(cos) > 4 * k:
                near = np.flatnonzero(cos >= np.partition(cos, len(cos) - k)[len(cos) - k])
                place, cos = place[near], cos[near]
            top = np.lexsort((self.keys[place], -cos))[:k]
            best = place[top], cos[top]
            order = order[first:]
            if len(best[1]) >= k:
                order = order[upper[order] >= best[1][k - 1] - 1e-9]
            first = len(order)  # what can still hold a near one is read at once
        return best


def vote(labels: np.ndarray, cosines: np.ndarray) -> float:
    """Share of the label-1 examples among the nearest, weighted by 1 / (distance + 0.1); 0 without any."""
    if not len(cosines):
        return 0.0
    weight = 1 / (1.1 - np.minimum(cosines, 1.0))
    return float((weight * labels).sum() / weight.sum())


def platt(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Coefficients of a logistic curve over the columns of x, the last one its level, with a slight pull to 0; a class that is
    missing gives a constant."""
    if not len(x) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return np.array([0.0] * x.shape[1] + [np.log(p / (1 - p))])
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w)), a.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -3, 3)
    return w


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_fold: int = 0, max_examples: int = 4000, k: int = 15, whole_rows: bool = False) -> DataFrame:
    """(id, held_out, score, predicted, evidence) of every row of docs; with ``whole_rows`` also ``row``, the row itself.

    Examples are labelled rows whose crc32(id as text) mod ``folds`` is not ``held_fold``: at most ``max_examples`` of them,
    those of least hash; nothing else is bounded. Every word of an example is a term. Its weight is its inverse document
    frequency over all docs times its gain, see gains(). A text's score is the vote of its k nearest examples by cosine,
    calibrated by a logistic curve that is fitted to the examples with themselves and equal texts left out.

    Null texts and texts without any of the terms have no neighbours: their vote is 0 and their score what that meant among
    the examples. Rows without labels, conflicting labels (the larger counts), null ids (held out), ids of any type, ties
    (smaller text hash first), repeated rows, extra columns and empty tables are allowed; without labels every score is 0.5.
    """
    spark = docs.sparkSession
    fold = lambda c: F.pmod(F.coalesce(F.crc32(c.cast("string")), F.lit(0)), F.lit(folds))
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t"))
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).filter(fold(F.col(id_col)) != held_fold)
    marked = marked.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_examples)
    marked, _ = cut(marked)  # bounded by max_examples
    examples, _ = cut(rows.join(F.broadcast(marked), "id").select("id", F.when(F.col("y") != 0, 1).otherwise(0).alias("y"), "t", F.xxhash64("t").alias("same")).dropDuplicates(["same", "y"]))

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list[int]] = {}
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), each_text(batch), strict=True):
                for w in set(words(text)):
                    found.setdefault(w, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), *(pa.array([x[y] for x in found.values()], pa.int64()) for y in (0, 1))], names=["term", "neg", "pos"])

    terms = examples.select("y", "t").mapInArrow(presence, "term binary, neg long, pos long").groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toArrow().sort_by("term")  # the words of max_examples texts
    pos, neg = terms.column("pos").to_numpy().astype(float), terms.column("neg").to_numpy().astype(float)
    sent = spark.sparkContext.broadcast(Numbers((t, i) for i, t in enumerate(terms.column("term").to_pylist())))
    del terms

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that hold each term, and all documents under the number -1."""
        number = sent.value
        total, rows = np.zeros(len(number), np.int64), 0
        for batch in batches:
            for text in each_text(batch):
                own = set(words(text))
                own = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
                total[own[own >= 0]] += 1
                rows += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], rows))], names=["term", "df"])

    df = rows.select("t").mapInArrow(frequency, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    term, n = df.column("term").to_numpy(), df.column("df").to_numpy()
    every, often = int(n[term < 0].sum()), np.zeros(len(pos))
    often[term[term >= 0]] = n[term >= 0]
    ys = {r["y"]: r["n"] for r in examples.groupBy("y").agg(F.count("*").alias("n")).collect()}
    weight = (np.log((1 + every) / (1 + often)) + 0.1) * gains(pos, neg, ys.get(1, 0), ys.get(0, 0))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            got = [vector(bytes(x), sent.value, weight) for x in t["t"]]
            yield pd.DataFrame({"id": t["id"], "y": t["y"], "same": t["same"], "terms": [g[0] for g in got], "weights": [g[1] for g in got]})

    kind = dict(rows.dtypes)["id"]
    held = examples.mapInPandas(vectors, f"id {kind}, y int, same long, terms array<long>, weights array<double>").toArrow().sort_by([("same", "ascending"), ("y", "ascending")])  # bounded by max_examples
    vecs = [(np.asarray(t.values), np.asarray(w.values)) for t, w in zip(held.column("terms"), held.column("weights"), strict=True)]
    same = held.column("same").to_numpy()
    index = BlockMaxIndex(vecs, held.column("y").to_numpy().astype(int), same, len(pos))
    model = spark.sparkContext.broadcast((index, weight, dict(zip(same.tolist(), held.column("id").to_pylist(), strict=True))))
    del held, vecs

    def left_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, weight, _ = model.value
        for t in batches:
            near = index.nearest([vector(bytes(x), sent.value, weight) for x in t["t"]], k, t["same"].tolist())
            yield pd.DataFrame({"vote": [vote(index.labels[p], c) for p, c in near], "y": t["y"]})

    fitted = examples.mapInPandas(left_out, "vote double, y int").groupBy("vote", "y").agg(F.count("*").alias("n")).toArrow().sort_by([("vote", "ascending"), ("y", "ascending")])  # bounded by max_examples
    votes, ys, n = (fitted.column(c).to_numpy() for c in ("vote", "y", "n"))
    curve = platt(np.repeat(votes[:, None], n, axis=0), np.repeat(ys.astype(float), n))
    field = text_col if whole_rows else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight, names = model.value
        for batch in batches:
            scores, evidence = [], []
            for p, c in index.nearest([vector(x, sent.value, weight) for x in each_text(batch, field)], k):
                scores.append(float(1 / (1 + np.exp(-np.clip(vote(index.labels[p], c) * curve[0] + curve[1], -30, 30)))))
                evidence.append([{"example": names[int(index.keys[i])], "toxic": int(index.labels[i]), "cosine": float(x)} for i, x in zip(p[:3], c[:3], strict=True)])
            shape = pa.list_(pa.struct([("example", batch.schema.field("id").type), ("toxic", pa.int32()), ("cosine", pa.float64())]))
            kept = [n for n in batch.schema.names if n != "t"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(scores, pa.float64()), pa.array(evidence, shape)], names=[*kept, "score", "evidence"])

    asked = docs.select(F.col(id_col).alias("id"), F.struct("*").alias("row") if whole_rows else text_bytes(text_col).alias("t"))
    scored = asked.mapInArrow(work, ", ".join(f"{n} {t}" for n, t in asked.dtypes if n != "t") + f", score double, evidence array<struct<example:{kind},toxic:int,cosine:double>>")
    return scored.select(*[n for n in asked.columns if n != "t"], (fold(F.col("id")) == held_fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that aren't predicted toxic, as they are, repeated ones too; null and empty texts as score() has them."""
    return score(docs, labels, whole_rows=True, **options).filter("predicted = 0").select("row.*")
