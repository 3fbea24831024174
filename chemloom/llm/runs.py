"""Periodic runs of words, by branching tandem repeats of an enhanced suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, text_bytes

#: Words whose suffix array is built together, if a text isn't longer; suffixes that are looked at together.
TOGETHER, AT_ONCE = 200_000, 1 << 20
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _block_ranks(s: np.ndarray) -> list[np.ndarray]:
    """Ranks of the blocks of 1, 2, 4, ... symbols at each place, until all differ: equal blocks, and they alone, have equal ranks.

    A rank is the number of suffixes that are smaller by their block, so the last ranks are the inverse suffix array. Only places whose
    block isn't alone are sorted again; each text ends with a symbol of its own, so no such block goes beyond its text."""
    counts = np.bincount(s)
    ranks = [(np.cumsum(counts) - counts)[s].astype(np.int32)]
    left, width = np.flatnonzero(counts[s] > 1), 1
    while len(left):
        r = ranks[-1]
        key = r[left].astype(np.int64) * len(s) + r[left + width]
        order = np.argsort(key)
        left, key = left[order], key[order]
        at = np.arange(len(left))
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        head = r[left]
        bucket = np.concatenate(([True], head[1:] != head[:-1]))
        since = np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(bucket, at, 0))
        r = r.copy()
        r[left] = head + since
        ranks.append(r)
        left = left[~(fresh & np.concatenate((fresh[1:], [True])))]
        width *= 2
    return ranks


def _intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, low, high) for each k with lcp[k] > 0: suffixes low to k-1 and k to high-1 of the array meet at depth lcp[k].

    Children of an interval are joined one after the other, which makes its binary form; the bounds are the nearest smaller
    values, found by halving steps over minima of stretches of 1, 2, 4, ... values. lcp starts and ends with -1."""
    k = np.flatnonzero(lcp > 0)
    v = lcp[k]
    longest = np.diff(np.flatnonzero(lcp <= 0)).max(initial=1)
    least, width = [lcp], 1
    while width < longest:
        t = least[-1]
        least.append(np.minimum(t, np.concatenate((t[width:], np.full(min(width, len(t)), -1, t.dtype)))))
        width *= 2
    low, high = k.copy(), k + 1
    for j in reversed(range(len(least))):
        t, step = least[j], 1 << j
        high += np.where(t[high] >= v, step, 0)
        low -= np.where((low >= step) & (t[np.maximum(low - step, 0)] > v), step, 0)
    return k, low - 1, high


def _squares(lcp: np.ndarray, sa: np.ndarray, isa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, depth) of the branching tandem repeats: w[i : i+d] = w[i+d : i+2d], and what follows each differs.

    The suffixes i and i+d then part at depth d, so one of them is on the smaller side of the interval that holds both. Only the
    smaller sides are gone through, n log n suffixes in all, and the partner is looked up by its rank."""
    k, low, high = _intervals(lcp)
    left = k - low <= high - k
    size = np.where(left, k - low, high - k)
    first = np.where(left, low, k)
    across = np.where(left, k, low), np.where(left, high, k)
    ends = np.cumsum(size)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    at = 0
    while at < len(k):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        node = np.repeat(np.arange(at, to), size[at:to])
        inside = np.arange(len(node)) - (ends[node] - size[node] - (ends[at - 1] if at else 0))
        i, d = sa[first[node] + inside].astype(np.int64), lcp[k[node]].astype(np.int64)
        for j, start in ((i + d, i), (i - d, i - d)):
            ok = j >= 0
            there = isa[np.where(ok, j, 0)]
            ok &= (there >= across[0][node]) & (there < across[1][node])
            found.append((start[ok], d[ok]))
        at = to
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def find_runs(s: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows (start, length, period) of the maximal runs of at least ``least`` symbols and two periods, by start and period.

    s are symbols from 0, all texts one after the other: texts share no symbol, and each ends with one that occurs once."""
    none = np.empty((0, 3), np.int64)
    if not len(s):
        return none
    ranks = _block_ranks(s)
    isa = ranks[-1]
    sa = np.empty(len(s), np.int32)
    sa[isa] = np.arange(len(s), dtype=np.int32)
    a, b, depth = sa[:-1], sa[1:], np.zeros(len(s) - 1, np.int32)
    for j in reversed(range(len(ranks))):
        depth += (ranks[j][a + depth] == ranks[j][b + depth]).astype(np.int32) << j
    lcp = np.concatenate((np.array([-1], np.int32), depth, np.array([-1], np.int32)))
    last, period = _squares(lcp, sa, isa)
    if not len(last):
        return none
    # A branching repeat is the last square of its run; the run starts where rotating it to the left ends.
    start = last.copy()
    for j in reversed(range(len(ranks))):
        back = start - (1 << j)
        at = np.maximum(back, 0)
        start = np.where((back >= 0) & (ranks[j][at] == ranks[j][at + period]), back, start)
    length = last + 2 * period - start
    keep = length >= least
    start, length, period = start[keep], length[keep], period[keep]
    order = np.lexsort((period, length, start))  # a period's multiples have the same stretch
    start, length, period = start[order], length[order], period[order]
    new = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1]))) if len(start) else np.empty(0, bool)
    out = np.stack([start[new], length[new], period[new]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs_of_texts(texts: list[list[bytes]], least: int = 12) -> list[np.ndarray]:
    """find_runs() of each text's words. Texts in which no ``least / 2`` consecutive words come twice hold no run: the first period
    of a run of length m and period q is followed by m - q >= least / 2 words that come again. They are left out before suffixes are sorted."""
    gram, base, parts = least // 2, 0, []
    for words in texts:
        known: dict[bytes, int] = {}
        number = known.setdefault
        parts.append(np.fromiter((number(w, len(known)) for w in words), np.int64, len(words)))
        parts[-1] = np.append(parts[-1], len(known)) + base
        base += len(known) + 1
    out = [np.empty((0, 3), np.int64)] * len(texts)
    s = np.concatenate(parts) if parts else np.empty(0, np.int64)
    if len(s) < gram:
        return out
    ends = np.cumsum([len(p) for p in parts])
    h = np.zeros(len(s) - gram + 1, np.uint64)
    for j in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + s[j : len(s) - gram + 1 + j].astype(np.uint64)
    order = np.argsort(h)
    again = order[1:][h[order[1:]] == h[order[:-1]]]
    alive = np.unique(np.searchsorted(ends, again, "right"))
    if not len(alive):
        return out
    _, t = np.unique(np.concatenate([parts[d] for d in alive]), return_inverse=True)
    found = find_runs(t, least)
    begins = np.concatenate(([0], np.cumsum([len(parts[d]) for d in alive])))
    of = np.searchsorted(begins, found[:, 0], "right") - 1
    for x in np.unique(of):
        out[alive[x]] = found[of == x] - np.array([begins[x], 0, 0])
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run contains after its first period, joined by blanks."""
    if not len(runs):
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """(id, n_words long, runs array<struct<start, length, period>>, collapsed string) of every row: the maximal periodic runs of its
    words, by start and period, and the text without what repeats in them.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Repeated rows each come back; ids may be null; an
    empty table gives an empty result; other columns are ignored. Whole texts, no shuffle: a task holds the words of about 200,000
    words of texts, or of one longer text, and some 40 bytes a word and doubling for those with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[list[bytes]] = []
            done = total = 0
            for i, t in enumerate(each_text(batch)):
                texts.append(t.split())
                total += len(texts[-1])
                if total >= TOGETHER or i + 1 == batch.num_rows:
                    found = runs_of_texts(texts, least)
                    lists = [[{"start": a, "length": n, "period": p} for a, n, p in r.tolist()] for r in found]
                    kept = [collapse(w, r) for w, r in zip(texts, found, strict=True)]
                    ids = batch.column("id").slice(done, len(texts))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([len(w) for w in texts], pa.int64()), pa.array(lists, RUNS), pa.array(kept, pa.binary())], names=["id", "n_words", "runs", "collapsed"])
                    done, total, texts = i + 1, 0, []

    kind = dict(docs.dtypes)[id_col]
    found = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t")).mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
