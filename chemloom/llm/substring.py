"""Substring dedup over prefix-partitioned suffix trees: word windows that occur more than once, wherever, are removed.

A suffix is a place in a text, read as far as the window reaches. Its symbols are hashes of eight words each. Suffixes are
dealt by their first symbol; prefixes that too many suffixes share are lengthened, symbol by symbol, until each fits into the
memory of a task. A task sorts its suffixes into the trees of its prefixes; nodes as deep as the window with two leaves or
more are repeats. Neighbouring repeats of a text, joined, are its maximal repeats.

Only suffixes that can recur are dealt out: a window's anchor is the run of ``grain`` words of least hash in it; equal windows
have equal anchors, so one whose anchor occurs once is no repeat. Neighbours with one anchor travel as one run of words, equal
runs of several texts once, with their number."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, each_text, equal_text_key, join_unique, per_batch, text_bytes

KEYS = ["key_a", "key_b", "key_n"]
SPAN = "array<struct<from:int,to:int>>"


class WordHashes(dict):
    """Word -> 64-bit hash, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def gram_hashes(words: list[bytes], hashes: WordHashes, size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` words."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    g = np.zeros(n, np.uint64)
    for j in range(size):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    return g ^ (g >> np.uint64(29))


def anchors(words: list[bytes], hashes: WordHashes, window: int, grain: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of the words: its anchor's place; and the hashes of all runs of ``grain`` words."""
    g = gram_hashes(words, hashes, grain)
    wide = np.lib.stride_tricks.sliding_window_view(g, window - grain + 1)
    return wide.argmin(axis=1) + np.arange(len(wide)), g


def symbol_places(window: int, grain: int) -> list[int]:
    """Where a suffix's symbols begin: every ``grain`` words, the last one ending with the window."""
    places = list(range(0, window - grain + 1, grain))
    return places if places[-1] == window - grain else [*places, window - grain]


def deep_nodes(symbols: np.ndarray) -> np.ndarray:
    """symbols(suffixes, depth) -> for each suffix the node of full depth that it hangs from.

    Sorted suffixes are the leaves of the tree from left to right; how many symbols neighbours share is the depth of the node
    at which they part. Leaves that part nowhere above full depth have one such node."""
    order = np.lexsort(symbols.T[::-1])
    ranked = symbols[order]
    shared = np.cumprod(ranked[1:] == ranked[:-1], axis=1).sum(axis=1)
    node = np.empty(len(symbols), np.int64)
    node[order] = np.concatenate(([0], np.cumsum(shared < symbols.shape[1])))[: len(symbols)]
    return node


def repeated(different: DataFrame, window: int, grain: int, most: int, group_rows: int) -> DataFrame:
    """different(mark, same, n, words), the runs that differ and how often each occurs -> (mark, same, starts): of the runs
    that occur once, the places where a window starts that occurs in another run or at another place too."""
    spark, places = different.sparkSession, symbol_places(window, grain)
    names = [f"s{i}" for i in range(len(places))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            marks, sames, ns = (batch.column(c).to_numpy() for c in ("mark", "same", "n"))
            for begin in range(0, batch.num_rows, 2000):
                sizes, grams = [], []
                for words in batch.column("words").slice(begin, 2000).to_pylist():
                    grams.append(gram_hashes(words.split(), hashes, grain))
                    sizes.append(len(grams[-1]) - places[-1])
                rows = np.repeat(np.arange(begin, begin + len(sizes)), sizes)
                cols = [pa.array(np.concatenate([g[p : p + n] for g, n in zip(grams, sizes, strict=True)]).view(np.int64)) for p in places]
                start = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                yield pa.RecordBatch.from_arrays([pa.array(marks[rows]), pa.array(sames[rows]), pa.array(start), pa.array(ns[rows]), *cols], names=["mark", "same", "start", "n", *names])

    suffixes = different.mapInArrow(run, "mark long, same long, start int, n long, " + ", ".join(f"{c} long" for c in names))
    total = different.agg(F.coalesce(F.sum(F.col("size") - window + 1), F.lit(0))).first()[0]
    longer, lengths = suffixes, F.lit(1)
    dealt = suffixes
    for depth in range(1, len(names) + 1):
        own = names[:depth]
        full, at = cut(longer.groupBy(*own).agg(F.count("*").alias("often")).filter(F.col("often") > most))
        number = full.count()
        if not number:
            break
        if number <= 100_000:  # its size is known now
            dealt = dealt.join(F.broadcast(full.select(*own, F.lit(True).alias(f"over{depth}"))), own, "left")
            longer = suffixes.join(F.broadcast(full.select(*own)), own, "left_semi")
        else:
            longer = join_unique(suffixes, full, own, "often", total, "left_semi")
            some = join_unique(dealt, full.withColumn(f"over{depth}", F.lit(True)), own, "often", total)
            dealt = some.unionByName(dealt.join(full.select(*own), own, "left_anti").withColumn(f"over{depth}", F.lit(None).cast("boolean")))
        lengths = F.when(F.col(f"over{depth}"), depth + 1).otherwise(lengths)
    prefix = F.xxhash64(*[F.when(F.col("symbols") > i, F.col(c)) for i, c in enumerate(names)])
    dealt = dealt.withColumn("symbols", lengths).withColumn("group", F.pmod(prefix, F.lit(int(total // group_rows) + 1)))

    def tree(t: pd.DataFrame) -> pd.DataFrame:
        node = deep_nodes(t[names].to_numpy(np.int64))
        often = np.bincount(node, weights=t["n"].to_numpy())[node] >= 2
        return t.loc[often & (t["n"].to_numpy() == 1), ["mark", "same", "start"]]

    hits = dealt.filter(F.col("symbols") <= len(names)).groupBy("group").applyInPandas(tree, "mark long, same long, start int")
    # A prefix as long as the window is a node: more suffixes than fit a group hang from it, all of them repeats.
    hits = hits.unionByName(dealt.filter((F.col("symbols") > len(names)) & (F.col("n") == 1)).select("mark", "same", "start"))
    return hits.groupBy("mark", "same").agg(F.collect_list("start").alias("starts"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, grain: int = 8, most: int = 100_000, group_rows: int = 250_000) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, removed) of every row: words covered by a window that also starts anywhere else
    are removed. ``removed`` has their ranges, the maximal repeats.

    Words are runs of bytes other than blanks and tabs to carriage returns, unchanged. Windows are judged on the input, in the
    same row too. kept_sha256 is of the kept words joined by one blank. Null texts have no words; texts shorter than the window
    keep all; a text that occurs in several rows, repeated rows included, loses every word if it has a window at all; ids may be
    null; an empty table gives an empty result; other columns are ignored. Equal texts take part once, as one class, and runs
    that are equal are compared once, so a large group of copies is one row of each step.

    ``most`` is the number of suffixes beyond which a prefix is lengthened, ``group_rows`` about that of a task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), *equal_text_key(text_col), text_bytes(text_col).alias("t"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n_words, digests, marks, places = [], [], [], []
            for text in each_text(batch):
                words = text.split()
                n_words.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if len(words) < window:
                    marks.append([])
                    places.append([])
                    continue
                at, g = anchors(words, hashes, window, grain)
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
                marks.append(g[at].view(np.int64))
                places.append(at.astype(np.int32))
            kept = [batch.column(c) for c in ("id", *KEYS)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words, pa.int64()), pa.array(digests, pa.string()), pa.array(marks, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], names=["id", *KEYS, "n_words", "kept_sha256", "marks", "places"])

    kind = dict(rows.dtypes)["id"]
    seen, seen_at = cut(rows.mapInArrow(look, f"id {kind}, key_a long, key_b long, key_n long, n_words long, kept_sha256 string, marks array<long>, places array<int>"))
    classes, classes_at = cut(seen.filter(f"n_words >= {window}").groupBy(*KEYS).agg(F.count("*").alias("copies"), F.min("id").alias("first_id"), F.first(F.struct("marks", "places")).alias("m")))
    occurs = classes.select(*KEYS, F.explode(F.arrays_zip("m.marks", "m.places")).alias("o")).select(*KEYS, F.col("o.marks").alias("mark"), F.col("o.places").alias("place"))
    twice = occurs.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1")
    number = classes.agg(F.coalesce(F.sum(F.size("m.marks")), F.lit(0))).first()[0]
    wanted = join_unique(occurs, twice, ["mark"], "n", number, "left_semi").groupBy(*KEYS).agg(F.collect_list("place").alias("places"))
    wanted = wanted.join(classes.select(*KEYS, "first_id"), KEYS)
    # One row of each class: the id is a part of the key, so that a large class of copies isn't gathered.
    same = " and ".join(f"r.{k} = w.{k}" for k in KEYS)
    texts, texts_at = cut(rows.alias("r").join(wanted.alias("w"), F.expr(f"{same} and r.id <=> w.first_id")).select(*[f"r.{k}" for k in KEYS], "t", "places"))

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of windows with one anchor; the words of a run only where the task hasn't met an equal one lately."""
        hashes, names = WordHashes(), ["mark", *KEYS, "start", "same", "size", "words"]
        kinds = [*[pa.int64()] * 4, pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        out, held, met = [[] for _ in names], 0, set()
        for batch in batches:
            for *key, text, places in zip(*(batch.column(c).to_pylist() for c in (*KEYS, "t", "places")), strict=True):
                words = text.split()
                at, g = anchors(words, hashes, window, grain)
                first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                last = np.append(first[1:], len(at)) - 1
                wanted = np.isin(at[first], np.array(places))
                for s, e, a in zip(first[wanted].tolist(), last[wanted].tolist(), at[first[wanted]].tolist(), strict=True):
                    run = b" ".join(words[s : e + window])
                    same = xxhash.xxh3_64_intdigest(run)
                    new = same not in met
                    met.add(same)
                    for column, x in zip(out, (int(g[a].view(np.int64)), *key, s, same - (1 << 64) if same >> 63 else same, e - s + window, run if new else None), strict=True):
                        column.append(x)
                    held += len(run) if new else 64
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
                    out, held = [[] for _ in names], 0
                    if len(met) > 500_000:
                        met.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    runs, runs_at = cut(texts.mapInArrow(runs_of, "mark long, key_a long, key_b long, key_n long, start int, same long, size int, words binary"))
    different, different_at = cut(runs.groupBy("mark", "same").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("words", ignorenulls=True).alias("words")))
    found, found_at = cut(repeated(different, window, grain, most, group_rows))
    # What occurs several times as a whole is a repeat as a whole.
    every = F.sequence(F.lit(0), F.col("size") - window)
    found = different.join(found, ["mark", "same"], "left").select("mark", "same", "n", F.when(F.col("n") > 1, every).otherwise(F.col("starts")).alias("starts")).filter("starts is not null")
    runs_in_all = runs.count()
    hits = join_unique(runs.select(*KEYS, "mark", "same", "start"), found, ["mark", "same"], "n", runs_in_all).select(*KEYS, F.transform("starts", lambda x: x + F.col("start")).alias("starts"))
    hits = hits.groupBy(*KEYS).agg(F.flatten(F.collect_list("starts")).alias("starts"))

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_removed, digests, removed = [], [], []
        for text, starts in zip(each_text(batch), batch.column("starts").to_pylist(), strict=True):
            words = text.split()
            edge = np.zeros(len(words) + 1, np.int32)
            np.add.at(edge, np.array(starts), 1)
            np.add.at(edge, np.array(starts) + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            n_removed.append(int(gone.sum()))
            digests.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(~gone)])).hexdigest())
            ends = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).reshape(-1, 2)
            removed.append([{"from": a, "to": b} for a, b in ends.tolist()])
        span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEYS), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(removed, span)], names=[*KEYS, "n_removed", "digest", "removed"])

    cleaned = per_batch(texts.select(*KEYS, "t").join(hits, KEYS), clean, f"key_a long, key_b long, key_n long, n_removed long, digest string, removed {SPAN}")
    cleaned = classes.select(*KEYS, "copies").join(cleaned.dropDuplicates(KEYS), KEYS, "left").filter("copies > 1 or n_removed is not null")
    cleaned, _ = cut(cleaned)
    own, _ = cut(seen.drop("marks", "places"))
    discard(spark, classes_at, texts_at, runs_at, different_at, found_at, seen_at)
    both = join_unique(own, cleaned.withColumn("often", F.col("copies")), KEYS, "often", own.count(), "left")
    copied, none = F.coalesce(F.col("copies"), F.lit(0)) > 1, F.array().cast(SPAN)
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("n_words").cast("int").alias("to")))
    return both.select("id", "n_words", F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("digest", "kept_sha256")).alias("kept_sha256"), F.when(copied, whole).otherwise(F.coalesce("removed", none)).alias("removed"))


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the kept words, joined by one blank, as text; rows of which nothing was removed keep their text as it is.

    Rows that agree in id and text have one result; nulls, empties and other columns stay as they are."""
    found = dedup(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("same")).select(F.struct("id", "same").alias("doc_id"), "text"), **options)
    found = found.filter("n_removed > 0").select("id.id", "id.same", "removed").dropDuplicates(["id", "same"])
    names, kinds = docs.columns, [t for _, t in docs.dtypes]
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("same"))
    both = rows.alias("d").join(found.alias("f"), F.expr("d.id <=> f.id and d.same = f.same"), "left").select("row", "removed")
    ready = both.select(*[F.col("row").getField(n).alias(f"c{i}") for i, n in enumerate(names)], "removed")
    at = names.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, spans in zip(batch.column(at).to_pylist(), batch.column("removed").to_pylist(), strict=True):
            if spans:
                w = text.encode().split()
                for x in reversed(spans):
                    del w[x["from"] : x["to"]]
                text = b" ".join(w).decode()
            texts.append(text)
        cols = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
        return pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(names))])

    return per_batch(ready, work, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))).toDF(*names)
