"""Benchmark decontamination: Wu-Manber search for the word windows of benchmark items in whole documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, cut, each_text, per_batch, text_bytes

#: Words as item_words() has them, for counting them in the JVM.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
Row = tuple[str, bytes]


def item_words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


class WordNumbers(dict):
    """Word of a benchmark item -> its number; 0 for all other words."""

    def __missing__(self, word: bytes) -> int:
        return 0


def _codes(numbers: np.ndarray, block: int) -> np.ndarray:
    """64-bit codes of all runs of ``block`` numbers along the last axis."""
    n = numbers.shape[-1] - block + 1
    out = np.zeros((*numbers.shape[:-1], n), np.uint64)
    for j in range(block):
        out = (out + numbers[..., j : j + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


class WuManber:
    """Patterns of word numbers, all of one length: patterns(n, length), and for each the items that own it.

    The shift table is an array by the hashed code of the last block of words; it says how far the search may jump, the least
    of what codes with one hash allow. A zero leads to the bucket of patterns that end in this block, compared one by one."""

    def __init__(self, patterns: np.ndarray, owners: list[np.ndarray], block: int = 3):
        self.patterns, self.owners, self.length = patterns, owners, patterns.shape[1]
        self.block = b = min(block, self.length)
        codes = _codes(patterns, b)
        self.mask = np.uint64((1 << max(8, int(4 * codes.size).bit_length())) - 1)
        self.shift = np.full(int(self.mask) + 1, self.length - b + 1, np.int16)
        for at in range(codes.shape[1]):
            np.minimum.at(self.shift, (codes[:, at] & self.mask).astype(np.int64), self.length - b - at)
        self.order = np.argsort(codes[:, -1], kind="stable")
        self.ends = codes[self.order, -1]

    def find(self, numbers: np.ndarray, hit: np.ndarray, items: set[int]) -> None:
        """Marks the words inside occurrences and adds the items that own them."""
        n, m, b = len(numbers), self.length, self.block
        if n < m:
            return
        codes = _codes(numbers, b)
        shift, end = self.shift[(codes & self.mask).astype(np.int64)].tolist(), m
        while end <= n:
            jump = shift[end - b]
            if jump:
                end += jump
                continue
            code = codes[end - b]
            lo, hi = np.searchsorted(self.ends, code), np.searchsorted(self.ends, code, side="right")
            for j in self.order[lo:hi]:
                if (self.patterns[j] == numbers[end - m : end]).all():
                    hit[end - m : end] = True
                    items.update(self.owners[j].tolist())
            end += 1


def build(rows: list[Row], window: int = 13) -> tuple[list[str], WordNumbers, list[WuManber]]:
    """(item_id, text) -> item ids, word numbers, and one search for each pattern length: the window, and the lengths of
    shorter items. Patterns are rows of 32-bit numbers."""
    number, by_size = WordNumbers(), {}
    for item, (_, text) in enumerate(rows):
        words = item_words(text)
        own = np.array([number.setdefault(w, len(number) + 1) for w in words], np.int32)
        size = min(window, len(words))
        if size:
            wide = np.lib.stride_tricks.sliding_window_view(own, size)
            by_size.setdefault(size, []).append((wide, np.full(len(wide), item)))
    out = []
    for _, found in sorted(by_size.items()):
        patterns, which = np.unique(np.concatenate([x for x, _ in found]), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.concatenate([x for _, x in found])]), axis=1)
        out.append(WuManber(patterns, np.split(pairs[1], np.flatnonzero(np.diff(pairs[0])) + 1)))
    return [name for name, _ in rows], number, out


class Search:
    """The searches of a broadcast slice of the benchmark. A worker builds them once: they stay with its copy of the broadcast, which its
    tasks share, and go with it."""

    def __init__(self, sent, window: int):
        self.sent, self.window = sent, window

    def __call__(self, text: bytes) -> tuple[np.ndarray, list[str]]:
        """Whether each word of the text is hit, and the items that occur."""
        built = getattr(self.sent, "searches", None)
        if built is None:
            built = self.sent.searches = build(self.sent.value, self.window)
        names, number, searches = built
        words = item_words(text)
        numbers, hit, items = np.fromiter(map(number.__getitem__, words), np.int32, len(words)), np.zeros(len(words), bool), set()
        for s in searches:
            s.find(numbers, hit, items)
        return hit, sorted({names[i] for i in items})


def scan(docs: DataFrame, rows: list[Row], id_col: str, text_col: str, window: int, whole_rows: bool) -> DataFrame:
    """One pass over the documents with the patterns of the given items: (id, n_words, n_hit, items), maybe with the row."""
    search, field = Search(docs.sparkSession.sparkContext.broadcast(rows), window), text_col if whole_rows else None

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [search(text) for text in each_text(batch, field)]
        kept = [n for n in batch.schema.names if n != "t"]
        cols = [pa.array([len(h) for h, _ in found], pa.int64()), pa.array([int(h.sum()) for h, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *cols], names=[*kept, "n_words", "n_hit", "items"])

    asked = docs.select(F.col(id_col).alias("id"), F.struct("*").alias("row") if whole_rows else text_bytes(text_col).alias("t"))
    return per_batch(asked, work, ", ".join(f"{n} {t}" for n, t in asked.dtypes if n != "t") + ", n_words long, n_hit long, items array<string>")


def scan_hits(docs: DataFrame, rows: list[Row], window: int) -> DataFrame:
    """docs(id, same, t) -> (id, same, places, items) of the rows with a hit: what one slice of the benchmark finds, to be added
    to what others find. The slice is dropped from driver and executors when the result is written."""
    sent = docs.sparkSession.sparkContext.broadcast(rows)
    search = Search(sent, window)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [search(text) for text in each_text(batch)]
        cols = [pa.array([np.flatnonzero(h).tolist() for h, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("same"), *cols], names=["id", "same", "places", "items"])

    out, _ = cut(per_batch(docs, work, f"id {dict(docs.dtypes)['id']}, same long, places array<int>, items array<string>").filter("size(items) > 0"))
    sent.destroy()
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 13, share: int = 20, max_pattern_bytes: int = 5 << 20, whole_rows: bool = False) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated) of every row of docs; with ``whole_rows`` also ``row``, the row itself.

    Words are runs of a-z, 0-9 and characters beyond ASCII, after lower-casing A-Z. A window is ``window`` words of an item, or
    the whole of a shorter one. A row is contaminated if a word is hit and ``share`` * n_hit >= n_words. Null texts have no
    words; an empty benchmark hits nothing; null item ids are left out; equal windows count for each of their items; repeated
    rows each come back, ids may be null, an empty table gives an empty result.

    At most ``max_pattern_bytes`` of item text are searched at once: a worker holds about 20 bytes of patterns and table for
    each of them, built once for all its tasks. Repeated items are one. A larger benchmark is cut into slices by hash. Each is collected, searched in its own pass, and dropped before
    the next; only rows with hits are written, and added up by row.
    """
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), text_bytes(text_col).alias("t")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    slices = int(total // max_pattern_bytes) + 1
    of = lambda k: [(r["item"], bytes(r["t"])) for r in items.filter(F.pmod(F.xxhash64("item", "t"), F.lit(slices)) == k).collect()]
    if slices == 1:
        found = scan(docs, of(0), id_col, text_col, window, whole_rows)
    else:
        keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("same"), text_bytes(text_col).alias("t"))
        passes = None
        for k in range(slices):
            one = scan_hits(keyed, of(k), window)
            passes = one if passes is None else passes.unionByName(one)
        distinct = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
        merged = passes.groupBy("id", "same").agg(F.size(distinct("places")).cast("long").alias("n_hit"), F.array_sort(distinct("items")).alias("items"))
        left = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("same"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("n_words"), *([F.struct("*").alias("row")] if whole_rows else [])).alias("l")
        found = left.join(merged.alias("m"), F.expr("l.id <=> m.id and l.same = m.same"), "left").select("l.id", *(["l.row"] if whole_rows else []), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return found.select("id", *(["row"] if whole_rows else []), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that aren't contaminated, as they are; nulls, repeats and empty tables as decontaminate() has them."""
    return decontaminate(docs, benchmark, whole_rows=True, **options).filter("not contaminated").select("row.*")
