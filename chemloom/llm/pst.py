"""Language-model scoring with a probabilistic suffix tree over the symbols of texts, beside a unigram base score.

Symbols are the bytes of a text's lower-cased words joined by blanks, and one end. Contexts have up to ``DEPTH`` symbols; a
context is kept if it is frequent and its next-symbol distribution diverges from that of its suffix."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, discard, each_text, text_bytes

DEPTH = 5
END, BEGIN, WIDTH = 256, 257, 258
BITS = 9
#: Symbols that are worked on at once.
CHUNK = 1 << 19
#: Counts of symbol runs, and an eighth of it words, that a task holds before it passes them on.
HELD = 1_500_000


def fold(id_col: Column, folds: int) -> Column:
    return F.pmod(F.coalesce(F.crc32(id_col.cast("string")), F.lit(0)), F.lit(folds))


def _symbols(words: list[bytes]) -> np.ndarray:
    body = np.frombuffer(b" ".join(words), np.uint8)
    out = np.full(DEPTH + len(body) + 1, BEGIN, np.int64)
    out[DEPTH:-1] = body
    out[-1] = END
    return out


def _gram_counts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of DEPTH symbols and their successor, and how often each occurs."""
    s = np.concatenate(texts)
    n = len(s) - DEPTH
    code = np.zeros(n, np.int64)
    for j in range(DEPTH + 1):
        code = (code << BITS) | s[j : j + n]
    return np.unique(code[s[DEPTH:] != BEGIN], return_counts=True)


def gather(train: DataFrame) -> DataFrame:
    """train(t binary) -> (word, code, n): counts of words (code null) and of symbol runs (word null) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        held, waiting, codes = [], 0, []

        def out_words() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], names=["word", "code", "n"])
            words.clear()
            return b

        def summed() -> tuple[np.ndarray, np.ndarray]:
            c, n = np.concatenate([x[0] for x in codes]), np.concatenate([x[1] for x in codes])
            order = np.argsort(c, kind="stable")
            c, n = c[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            return c[first], np.add.reduceat(n, first)

        def out_codes() -> pa.RecordBatch:
            c, n = summed()
            codes.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(len(c), pa.binary()), pa.array(c), pa.array(n)], names=["word", "code", "n"])

        for batch in batches:
            for text in each_text(batch):
                own = text.translate(LOWER).split()
                words.update(own)
                held.append(_symbols(own))
                waiting += len(held[-1])
                if waiting > CHUNK:
                    codes.append(_gram_counts(held))
                    held, waiting = [], 0
                    if sum(len(c) for c, _ in codes) > HELD:
                        codes[:] = [summed()]
                        if 2 * len(codes[0][0]) > HELD:
                            yield out_codes()
                if 8 * len(words) > HELD:
                    yield out_words()
        if held:
            codes.append(_gram_counts(held))
        if words:
            yield out_words()
        if codes:
            yield out_codes()

    return train.mapInArrow(run, "word binary, code long, n long").groupBy("word", "code").agg(F.sum("n").alias("n"))


def contexts(grams: DataFrame, least_count: int, z: float) -> tuple[DataFrame, str]:
    """(d, ctx, sym, n) of the kept contexts and their suffixes, as a table, and its path.

    A context of depth d is kept if ``least_count`` symbols follow it and a G test tells its successors from those of its
    suffix. Both are judged in Spark; a context meets its suffix by key, so nothing but kept contexts leaves the join."""
    depths = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.shiftright("code", BITS).bitwiseAND(F.lit((1 << BITS * d) - 1)).alias("ctx")) for d in range(DEPTH + 1)]))
    long = grams.select(depths.alias("x"), F.col("code").bitwiseAND(F.lit((1 << BITS) - 1)).alias("sym"), "n").groupBy("x.d", "x.ctx", "sym").agg(F.sum("n").alias("n"))
    long, long_at = cut(long)
    often = long.groupBy("d", "ctx").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).filter((F.col("all") >= least_count) | (F.col("d") == 0))
    rows, rows_at = cut(long.join(often, ["d", "ctx"]))
    suffix = lambda d, ctx: F.expr(f"{ctx} & (shiftleft(1L, {BITS} * ({d} - 1)) - 1L)")
    up = rows.select((F.col("d") + 1).alias("d"), F.col("ctx").alias("up"), "sym", F.col("n").alias("up_n"), F.col("all").alias("up_all"), F.col("kinds").alias("up_kinds"))
    both = rows.filter("d > 0").withColumn("up", suffix("d", "ctx")).join(up, ["d", "up", "sym"])
    g = F.sum(2 * F.col("n") * F.log((F.col("n") / F.col("all")) / (F.col("up_n") / F.col("up_all"))))
    free = F.greatest(F.max("up_kinds") - 1, F.lit(1))
    kept = both.groupBy("d", "ctx").agg(g.alias("g"), free.alias("free")).filter(F.col("g") > F.col("free") + z * F.sqrt(2 * F.col("free")))
    # With a context, all its suffixes.
    ends = F.transform(F.sequence(F.lit(1), F.col("d")), lambda e: F.struct(e.alias("d"), F.col("ctx").bitwiseAND(F.element_at(F.array(*[F.lit((1 << BITS * i) - 1) for i in range(1, DEPTH + 1)]), e)).alias("ctx")))
    kept = kept.select(F.explode(ends).alias("x")).select("x.d", "x.ctx").unionByName(rows.filter("d = 0").select("d", "ctx")).distinct()
    out, path = cut(rows.join(kept, ["d", "ctx"], "left_semi").select("d", "ctx", "sym", "n"))
    discard(grams.sparkSession, long_at, rows_at)
    return out, path


def parts_of(edges: DataFrame, most: int) -> np.ndarray:
    """A part for each pair of last symbols, so that a part has about ``most`` contexts: (pairs) -> number.

    What follows a context depends on the longest kept suffix alone, and those of two symbols or more share their last two."""
    pairs = edges.filter("d > 1").select("d", "ctx").distinct().groupBy(F.col("ctx").bitwiseAND(F.lit((1 << 2 * BITS) - 1)).alias("pair")).agg(F.count("*").alias("n"))
    out, load = np.zeros(1 << 2 * BITS, np.int16), [0]
    for r in sorted(pairs.collect(), key=lambda r: (-r["n"], r["pair"])):  # one row for each pair of symbols at most
        k = int(np.argmin(load))
        if load[k] and load[k] + r["n"] > most:
            load.append(0)
            k = len(load) - 1
        load[k] += r["n"]
        out[r["pair"]] = k
    return out


class SuffixTree:
    """Kept contexts with smoothed next-symbol distributions, as an automaton whose state after any text is the longest
    suffix that begins a kept context; its distribution is that of the longest kept context the text ends with.

    Tables have a column for each symbol that was seen, and one for all others, whose value holds for each of them."""

    def __init__(self, edges: np.ndarray):
        d, ctx, sym, n = edges.T if len(edges) else np.zeros((4, 0), np.int64)
        mask = lambda e: (1 << BITS * e) - 1
        seen = np.unique(np.append(sym, [END, BEGIN]))
        self.classes = np.full(WIDTH, len(seen), np.int64)
        self.classes[seen] = np.arange(len(seen))
        width = len(seen) + 1
        # Smoothing: a context's counts and as many votes of its suffix as it has different successors.
        kept, p = [np.unique(ctx[d == e]) for e in range(DEPTH + 1)], []
        kept[0] = np.zeros(1, np.int64)
        for e, codes in enumerate(kept):
            own = np.zeros((len(codes), width), np.float32)
            here = d == e
            own[np.searchsorted(codes, ctx[here]), self.classes[sym[here]]] = n[here]
            kinds = np.maximum(1, (own > 0).sum(axis=1, keepdims=True))
            if e:
                up = p[e - 1][np.searchsorted(kept[e - 1], codes & mask(e - 1))]
            else:
                up = np.full((1, width), 1 / (END + 1), np.float32)
                up[:, self.classes[BEGIN]] = 0
            p.append((own + kinds * up) / (own.sum(axis=1, keepdims=True, dtype=np.float64) + kinds).astype(np.float32))
        # States: all beginnings of kept contexts, shorter ones first.
        states = [np.unique(np.concatenate([kept[f] >> (BITS * (f - e)) for f in range(e, DEPTH + 1)])) for e in range(DEPTH + 1)]
        offset = np.cumsum([0, *map(len, states)])
        self.next = np.zeros((offset[-1], width), np.int32)
        self.log = np.zeros((offset[-1], width), np.float32)
        for e, codes in enumerate(states):
            fail = np.zeros(len(codes), np.int64)
            open_ = np.full(len(codes), e > 0)
            for f in range(e - 1, -1, -1):
                at = np.searchsorted(states[f], codes & mask(f))
                found = open_ & (states[f][np.minimum(at, len(states[f]) - 1)] == codes & mask(f)) if len(states[f]) else np.zeros(len(codes), bool)
                fail[found] = offset[f] + at[found]
                open_ &= ~found
            if e:
                self.next[offset[e] : offset[e + 1]], self.log[offset[e] : offset[e + 1]] = self.next[fail], self.log[fail]
            at = np.searchsorted(codes, kept[e])
            with np.errstate(divide="ignore"):
                self.log[offset[e] + at] = np.where(p[e] > 0, np.log10(np.maximum(p[e], 1e-38)), 0.0)
            if e < DEPTH and len(states[e + 1]):
                parent = np.searchsorted(codes, states[e + 1] >> BITS)
                self.next[offset[e] + parent, self.classes[states[e + 1] & mask(1)]] = offset[e + 1] + np.arange(len(states[e + 1]))
        self.log[:, self.classes[BEGIN]] = 0.0
        self.kept, self.width = sum(map(len, kept)), width
        self.next *= width  # offsets of rows in the flat tables

    def score(self, texts: list[np.ndarray], span: int = 512, own: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each text, or of its symbols after the pairs of symbols marked in ``own``. Texts are cut into segments, each led in by the DEPTH symbols before it, which fix
        its state; all segments move one symbol at a time."""
        which, begin = [], []
        lengths = np.array([len(t) for t in texts])
        start = np.cumsum(lengths) - lengths
        for i, n in enumerate((lengths - DEPTH).tolist()):
            k = np.arange(0, n, span)
            begin.append(start[i] + k)
            which.append(np.full(len(k), i))
        which, begin = np.concatenate(which), np.concatenate(begin)
        end = np.minimum(begin + DEPTH + span, (start + lengths)[which])
        raw = np.concatenate(texts)
        flat = self.classes[raw]
        here = None if own is None else own[(np.concatenate(([BEGIN, BEGIN], raw[:-2])) << BITS) | np.concatenate(([BEGIN], raw[:-1]))]
        order = np.argsort(begin - end, kind="stable")  # long segments first: what has ended leaves the front
        which, begin, end = which[order], begin[order], end[order]
        size = end - begin
        state, total = np.zeros(len(begin), np.int64), np.zeros(len(begin))
        move, log = self.next.ravel(), self.log.ravel()
        for t in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size, -t, side="left"))
            at = state[:n] + flat[begin[:n] + t]
            if t >= DEPTH:
                total[:n] += log[at] if here is None else np.where(here[begin[:n] + t], log[at], 0)
            state[:n] = move[at]
        return np.bincount(which, weights=total, minlength=len(texts))


def _part(edges: DataFrame, part: np.ndarray, k: int) -> np.ndarray:
    """The edges of one part: contexts of up to one symbol are in each."""
    pairs = [int(x) for x in np.flatnonzero(part == k)] if part.max() else None
    if pairs is not None:
        wanted = edges.sparkSession.createDataFrame(pd.DataFrame({"pair": pairs}))
        keyed = edges.withColumn("pair", F.col("ctx").bitwiseAND(F.lit((1 << 2 * BITS) - 1)))
        edges = keyed.filter("d > 1").join(F.broadcast(wanted), "pair", "left_semi").drop("pair").unionByName(edges.filter("d <= 1"))
    got = edges.toArrow()
    return np.stack([got.column(c).to_numpy().astype(np.int64) for c in ("d", "ctx", "sym", "n")], axis=1)


def _more(rows: DataFrame, tree: SuffixTree, own: np.ndarray) -> DataFrame:
    """(same, score): what the part's contexts add to the score of each different text; written, so that its broadcast goes."""
    sent = rows.sparkSession.sparkContext.broadcast((tree, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, own = sent.value
        texts, same, waiting = [], [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(same, pa.int64()), pa.array(tree.score(texts, own=own))], names=["same", "score"])

        for batch in batches:
            for key, text in zip(batch.column("same").to_pylist(), each_text(batch), strict=True):
                same.append(key)
                texts.append(_symbols(text.translate(LOWER).split()))
                waiting += len(texts[-1])
                if waiting > CHUNK:
                    yield done()
                    texts, same, waiting = [], [], 0
        if texts:
            yield done()

    out, _ = cut(rows.select(F.xxhash64("t").alias("same"), "t").mapInArrow(run, "same long, score double").groupBy("same").agg(F.first("score").alias("score")))
    sent.destroy()
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1, least_count: int = 2000, z: float = 3.1, often_share: float = 4e-6, most_contexts: int = 60_000) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model and the base learn from all rows whose crc32(id as text) mod ``folds`` is not ``held_fold``. Tokens are the
    lower-cased words and one end. ``base_score`` adds log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens; ``score`` is the
    tree's log10 probability of the same words, letter by letter, and the end.

    A context of up to five symbols is kept if ``least_count`` symbols follow it, a number that doesn't grow with the corpus,
    and its successors diverge: so more text keeps more contexts. At most about ``most_contexts`` are broadcast at once; beyond
    that they are parted by their last two symbols and each part scores the places it decides in a pass of its own.

    Counts of words that make up ``often_share`` of all tokens (at most 1 / often_share words) are broadcast; the other words
    of each text are joined with the counts by word. Null and empty texts are one end; null ids learn and are not held out;
    repeated rows each count and come back; an empty table gives an empty result; other columns are ignored. Without rows to
    learn from all counts are 0 and the tree is uniform.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), (fold(F.col(id_col), folds) == held_fold).alias("held_out"), text_bytes(text_col).alias("t"))
    counts, _ = cut(gather(rows.filter("not held_out").select("t")))
    words, grams = counts.filter("word is not null").select("word", "n"), counts.filter("word is null").select("code", "n")
    vocabulary, tokens = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends = grams.agg(F.coalesce(F.sum(F.when(F.col("code").bitwiseAND(F.lit((1 << BITS) - 1)) == END, F.col("n"))), F.lit(0))).first()[0]
    tokens, vocabulary = tokens + ends, vocabulary + (ends > 0)
    edges, edges_at = contexts(grams, least_count, z)
    part = parts_of(edges, most_contexts)
    parts = int(part.max()) + 1
    tree = SuffixTree(_part(edges, part, 0))
    head = {bytes(r["word"]): r["n"] for r in words.filter(F.col("n") >= often_share * tokens).collect()}  # bounded by 1 / often_share
    sent = spark.sparkContext.broadcast((tree, head, part == 0 if parts > 1 else None))
    norm = float(np.log10(tokens + 0.5 * (vocabulary + 1)))
    of_end, knows_end = float(np.log10(ends + 0.5)), int(ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, head, own_pairs = sent.value
        gain = {w: float(np.log10(n + 0.5)) for w, n in head.items()}

        def done() -> pa.RecordBatch:
            cols = [pa.array(kept[k], t) for k, t in kinds.items()] + [pa.array(tree.score(texts, own=own_pairs))]
            return pa.RecordBatch.from_arrays(cols, names=[*kinds, "score"])

        texts, kept, waiting, kinds = [], {}, 0, {}
        for batch in batches:
            if not kinds:
                kinds = {"key": pa.int64(), "same": pa.int64(), "id": batch.schema.field("id").type, "held_out": pa.bool_(), "n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "tail": pa.list_(pa.binary())}
                kept = {k: [] for k in kinds}
            for key, same, name, out, text in zip(*(batch.column(c).to_pylist() for c in ("key", "same", "id", "held_out", "t")), strict=True):
                own = text.translate(LOWER).split()
                got = list(map(gain.get, own))
                rest = [w for w, g in zip(own, got, strict=True) if g is None]
                row = (key, same, name, out, len(own) + 1, len(own) - len(rest) + knows_end, sum(g for g in got if g is not None) + of_end, rest)
                for column, x in zip(kept.values(), row, strict=True):
                    column.append(x)
                texts.append(_symbols(own))
                waiting += len(texts[-1])
                if waiting > CHUNK:
                    yield done()
                    texts, kept, waiting = [], {k: [] for k in kinds}, 0
        if texts:
            yield done()

    kind = dict(rows.dtypes)["id"]
    # The keys are fixed by being written.
    scored, _ = cut(rows.withColumns({"key": F.monotonically_increasing_id(), "same": F.xxhash64("t")}).mapInArrow(run, f"key long, same long, id {kind}, held_out boolean, n_tokens long, known long, base double, tail array<binary>, score double"))
    rest = scored.select("key", F.explode("tail").alias("word")).join(words, "word", "left")
    rest = rest.groupBy("key").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.count("n").alias("found"))
    both = scored.drop("tail").join(rest, "key", "left")
    if parts > 1:
        more = [_more(rows, SuffixTree(_part(edges, part, k)), part == k) for k in range(1, parts)]
        added = reduce(DataFrame.unionByName, more).groupBy("same").agg(F.sum("score").alias("added"))
        both = both.join(added, "same").withColumn("score", F.col("score") + F.col("added"))
    discard(spark, edges_at)
    zero = F.lit(0)
    return both.select("id", "held_out", "n_tokens", (F.col("known") + F.coalesce("found", zero)).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"), "score")
