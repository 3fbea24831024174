"""Quality rules with cutoffs whose false rejections are bounded by exact binomial tests on held-out labels."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, each_text, join_unique, text_bytes

SYMBOLS = b"#*$%&|<>"
#: Bytes that begin no character of a word: continuation bytes and blanks.
NO_CHARACTER = bytes(range(0x80, 0xC0)) + b" \t\n\v\f\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: Allowed shares of good tuning texts that a single rule rejects, from the mildest step of a stratum's path to the strictest.
LEVELS = (0.0, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05)
RULES = ["symbols", "dup_lines", "repeat_words", "long_words", "short_words"]


def counts(text: bytes) -> tuple[int, int, int, int, int, int]:
    """COUNTS of a text: words; characters in words; symbols; lines with a word that equal an earlier line; words in windows of
    three words that occur twice or more; lines with a word."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    times = Counter(zip(words, words[1:], words[2:], strict=False))
    if len(times) < n - 2:
        at = np.array([i for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if times[g] > 1])
        covered = np.zeros(n, bool)
        covered[np.concatenate((at, at + 1, at + 2))] = True
        repeated = int(covered.sum())
    return n, len(text.translate(None, NO_CHARACTER)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(id, stratum, COUNTS) of every row, of whole texts; a null text has none; a null stratum is the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts(t) for t in each_text(batch)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("stratum"), *(pa.array(c) for c in found.T)], names=["id", "stratum", *COUNTS])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), text_bytes(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def failed() -> Column:
    """Rows that no label saves: under 50 words, or over half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def badness() -> Column:
    """Whole numbers of each of RULES, larger for worse: 64ths of symbols a word, of lines and of words; 16ths of characters a word."""
    part = lambda a, b, k: F.least(F.floor(k * F.col(a) / F.greatest(F.col(b), F.lit(1))), F.lit(1023))
    length = part("word_chars", "n_words", 16)
    return F.array(*[c.cast("int") for c in (part("n_symbols", "n_words", 64), part("n_dup_lines", "n_lines", 64), part("n_repeat_words", "n_words", 64), length, -length)])


def at_most(k: int, n: int, p: float) -> float:
    """The chance of k or fewer of n, each with chance p: exact terms of the binomial law, summed."""
    logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k + 1)]
    return math.fsum(map(math.exp, logs))


def path(tally: pd.DataFrame, levels: tuple[float, ...] = LEVELS) -> list[int | None]:
    """A rule's cutoff at each level: of those that reject at most the level's share of good texts, and not more good texts than bad, the
    one that rejects most bad texts; of several the mildest. None where no bad text is rejected. Levels are nested.

    tally(worse int, good, bad): texts of one stratum by the rule's number. A text is rejected above the cutoff."""
    t = tally.sort_values("worse", ascending=False)
    good, bad, total = t["good"].cumsum().to_numpy(), t["bad"].cumsum().to_numpy(), t["good"].sum()
    out: list[int | None] = []
    for share in levels:
        fits = np.flatnonzero((good <= share * total) & (good <= bad) & (bad > 0))
        out.append(int(t["worse"].iloc[fits[np.argmax(bad[fits])]]) - 1 if len(fits) else None)
    return out


def certificate(first: pd.Series, texts: pd.Series, levels: int, risk: float, error: float) -> tuple[int, int, int, float] | None:
    """(level, texts, rejected, chance) of the last level before the first that fails its test; None if the mildest fails.

    ``first`` has the mildest level that rejects a text, 0 for none, and ``texts`` how many good held-out ones."""
    n, best = int(texts.sum()), None
    for level in range(1, levels + 1):
        k = int(texts[(first > 0) & (first <= level)].sum())
        p = at_most(k, n, risk)
        if p > error:
            break
        best = (level, n, k, p)
    return best


def cutoffs(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """(stratum, cut array<int>, level int, tested, rejected, p_value): each stratum's certified cutoffs, by rule; null means none.

    Labelled texts that pass failed() are dealt by their id's CRC: even ones make a path of ever stricter cutoffs for their
    stratum (path()), rule by rule, on texts that the mildest cutoffs of the rules before leave; good odd ones test its levels from the
    mildest on. A level holds if so few rejections of good texts would have at most the chance ``error`` / strata were the
    stratum's rate of false rejections above ``risk``; the first level that doesn't hold ends the path. Strata are those with a
    path, so all certificates hold together with chance 1 - error, for texts like the labelled ones. A stratum with too few labels gets
    no cutoff.

    Null labels and ids don't count; an id with several labels is good if all say so. Aggregates by a rule's number reach one
    task for each stratum, at most 1024 rows; a stratum's good texts are counted by level before they are shuffled."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("good")).dropna().groupBy("id").agg(F.min("good").cast("int").alias("good"))
    known = rows.filter(~failed()).join(own, "id").select("stratum", "good", badness().alias("worse"), (F.crc32(F.col("id").cast("string").cast("binary")) % 2).alias("fold"))
    known, _ = cut(known)
    rest = known.filter("fold = 0").select("stratum", "good", "worse")
    sizes, _ = cut(rest.groupBy("stratum").agg(F.count("*").alias("n")))
    way, total = sizes, rest.count()
    for r, rule in enumerate(RULES):
        tally = rest.groupBy("stratum", F.col("worse")[r].alias("worse")).agg(F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") != 1).alias("bad"))
        step, _ = cut(tally.groupBy("stratum").applyInPandas(lambda t: pd.DataFrame({"stratum": [t["stratum"].iloc[0]], "cuts": [path(t)]}), "stratum string, cuts array<int>"))
        way = way.join(step.withColumnRenamed("cuts", rule), "stratum", "left")
        if r + 1 < len(RULES):
            passed = join_unique(rest, sizes.join(step, "stratum"), ["stratum"], "n", total)
            rest, _ = cut(passed.filter(~F.coalesce(F.col("worse")[r] > F.col("cuts")[0], F.lit(False))).drop("cuts"))
    at = lambda i: F.array(*[F.get(F.col(rule), i) for rule in RULES])
    way = way.filter(F.coalesce(*[F.get(F.col(rule), F.lit(len(LEVELS) - 1)) for rule in RULES]).isNotNull())
    way, _ = cut(way.select("stratum", F.array(*[at(F.lit(i)) for i in range(len(LEVELS))]).alias("path")))
    strata = way.count()
    good = known.filter("fold = 1 and good = 1")
    counted = way.join(good.groupBy("stratum").agg(F.count("*").alias("n")), "stratum")
    tested = join_unique(good, counted, ["stratum"], "n", good.count())
    # The first level that rejects a text; a stricter one rejects it as well.
    rejects = lambda cuts: F.exists(F.zip_with("worse", cuts, lambda w, c: F.coalesce(w > c, F.lit(False))), lambda x: x)
    hits = tested.groupBy("stratum", F.array_position(F.transform("path", rejects), True).alias("first")).agg(F.count("*").alias("texts"))

    def certify(t: pd.DataFrame) -> pd.DataFrame:
        found = certificate(t["first"], t["texts"], len(LEVELS), risk, error / strata)
        t = t.head(1 if found else 0)[["stratum"]]
        for name, kind, v in zip(("level", "tested", "rejected", "p_value"), ("int32", "int64", "int64", "float64"), found or (0, 0, 0, 0.0), strict=True):
            t[name] = np.full(len(t), v, kind)
        return t

    found = hits.groupBy("stratum").applyInPandas(certify, "stratum string, level int, tested long, rejected long, p_value double")
    return found.join(way, "stratum").select("stratum", F.element_at("path", F.col("level")).alias("cut"), "level", "tested", "rejected", "p_value")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """(id, stratum, COUNTS, base_failed, kept, broken array<string>) of every row; broken names the rules whose certified cutoff it exceeds.

    kept is false for what failed() and for what breaks a rule. Null and empty texts have no words, so they fail. Repeated rows each
    come back and each count; ids may be null; empty tables, or labels of no text, leave only failed(); other columns are ignored."""
    rows, _ = cut(measured(docs, id_col, text_col, stratum_col))
    chosen = cutoffs(rows, labels, id_col, label_col, risk, error).select("stratum", "cut")
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    with_cut = join_unique(rows, sizes.join(chosen, "stratum", "left"), ["stratum"], "n", rows.count())
    worse = badness()
    rules = F.array_compact(F.array(*[F.when(worse[r] > F.col("cut")[r], name) for r, name in enumerate(RULES)]))
    return with_cut.withColumns({"base_failed": failed(), "broken": rules}).select(
        "id", "stratum", *COUNTS, "base_failed", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "broken"
    )
