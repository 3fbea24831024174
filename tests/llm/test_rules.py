"""Quality rules: counts, cutoffs and certificates; the queries with SQL."""

import glob
import math
import os
import random
from fractions import Fraction

import duckdb
import pandas as pd
import pytest

from chemloom.llm import queries, rules


def test_counts():
    assert rules.counts(b"") == rules.counts(b" \t\n") == (0, 0, 0, 0, 0, 0)
    assert rules.counts("é  ab# |\nx\n\n x\nx\n \n".encode()) == (6, 9, 2, 1, 0, 4)
    text = "a b c a b c\nz"
    assert rules.counts(text.encode())[4] == 6
    rng = random.Random(1)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randrange(12))]
        again = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {p for i, g in enumerate(again) if again.count(g) > 1 for p in range(i, i + 3)}
        assert rules.counts(" ".join(words).encode())[4] == len(covered)


@pytest.mark.parametrize("k, n", [(0, 1), (0, 85), (3, 160), (20, 400), (7, 7)])
def test_exact_chances(k, n):
    p = Fraction(1, 20)
    exact = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
    assert math.isclose(rules.at_most(k, n, 0.05), float(exact), rel_tol=1e-9)


def test_paths_and_certificates():
    tally = pd.DataFrame({"worse": [0, 1, 5, 9], "good": [900, 99, 1, 0], "bad": [0, 1, 20, 30]})
    assert rules.path(tally) == [8, 4, 4, 4, 4, 4, 4]
    assert rules.path(tally.assign(bad=0)) == [None] * 7
    first, texts = pd.Series([0, 1, 3]), pd.Series([960, 5, 35])
    level, n, k, p = rules.certificate(first, texts, 7, 0.05, 0.0125)
    assert (level, n, k) == (2, 1000, 5) and p == rules.at_most(5, 1000, 0.05)
    assert rules.certificate(pd.Series([0]), pd.Series([50]), 7, 0.05, 0.05) is None


def corpus(spark, n=1500):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        rows.append((i, ["a", "b", None][i % 3 if i % 40 else 0], " ".join(f"w{rng.randrange(10**6)}" + ("$" if bad else "") for _ in range(60))))
        labels.append((i, 0 if bad else 1))
    rows += [(5000, "b", None), (None, "b", ""), (None, None, rows[0][2]), (1, "b", rows[1][2]), (1, "b", rows[1][2]), (6000, "rare", rows[0][2])]
    labels += [(7000, 1), (None, 0), (6000, 0), (3, None), (2, 1)]
    docs = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "doc_id long, lang string, text string, n_words int, stratum string, kept boolean")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_rejections(spark):
    docs, labels = corpus(spark)
    got = rules.judge(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        symbols = r["n_words"] > 0 and r["n_symbols"] > 0 and r["stratum"] != "rare"
        assert r["base_failed"] == (r["n_words"] < 50)
        assert r["kept"] == (r["n_words"] >= 50 and not symbols) and r["broken"] == (["symbols"] if symbols else [])
    own = {r["stratum"]: r for r in rules.cutoffs(rules.measured(docs), labels).collect()}
    assert set(own) == {"", "a", "b"}
    for r in own.values():
        assert r["rejected"] == 0 and r["p_value"] <= 0.05 / 3 and r["cut"][0] is not None


def test_without_labels(spark):
    docs, labels = corpus(spark, 10)
    for none in (labels.limit(0), labels.filter("doc_id = 7000")):
        assert all(r["kept"] == (not r["base_failed"]) and r["broken"] == [] for r in rules.judge(docs, none).collect())
    assert rules.judge(docs.limit(0), labels).collect() == []


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_risk_controlled_quality_rules"])
def test_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries.QUERIES[name](spark, sf_dir)
    want = c.execute(f"select {', '.join(df.columns)} from ({queries.ORACLE_SQL[name]}) x").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)
