"""Every registered query of the domain against its SQL in DuckDB."""

import glob
import json
import math
import os

import duckdb
import pytest

from chemloom.plans import queries as plans


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def text(v):
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query(spark, duck, sf_dir, name):
    df = plans.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(text(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    result = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted(tuple(text(r[names.index(c)]) for c in cols) for r in result.fetchall())
    assert got == want


def test_no_nested_loops(spark, sf_dir):
    for name in ("toxicity_summary", "lookup_registry_by_cas", "assemble_dossier", "exposure_bands"):
        plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_documents_number_their_sentences_once(spark, sf_dir):
    plan = plans.documents(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 1


def test_values_are_sorted_in_bounded_tasks(spark, sf_dir, monkeypatch):
    want = plans.QUERIES["lookup_toxvals"](spark, sf_dir).collect()
    monkeypatch.setattr(plans, "STRETCH", 300, raising=False)
    df = plans.QUERIES["lookup_toxvals"](spark, sf_dir)
    assert df.rdd.getNumPartitions() >= 20
    assert df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(_w0") == 0
    assert sorted(map(str, df.collect())) == sorted(map(str, want))


def test_report_json_nests_what_the_flat_report_has(spark, sf_dir):
    flat = {}
    for r in plans.QUERIES["report_csv"](spark, sf_dir).filter("Row > 0").orderBy("CAS", "Row").collect():
        flat.setdefault(r["CAS"], []).append((r["Exposure_Pathway"], r["Species"], r["Value"]))
    for r in plans.QUERIES["report_json"](spark, sf_dir).collect():
        report = json.loads(r["report"])
        got = [(e["exposure_pathway"], e["species"], e["value"]) for e in report.get("toxicity_endpoints", [])]
        assert got == flat.get(r["cas"], [])
        assert report["query_info"] == {"timestamp": "2024-01-01T00:00:00", "cas_number": r["cas"]}
        assert all(h.startswith("H4") for h in report["ecotoxicity"].get("h_codes_aquatic", []))


def test_reports_read_each_sentence_once(spark, sf_dir):
    plan = plans.QUERIES["report_json"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 1 and plan.count("NOEC algae") == 1
    entries = plans.E.ecotox_entries(plans.sentences(spark, sf_dir))
    kept = [c for c in entries.columns if c not in ("k", "ordinal", "source_section", "type", "value_mg_l")]
    both = plans.E.with_ecotox(plans.mined(spark, sf_dir)).filter("eco is not null")
    assert sorted(map(str, both.select("k", "ordinal", *[f"eco.{c}" for c in kept]).collect())) == sorted(map(str, entries.select("k", "ordinal", *kept).collect()))


def test_sentences_stay_with_their_chemical(spark, sf_dir):
    """Grouping and joining by chemical, and lower case, cost no further shuffle or evaluation; a report has only the facets that it shows."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda df: df._jdf.queryExecution()
        assert plan(plans.E.exposure_bands(plans.sentences(spark, sf_dir), "k", "ordinal")).executedPlan().toString().count("Exchange") == 1
        assert plan(plans.E.exposure_bands(plans.sentences(spark, sf_dir), "k", "ordinal")).optimizedPlan().toString().count("lower(") == 1
        assert plan(plans.E.ecotox_entries(plans.sentences(spark, sf_dir))).optimizedPlan().toString().count("lower(value") == 1
        assert "dermal#" not in plan(plans.QUERIES["report_csv"](spark, sf_dir)).optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
