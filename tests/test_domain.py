"""Operators of the chemical domain on literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from chemloom.functions import cas
from chemloom.functions import text as T
from chemloom.operators import annotations as A
from chemloom.operators import endpoints as E
from chemloom.operators import ghs as G
from chemloom.operators import registry as R
from chemloom.operators import toxvals as V


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("number", ["67-64-1", "64-17-5", "71-43-2", "50-00-0"])
def test_published_checksum(spark, number):
    assert one(spark, number, cas.status) == "valid"
    assert one(spark, number[:-1] + str((int(number[-1]) + 1) % 10), cas.status) == "bad_check"


def test_compat_checksum(spark):
    assert one(spark, "67-64-1", lambda c: cas.checksum(F.translate(c, "-", ""), compat=True)) == 5
    assert one(spark, None, cas.status) == "bad_format"
    assert one(spark, "x", cas.status) == "bad_format"


@pytest.mark.parametrize("raw, found", [("67-64-1 (Acetone)", "67-64-1"), (" acetone ", "acetone"), ("see (67-64-1),", "67-64-1"), ("", "")])
def test_first_cas(spark, raw, found):
    assert one(spark, raw, cas.first_cas) == found


@pytest.mark.parametrize("text, unit", [("5 ug/kg", "g/kg"), ("12 mg/m³ in", "mg/m³"), ("3 MG/KG bw", "MG/KG"), ("3 mg/kgs", None), ("none", None)])
def test_unit(spark, text, unit):
    assert one(spark, text, T.unit_of) == unit


@pytest.mark.parametrize("text, value, low, high", [("LC50 1,234.5 mg/L", 234.5, None, None), ("EC50 1,5 mg/L", 15.0, None, None), ("3 species, 12-14 h", None, 12.0, 14.0), ("LC50 < 7 mg/L (CI 1.5–2)", 7.0, 1.5, 2.0)])
def test_ecotox(spark, text, value, low, high):
    got = one(spark, text, T.ecotox)
    assert (got["value_num"], got["ci_low"], got["ci_high"]) == (value, low, high)


@pytest.mark.parametrize(
    "text, route, species",
    [
        ("Irritating concentration", "Oral", "rat"),
        ("LC50 fish (trout) 3 mg/L", "Ecotoxicity (aquatic)", "fish, trout"),
        ("aquatic life", "Ecotoxicity (aquatic)", "aquatic"),
        ("LD50 rabbit skin", "Dermal", "rabbit"),
        ("10 ppm", "Inhalation", "—"),
        (None, "Other", "—"),
    ],
)
def test_route(spark, text, route, species):
    got = one(spark, text, lambda c: T.route_and_species(c, T.species_route_tokens(c)))
    assert (got["route"], got["species"]) == (route, species)


def test_number(spark):
    got = [one(spark, x, T.number) for x in ("1.5", " 2 ", "1.5d", "nan", "", None, "1e3", "n/a")]
    assert got == [1.5, 2.0, None, None, None, None, 1000.0, None]


def test_statement_codes(spark):
    rows = spark.createDataFrame([(1, "H", "H300+310 (10%); H360FD; PH3", 1), (1, "P", "P305+P351+P338", 2)], "k int, kind string, t string, i int")
    got = {(r["kind"], r["code"]) for r in A.codes(rows, "k", "kind", "t", F.col("i")).collect()}
    assert got == {("H", "H300+310"), ("H", "H360"), ("H", "H3"), ("P", "P305"), ("P", "P351"), ("P", "P338")}


def test_phrases(spark):
    got = {r["code"]: r["line"] for r in G.expand(spark.createDataFrame([("H225",), ("H999",)], "code string")).collect()}
    assert got == {"H225": "H225: Highly flammable liquid and vapour.", "H999": "H999: H999: (phrase not found)"}


def test_merge_takes_the_first_that_is_there(spark):
    rows = [("1-00-0", None, "b", "f1", 2), ("1-00-0", "X", "a", "f1", 1), ("1-00-0", "Y", None, "f0", 9), (None, "Z", "z", "f0", 1)]
    got = R.merge_registry(spark.createDataFrame(rows, "cas string, dtxsid string, name string, src_file string, row_idx int").repartition(3), ["src_file", "row_idx"]).collect()
    assert [tuple(r) for r in got] == [("1-00-0", "Y", "a")]


def test_lookup_prefers_the_exact_number(spark):
    reg = spark.createDataFrame([("12-3", "a", 1), ("1-23", "b", 2)], "cas string, name string, o int")
    q = spark.createDataFrame([("1-23",), ("123",), (" ",), (None,), ("9",)], "query string")
    got = {r["query"]: r["name"] for r in R.lookup_by_cas(q, reg, ["o"]).collect()}
    assert got == {"1-23": "b", "123": "a", " ": None, None: None, "9": None}


def test_blanks_and_masses(spark):
    df = spark.createDataFrame([(" 1-00-0 ", "NaN", " x "), ("None", "y", "z"), ("2-00-0", "", "nan")], "cas string, dtxsid string, name string")
    assert [tuple(r) for r in R.scrub_nulls(df, ["cas", "dtxsid", "name"]).collect()] == [("1-00-0", None, "x")]


def test_bands(spark):
    rows = [(1, 1, "LD50 oral none"), (1, 2, "LD50 oral 1,500 mg/kg"), (1, 3, "LC50 rat 1,200.5 mg/m3"), (1, 4, "LD50 dermal 9000 mg/kg"), (2, 1, "nothing")]
    got = {r["pathway"]: (r["dose"], r["band"]) for r in E.exposure_bands(spark.createDataFrame(rows, "k int, o int, value string"), "k", "o").collect()}
    assert got == {"oral": (500.0, 4), "inhalation": (1200.5, 3), "dermal": (9000.0, 5)}


def test_ecotox_summary_falls_back(spark):
    rows = [(1, 1, "LC50 5 mg/L in water"), (2, 1, "fish LC50 0 mg/L"), (2, 2, "fish LC50 3 mg/L"), (2, 3, "daphnia EC50 7 mg/L"), (2, 4, "daphnia EC50 8 mg/L")]
    got = {r["k"]: r for r in E.ecotox_summary(spark.createDataFrame(rows, "k int, o int, value string").repartition(3), "k", "o").collect()}
    assert (got[1]["lc50"], got[1]["excerpt"], got[1]["entries"]) == (None, "LC50 5 mg/L in water", 1)
    assert (got[2]["lc50"], got[2]["ec50"], got[2]["species"], got[2]["entries"]) == (3.0, 8.0, "fish", 4)


def test_payload_forms(spark):
    rows = [('{"results":[{"study_type":"Ames test","value":0}]}',), ('[{"studyType":"neuro","toxValNumeric":2}]',), ("no json",), (None,)]
    got = sorted((r["category"], r["value"]) for r in V.read_payloads(spark.createDataFrame(rows, "payload string")).collect())
    assert got == [("genotoxicity", 0.0), ("neurotoxicity", 2.0)]


def walk(sections, path=(), heading=None):
    """Items of nested sections, one section after the other."""
    for i, s in enumerate(sections or []):
        if isinstance(s, dict):
            own = s.get("TOCHeading") or heading
            for j, x in enumerate(s.get("Information") or []):
                if isinstance(x, dict):
                    yield [*path, i], j, s.get("TOCHeading"), own, x.get("Name"), x.get("Value")
            yield from walk(s.get("Section"), (*path, i), own)


def nested(levels):
    doc = [{"TOCHeading": f"H{levels}", "Information": [{"Name": "leaf", "Value": "x"}, "no item", None]}]
    for d in range(levels - 1, 0, -1):
        doc = [5, {"TOCHeading": f"H{d}" if d % 3 else "", "Information": [{"Name": f"n{d}", "Value": f"v{d}"}, {"Value": None}], "Section": doc}, {"Section": [{"Information": [{"Name": "side"}]}]}]
    return doc


@pytest.mark.parametrize("step", [1, 4, 30])
def test_flatten_any_depth(spark, step):
    docs = {k: nested(levels) for k, levels in ((1, 1), (2, 4), (3, 5), (12, 12), (14, 14))}
    rows = [(k, json.dumps({"Record": {"Section": d}})) for k, d in docs.items()] + [(2, "bad"), (3, None), (4, "[]"), (5, '{"Record":{"Section":{}}}'), (6, '{"Record":{"Section":[]}}'), (12, json.dumps({"Record": {"Section": docs[2]}}))]
    items = A.flatten(spark.createDataFrame(rows, "doc_id int, doc string"), step=step)
    assert items.columns == ["doc_id", "path", "info_pos", "own_heading", "heading", "name", "raw"]
    want = [(k, *x) for k, d in [*docs.items(), (12, docs[2])] for x in walk(d)]
    assert sorted(map(str, map(tuple, items.collect()))) == sorted(map(str, want))
    assert A.flatten(spark.createDataFrame([], "doc_id int, doc string")).collect() == []


def test_values_as_text(spark):
    doc = '{"Record":{"Section":[{"TOCHeading":"T","Information":[{"Name":"a","Value":"x"},{"Name":"b","Value":{"StringWithMarkup":{"String":" y "}}},{"Name":"c","Value":2.5}]}]}}'
    items = A.flatten(spark.createDataFrame([(1, doc)], "doc_id int, doc string"))
    assert [tuple(r) for r in items.select("name", A.text(F.col("raw")).alias("t")).orderBy("info_pos").collect()] == [("a", "x"), ("b", "y"), ("c", "2.5")]


def test_a_value_is_read_once(spark):
    doc = '{"Record":{"Section":[{"TOCHeading":"Toxicity","Information":[{"Name":"a","Value":{"StringWithMarkup":[{"String":"LD50 rat","Markup":[{"URL":"u"}]},{"String":"oral 5 mg/kg"}]}},{"Name":"b","Value":{"StringWithMarkup":[{"String":""}],"String":" y "}},{"Name":"c","Value":" "},{"Name":"d","Value":true}]}]}}'
    items = A.flatten(spark.createDataFrame([(1, doc)], "doc_id int, doc string"))
    found = A.tox_endpoints(items)
    assert [(r["type"], r["value"], r["unit"], r["species_route"], r["reference_urls"]) for r in found.orderBy("info_pos").collect()] == [("a", "LD50 rat oral 5 mg/kg", "mg/kg", ["LD50", "rat", "oral"], ["u"]), ("b", "y", None, None, None), ("d", "true", None, None, None)]
    for df in (found, A.metrics(items)):
        # One reading, and the other way for what is no list of objects; it was in the filter and in every column.
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 2


def test_tokens_are_found_once(spark):
    texts = spark.createDataFrame([("LD50 Rat ORAL 5 μG/KG bw, 7 ug/kg",), ("strat",), (None,)], "value string")
    df = E.mine(texts)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    got = {r["value"]: (r["unit"], r["species_route"], r["route"], r["species"]) for r in df.collect()}
    assert got == {texts.first()["value"]: ("μG/KG", ["LD50", "Rat", "ORAL"], "Oral", "rat"), "strat": (None, None, "Oral", "rat"), None: (None, None, "Other", "—")}


def test_rules_of_routes_are_compiled(spark):
    texts = spark.createDataFrame([(v,) for v in ("LD50 Rat ORAL 5 mg/kg", "strat", None, "", "LC50 fish, algae 3 mg/L", "dermal rabbit skin", "ppm mouse", "po dog IV Human", "Daphnia")], "value string")
    df = E.mine(texts)
    assert "lambdafunction(struct(" not in df._jdf.queryExecution().optimizedPlan().toString()  # Spark interprets what lambdas hold
    tokens = T.species_route_tokens(F.col("value"))
    plain = texts.select("value", tokens.alias("species_route"), T.route_and_species(F.col("value"), tokens).alias("rs")).select("value", "species_route", "rs.*")
    assert sorted(map(str, df.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_odd_documents_are_read_as_far_as_they_fit(spark):
    good = '{"TOCHeading":"T","Information":[{"Name":"a","Value":{"z":1,"b":2}}]}'
    docs = [f'{{"Record":{{"Section":[{good}]}}}}', f'{{"Record":{{"Section":[5,null,{good}]}}}}', f'{{"Record":{{"Section":[{{"TOCHeading":7,"Information":"no list"}},{good}]}}}}', f'[{{"Record":{{"Section":[{good}]}}}}]', f"{{'Record':{{'Section':[{good}]}}}}", f'{{"Record":{{"Section":[{good}]']
    items = A.flatten(spark.createDataFrame(list(enumerate(docs)), "doc_id int, doc string"))
    assert sorted((r["doc_id"], r["path"], r["own_heading"], r["name"], json.loads(r["raw"])) for r in items.collect()) == [(i, [p], "T", "a", {"z": 1, "b": 2}) for i, p in ((0, 0), (1, 2), (2, 1))]
    # One typed reading; a second one by variant is for documents that don't fit. All were variants.
    assert "from_json" in str(A._sections(F.col("doc"), A._levels(4)))
