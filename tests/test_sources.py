"""Files: discovery, placeholders, rejects, workbooks, and what is written."""

import gzip
import warnings
import zipfile

import pytest
from pyspark.sql import functions as F

from chemloom.operators import registry as R
from chemloom.operators import toxvals as V
from chemloom.sources import files, tables, workbooks


def book(path):
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns:r="{rel}"><sheets><sheet name="one" r:id="r1"/><sheet name="two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>CASRN</t></si><si><r><t>DTX</t></r><r><t>SID1</t></r></si></sst>")
        z.writestr("xl/worksheets/s1.xml", '<w><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>DTXSID</t></is></c></row><row><c r="A2"><v>67-64-1</v></c><c r="C2" t="s"><v>1</v></c></row></sheetData></w>')
        z.writestr("xl/worksheets/s2.xml", '<w><sheetData><row><c r="A1" t="inlineStr"><is><t>cas</t></is></c></row><row><c r="A2"><v>64-17-5</v></c></row></sheetData></w>')


def merged(registry):
    found = R.merge_registry(R.scrub_nulls(registry, R.FIELDS), files.ORDER)
    return {r["cas"]: (r["dtxsid"], r["preferred_name"]) for r in found.collect()}


def test_folder_of_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Cas Number,DTXSID,name\n67-64-1,D1,"a, ""b"""\n64-17-5,,x\n')
    (tmp_path / "b.CSV").write_text("CAS,Preferred Name\n67-64-1,later\n")
    (tmp_path / "c.csv").write_text("version https://git-lfs.github.com/spec/v1\noid sha256:0\nsize 1\n")
    (tmp_path / "d.csv").write_text("other\n1\n")
    (tmp_path / "f.csv").write_text('CAS,NAME\n50-00-0,"two\nlines"\n')
    (tmp_path / "e.csv").write_text("CASRN,DTXSID\n71-43-2,D3\n1,2,3,4\n")
    assert [r["path"][-5:] for r in files.discover(spark, str(tmp_path)).collect()] == ["a.csv", "b.CSV", "c.csv", "d.csv", "e.csv", "f.csv"]
    registry, rejects = files.load_registry(spark, str(tmp_path))
    assert registry.count() == 5 and registry.select("src_file").distinct().count() == 4 and rejects.count() == 3
    assert merged(registry) == {"67-64-1": ("D1", 'a, "b"'), "64-17-5": (None, "x"), "71-43-2": ("D3", None), "50-00-0": (None, "two\nlines")}
    assert sorted((r["src_file"], r["reason"], r["line"]) for r in rejects.collect()) == [("c.csv", "placeholder", None), ("d.csv", "no registry number", None), ("e.csv", "line", "1,2,3,4")]


def test_unreadable_files_stop_nothing(spark, tmp_path):
    text = "CASRN,DTXSID\n" + "".join(f"{i}-00-0,D{i}\n" for i in range(10, 3000))
    (tmp_path / "a.csv").write_text(text[:200])
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(text.encode())[:-500])
    (tmp_path / "d.csv.gz").write_bytes(gzip.compress(b"CAS\n1-00-0\n") + gzip.compress(b"2-00-0\n"))
    (tmp_path / "e.csv").write_bytes(b"")
    (tmp_path / "f.csv").write_bytes(bytes(range(256)) * 20)
    (tmp_path / "g.csv.gz").write_bytes(b"nothing of the kind")
    registry, rejects = files.load_registry(spark, str(tmp_path))
    assert {(r["src_file"], r["reason"]) for r in rejects.filter("reason <> 'line'").collect()} == {("c.csv.gz", "ends early"), ("e.csv", "empty"), ("f.csv", "no text"), ("g.csv.gz", "ends early")}
    assert {r["src_file"]: r["n"] for r in registry.groupBy("src_file").agg(F.count("*").alias("n")).collect()} == {"a.csv": text[:200].count("\n") - 1, "b.csv.gz": 2990, "d.csv.gz": 2}
    (tmp_path / "none").mkdir()
    registry, rejects = files.load_registry(spark, str(tmp_path / "none"))
    assert registry.count() == rejects.count() == 0


def test_many_files_make_one_scan_for_each_header(spark, tmp_path):
    plans = []
    for n in (4, 120):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            (folder / f"{i:03}.csv").write_text(f"CASRN,NAME\n{i}-00-0,a\n" if i % 2 else f"Name,CAS,x\nb,{i}-00-0,\n")
        before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
        registry, _ = files.load_registry(spark, str(folder))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before)
        assert merged(registry) == {f"{i}-00-0": (None, "ba"[i % 2]) for i in range(n)}
        plans.append((registry._jdf.queryExecution().optimizedPlan().toString().count("Relation"), jobs))
    # Spark lists over 32 paths in a job of its own.
    assert plans[0][0] == plans[1][0] <= 3 and plans[1][1] <= plans[0][1] + 4


def test_split_files_keep_their_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("CASRN,NAME\n" + "".join(f"1-00-0,n{i}\n" for i in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        registry, _ = files.load_registry(spark, str(tmp_path))
        assert registry.rdd.getNumPartitions() > 3
        assert [r["preferred_name"] for r in registry.orderBy(*files.ORDER).collect()] == [f"n{i}" for i in range(20000)]
        assert merged(registry) == {"1-00-0": (None, "n0")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_csv_and_workbooks_in_one_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("CAS,NAME\n67-64-1,\n")
    book(tmp_path / "b.xlsx")
    (tmp_path / "c.csv").write_text("CAS,DTXSID,NAME\n67-64-1,D9,late\n64-17-5,D8,x\n")
    (tmp_path / "d.xls").write_text("old")
    (tmp_path / "e.xlsx").write_text("version https://git-lfs.github.com/spec/v1\noid sha256:0\nsize 1\n")
    registry, rejects = files.load_registry(spark, str(tmp_path))
    # The second sheet of the workbook isn't read; its first one comes before c.csv.
    assert merged(registry) == {"67-64-1": ("DTXSID1", "late"), "64-17-5": ("D8", "x")}
    assert sorted((r["src_file"], r["reason"]) for r in rejects.collect()) == [("d.xls", "no workbook"), ("e.xlsx", "placeholder")]
    assert registry.count() == 4 and rejects.count() == 2


def test_workbooks(spark, tmp_path):
    book(tmp_path / "x.xlsx")
    (tmp_path / "y.xls").write_text("old")
    with zipfile.ZipFile(tmp_path / "x.xlsx") as z, zipfile.ZipFile(tmp_path / "z.xlsx", "w") as broken:
        for n in z.namelist():
            broken.writestr(n, z.read(n)[:-30] if n.endswith("s1.xml") else z.read(n))
    got = workbooks.scan(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 5  # two sheets of each of two books, and a file that is none
    assert sorted((r["src_file"], r["sheet"], r["error"]) for r in got.filter("error is not null").collect()) == [("y.xls", None, "no workbook"), ("z.xlsx", "one", "broken: ParseError")]
    fields = workbooks.columns(got.filter("src_file = 'x.xlsx'"), R.ALIASES).select("sheet", "cas", "dtxsid").orderBy("sheet").collect()
    assert [tuple(r) for r in fields] == [("one", "67-64-1", "DTXSID1"), ("two", "64-17-5", None)]
    one = workbooks.scan(spark, str(tmp_path / "x.xlsx"), columns="dtxsid", sheets="first").collect()
    assert [(r["sheet"], r["header"], r["cells"]) for r in one] == [("one", ["DTXSID"], ["DTXSID1"])]
    with pytest.raises(Exception, match="FileNotFoundError|nowhere"):
        workbooks.scan(spark, str(tmp_path / "nowhere")).collect()


def test_books_are_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([(f"b{i % 3}", f"s{i % 2}", i, f"<{i}>" if i % 5 else None, "é") for i in range(60)], "book string, sheet string, o int, A string, B string")
    done = workbooks.write(df, str(tmp_path / "out"), "book", "sheet", "o", ["A", "B"])
    assert sorted(r["n"] for r in done.collect()) == [20, 20, 20]
    got = workbooks.scan(spark, str(tmp_path / "out"))
    assert got.rdd.getNumPartitions() == 6
    want = [(f"b{i % 3}.xlsx", f"s{i % 2}", [f"<{i}>" if i % 5 else None, "é"]) for i in range(60)]
    assert sorted(map(str, ((r["src_file"], r["sheet"], r["cells"]) for r in got.collect()))) == sorted(map(str, want))


def test_writers_count_what_they_write(spark, tmp_path, monkeypatch):
    registry = spark.createDataFrame([("1-00-0", "D1", "f", 1), ("1-00-0", "D2", "f", 2), ("2-00-0", None, "f", 3), ("3-00-0", "", "f", 4)], "cas string, dtxsid string, src_file string, row_idx int")
    done = tables.write_registry(registry, str(tmp_path / "r"))
    assert (done.rows, done.counts, done.table.count()) == (4, {"with_dtxsid": 3}, 4)
    assert done.bytes == sum(p.stat().st_size for p in (tmp_path / "r").glob("*.parquet"))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        done = tables.write_mapping(registry, str(tmp_path / "m"), ["src_file", "row_idx"])
    assert (done.rows, done.counts) == (3, {"with_dtxsid": 1})
    assert {r["CASRN"]: r["DTXSID"] for r in done.table.collect()}["1-00-0"] == "D1"
    monkeypatch.setattr(tables, "LARGE", 3)
    with pytest.warns(UserWarning, match="the mapping has"):
        tables.write_mapping(registry, str(tmp_path / "m"), ["src_file", "row_idx"])


def test_buckets_join_without_a_shuffle(spark, tmp_path):
    a = spark.range(500).selectExpr("concat('DTXSID', id % 50) as dtxsid", "id as x")
    b = spark.range(50).selectExpr("concat('DTXSID', id) as dtxsid", "id as y")
    left, right = (tables.write_buckets(df, str(tmp_path / n), "dtxsid", 4) for n, df in (("a", a), ("b", b)))
    assert (left.rows, right.rows) == (500, 50)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = V.toxvals_of(right.table, left.table)
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 500 and joined.filter("x % 50 <> y").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_report_is_read_back(spark, tmp_path):
    report = spark.createDataFrame([(f"{i % 7}", i, f' "q" {i},\n' if i % 3 else "", i / 3 if i % 4 else None) for i in range(200)], "CAS string, Row long, Text string, Dose double")
    done = tables.write_report(report, str(tmp_path / "r"), buckets=3, most=20)
    assert done.rows == 200 and sorted(map(str, done.table.collect())) == sorted(map(str, report.collect()))
    made = [p for p in (tmp_path / "r").rglob("*.csv")]
    assert len(made) >= 10 and all(p.read_text().startswith("CAS,Row,Text,Dose\n") for p in made)
    lost = report.withColumn("Text", F.when(F.col("Row") == 5, "\0").otherwise(F.col("Text")))
    with pytest.raises(RuntimeError, match="read back 200 or others"):
        tables.write_report(lost, str(tmp_path / "s"), buckets=3, most=20)


def test_json_reports_are_compressed(spark, tmp_path):
    reports = spark.range(200).selectExpr("cast(id as string) as cas", """concat('{"id":', id, ',"entries":[', repeat('{"exposure_pathway":"é","species":"rat"},', 99), '{}]}') as report""")
    want = sorted(r["report"] for r in reports.collect())
    for compression, most in (("gzip", 0.1), ("none", 1.1)):
        done = tables.write_json_reports(reports, str(tmp_path / compression), buckets=3, compression=compression)
        assert done.rows == 200 and sorted(r["report"] for r in done.table.collect()) == want
        assert done.bytes < most * sum(len(w.encode()) for w in want)
    assert tables.write_json_reports(reports, str(tmp_path / "default")).bytes < 0.1 * sum(map(len, want))


def test_rejects_and_counts_from_one_scan(spark, tmp_path):
    df = spark.createDataFrame([("67-64-1",), ("67-64-2",), ("x",), (None,)], "cas string")
    done = tables.write_rejects(df, str(tmp_path / "r"))
    assert (done.rows, done.counts) == (3, {"valid": 1, "bad_check": 1, "bad_format": 2})
    assert sorted((r["status"], r["cas"] or "") for r in done.table.collect()) == [("bad_check", "67-64-2"), ("bad_format", ""), ("bad_format", "x")]
    assert sorted(p.name for p in (tmp_path / "r").glob("status=*")) == ["status=bad_check", "status=bad_format"]


def test_hundreds_of_sheets(spark):
    rows = [(f"s{k}", [f"h{k}", "id", "id"], [f"v{k}{i}", str(i), "second"][: 3 - i]) for k in range(300) for i in range(2)]
    got = V.union_rows(spark.createDataFrame(rows, "src string, header array<string>, cells array<string>"))
    assert got.columns == ["src", *sorted([*(f"h{k}" for k in range(300)), "id"])]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("\n") < 10
    assert sorted((r["src"], r["id"], r[f"h{r['src'][1:]}"], sum(x is not None for x in r)) for r in got.collect()) == sorted((f"s{k}", str(i), f"v{k}{i}", 3) for k in range(300) for i in range(2))


def test_sketches(spark):
    rows = spark.range(40000).selectExpr("id % 5 as load", "case when id % 10 = 9 then null else concat('c', id % 20000) end as c")
    kept = V.sketches(rows, "load", "c")
    once = V.merged_sketches(kept, F.lit("all").alias("name"))
    again = V.merged_sketches(V.merged_sketches(kept, F.when(F.col("name") < 2, "a").otherwise("b").alias("name")), F.lit("all").alias("name"))
    (one,), (two,) = V.sketch_counts(once).collect(), V.sketch_counts(again).collect()
    assert one == two and one["rows"] == 40000 and abs(one["chemicals"] - 18000) < 0.05 * 18000


def test_whole_documents(spark, tmp_path):
    (tmp_path / "7.json").write_text('{"Record":{}}')
    assert [tuple(r) for r in files.scan_documents(spark, str(tmp_path)).collect()] == [("7", '{"Record":{}}')]


def test_many_sheets_share_partitions(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(f"b{i:02}", f"s{i % 2}", i, str(i)) for i in range(40)], "book string, sheet string, o int, A string")
    workbooks.write(df, str(tmp_path / "out"), "book", "sheet", "o", ["A"])
    monkeypatch.setattr(workbooks, "TASKS", 7, raising=False)
    got = workbooks.WorkbookReader({"path": str(tmp_path / "out")}).partitions()
    assert len(got) == 7 and [s.uri.rpartition("/")[2] for p in got for s in p.own] == [f"b{i:02}.xlsx" for i in range(40)]
    assert sorted(r["cells"][0] for r in workbooks.scan(spark, str(tmp_path / "out")).collect()) == sorted(str(i) for i in range(40))
