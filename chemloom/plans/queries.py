"""One registered query for each operator of the reference's domain, over tables derived from the driver's."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cas
from ..functions import text as T
from ..operators import annotations as A
from ..operators import dossier as D
from ..operators import endpoints as E
from ..operators import ghs as G
from ..operators import registry as R
from ..operators import toxvals as V
from ..sources import files, tables, workbooks
from ..sources.landing import land, scratch
from .fixtures import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
ORDER = ["src_file", "row_idx"]


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL over the given views."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


# Inputs that several queries share.


def registry_source(s: SparkSession, d: str, **given: DataFrame) -> DataFrame:
    """The registry files' rows under the ten fields, raw."""
    return R.conform_registry(R.resolve_aliases(view(s, d, "registry_raw", **given).drop("k")))


def registry_clean(s: SparkSession, d: str, **given: DataFrame) -> DataFrame:
    return R.scrub_nulls(registry_source(s, d, **given), R.FIELDS)


def registry_merged(s: SparkSession, d: str, **given: DataFrame) -> DataFrame:
    return R.merge_registry(registry_clean(s, d, **given), ORDER)


def landed_registry(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """The raw registry as a table, for queries that read it several times: its long expressions are computed once."""
    return {"registry_raw": land(view(s, d, "registry_raw"))}


def toxvals(s: SparkSession, d: str) -> DataFrame:
    return V.coerce_numeric(view(s, d, "toxval_raw"))


#: Rows of toxicity values or sentences that one task sorts together, about.
STRETCH = 500_000
#: The chemical of a line.
CHEMICAL = "cast(floor(l_partkey / 2.0) as bigint)"


def dealt(df: DataFrame, rows: int, *keys: Column | str) -> DataFrame:
    """df in tasks by the keys, as many as its rows need, if the session's number of tasks is less: a task's memory doesn't grow with the table."""
    n = rows // STRETCH + 1
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def dealt_toxvals(s: SparkSession, d: str) -> DataFrame:
    """Toxicity values in tasks by substance, numbered in tasks by chemical."""
    lines = view(s, d, "lineitem")
    n = lines.count()  # from the files' footers
    return dealt(V.coerce_numeric(view(s, d, "toxval_raw", lineitem=dealt(lines, n, F.expr(CHEMICAL)))), n, "dtxsid")


def sentences(s: SparkSession, d: str) -> DataFrame:
    """Toxicity sentences, dealt to tasks by chemical before they are numbered: what then groups or joins them by k finds them there, and
    queries that read them several times share the one shuffle."""
    lines = view(s, d, "lineitem")
    n = max(lines.count() // STRETCH + 1, int(s.conf.get("spark.sql.shuffle.partitions")))  # the count is from the files' footers
    return view(s, d, "tox_text", lineitem=lines.repartition(n, F.expr(CHEMICAL)))


def mined(s: SparkSession, d: str) -> DataFrame:
    return E.mine(sentences(s, d))


def endpoints(s: SparkSession, d: str) -> DataFrame:
    return E.union_endpoints(mined(s, d).withColumnRenamed("k", "chem"), toxvals(s, d).withColumnRenamed("k", "chem"))


def of_chemical(parts: DataFrame) -> DataFrame:
    """Adds k, the chemical of a part, and at, the place of a part's item among those of its chemical."""
    return parts.withColumns({"k": F.floor(F.col("p_partkey") / 2).cast("long"), "at": F.struct("p_partkey", "item")})


def documents(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, doc): one nested annotation document for each chemical, made of its sentences, statements and metrics."""
    item = lambda name, value: F.struct(name.alias("Name"), F.struct(F.array(F.struct(value.alias("String"), F.array(F.struct(F.concat(F.lit("https://example.org/"), F.md5(value)).alias("URL"), F.when(name == "Pictogram(s)", value).alias("Extra"))).alias("Markup"))).alias("StringWithMarkup")).alias("Value"))
    # Lists are gathered as plain values; items are made of them afterwards.
    by = lambda df, key, at, name, value, out: df.groupBy(F.col(key).alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("o"), name.alias("n"), value.alias("v")))).alias(out))
    made = lambda c: F.transform(c, lambda x: item(x["n"], x["v"]))
    some = lambda c, keep: T.once(F.filter(c, keep), lambda l: F.when(F.size(l) > 0, made(l)))
    texts = by(sentences(s, d), "k", "ordinal", F.col("type"), F.col("value"), "all")
    texts = texts.select("doc_id", some("all", lambda x: x["o"] > 1).alias("tox"), some("all", lambda x: x["o"] == 1).alias("first"))
    names = F.element_at(F.create_map(F.lit("H"), F.lit("GHS Hazard Statements"), F.lit("P"), F.lit("Precautionary Statement Codes"), F.lit("S"), F.lit("Signal"), F.lit("G"), F.lit("Pictogram(s)")), F.col("kind"))
    codes = by(of_chemical(view(s, d, "ghs_text")), "k", "at", names, F.col("txt"), "ghs").withColumn("ghs", made("ghs"))
    metrics = by(of_chemical(view(s, d, "metric_text")), "k", "at", F.col("name"), F.col("txt"), "met").withColumn("met", made("met"))
    # The many sentences are joined last, where their window left them: they aren't shuffled again.
    rows = texts.join(codes.join(metrics, "doc_id", "full"), "doc_id", "full")
    leaf = lambda heading, info: F.struct(F.lit(heading).alias("TOCHeading"), F.col(info).alias("Information"))
    untitled = F.struct(F.lit("").alias("TOCHeading"), F.col("tox").alias("Information"))
    safety = F.struct(F.lit("Safety and Hazards").alias("TOCHeading"), F.array(F.struct(F.lit("Identification").alias("TOCHeading"), F.array(leaf("GHS Classification", "ghs")).alias("Section"))).alias("Section"))
    toxic = F.struct(F.lit("Toxicity").alias("TOCHeading"), F.col("first").alias("Information"), F.array(untitled).alias("Section"))
    props = F.struct(F.lit("Properties").alias("TOCHeading"), F.array(leaf("Experimental", "met")).alias("Section"))
    doc = F.concat(F.lit('{"Record":{"Section":['), F.concat_ws(",", F.to_json(safety), F.to_json(toxic), F.to_json(props)), F.lit("]}}"))
    return rows.select("doc_id", doc.alias("doc"))


def items(s: SparkSession, d: str) -> DataFrame:
    return A.flatten(documents(s, d))


# Sources.

_DUCK_ITEMS = """items as (select k as doc_id, type as name, value as text, 'Toxicity' as heading, case when ordinal = 1 then 'Toxicity' else '' end as own_heading from tox_text
    union all select cast(floor(p_partkey / 2.0) as bigint), case kind when 'H' then 'GHS Hazard Statements' when 'P' then 'Precautionary Statement Codes' when 'S' then 'Signal' else 'Pictogram(s)' end, txt, 'GHS Classification', 'GHS Classification' from ghs_text
    union all select cast(floor(p_partkey / 2.0) as bigint), name, txt, 'Experimental', 'Experimental' from metric_text)"""
_ITEM_VIEWS = ("tox_text", "ghs_text", "metric_text")


@query("select casrn, nullif(dtxsid, 'nan') as dtxsid, nullif(preferred_name, '') as preferred_name, molecular_formula, average_mass, row_idx from registry_raw", "registry_raw")
def scan_registry_csv_na(s: SparkSession, d: str) -> DataFrame:
    raw = view(s, d, "registry_raw")
    text = ["casrn", "dtxsid", "preferred_name", "molecular_formula", "average_mass"]
    return raw.select(*[R.na_to_null(F.col(c)).alias(c) for c in text], "row_idx")


@query(
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    coalesce(r ->> '$.studyType', r ->> '$.study_type') as study_type, cast(coalesce(r ->> '$.toxValNumeric', r ->> '$.toxval_numeric') as double) as value,
    coalesce(r ->> '$.toxValUnits', r ->> '$.toxval_units') as units, coalesce(r ->> '$.species', r ->> '$.speciesName', '') as species, coalesce(r ->> '$.exposureRoute', r ->> '$.exposure_route', '') as route, coalesce(r ->> '$.reference', r ->> '$.citation', '') as reference, case when r ->> '$.studyType' is null then 'ecotoxicity' else 'acute_toxicity' end as category
    from (select *, case when payload like '[%' then json_extract(payload, '$[0]') else json_extract(payload, '$.data[0]') end as r from payloads) x""",
    "payloads",
)
def scan_toxval_payloads(s: SparkSession, d: str) -> DataFrame:
    return V.read_payloads(view(s, d, "payloads"))


_DUCK_MW, _DUCK_NAME = "coalesce(printf('%.2f', mw), mw_text)", "coalesce(iupac_name, iupac_name_legacy)"


@query(f"select cid, coalesce(smiles, isomeric_smiles, canonical_smiles) as smiles, formula, {_DUCK_MW} as mw, {_DUCK_NAME} as iupac_name from compound", "compound")
def scan_compounds(s: SparkSession, d: str) -> DataFrame:
    return D.compounds(view(s, d, "compound"))


@query("select 'registry' as name, count(*) as n from registry_raw union all select 'toxvals', count(*) from toxval_raw", "registry_raw", "toxval_raw")
def scan_tables(s: SparkSession, d: str) -> DataFrame:
    one = lambda n, v: view(s, d, v).agg(F.lit(n).alias("name"), F.count("*").alias("n"))
    return one("registry", "registry_raw").unionByName(one("toxvals", "toxval_raw"))


@query("select casrn, dtxsid, preferred_name, molecular_formula, average_mass, count(*) as n from registry_raw group by all", "registry_raw")
def scan_registry_csv(s: SparkSession, d: str) -> DataFrame:
    """The registry written as CSV files and scanned as text: nothing, not even 'nan' or an empty name, is read as null."""
    path = scratch(s)
    names = ["casrn", "dtxsid", "preferred_name", "molecular_formula", "average_mass"]
    view(s, d, "registry_raw").select(*names).write.option("header", True).option("emptyValue", "").csv(path)
    found = files.scan_csv(s, path)
    return found.select(*[F.coalesce(c, F.lit("")).alias(c) for c in names]).groupBy(*names).agg(F.count("*").alias("n"))


@query("also " + _DUCK_ITEMS + " select doc_id, own_heading, heading, name, text, count(*) as n from items group by all", *_ITEM_VIEWS)
def scan_annotations(s: SparkSession, d: str) -> DataFrame:
    """Annotation documents landed as JSON lines and read back: the items of their trees are those that went in."""
    path = scratch(s)
    documents(s, d).write.json(path)
    found = A.flatten(s.read.schema("doc_id bigint, doc string").json(path)).withColumn("text", F.coalesce(F.get_json_object("raw", "$.StringWithMarkup[0].String"), "raw"))
    return found.groupBy("doc_id", "own_heading", "heading", "name", "text").agg(F.count("*").alias("n"))


@query("select concat('b', cast(row_idx // 600 as bigint), '.xlsx') as src_file, src_file as sheet, cast(row_number() over (partition by row_idx // 600, src_file order by row_idx) - 1 as bigint) as row_idx, casrn as cas, dtxsid, nullif(preferred_name, '') as preferred_name, molecular_formula from registry_raw", "registry_raw")
def scan_workbooks(s: SparkSession, d: str) -> DataFrame:
    """The registry as workbooks of 600 rows in three sheets, scanned with a task for each sheet and read by their headers."""
    folder = scratch(s)
    raw = view(s, d, "registry_raw").withColumnRenamed("molecular_formula", "formula").withColumn("book", F.concat(F.lit("b"), F.floor(F.col("row_idx") / 600).cast("string")))
    workbooks.write(raw, folder, "book", "src_file", "row_idx", ["casrn", "dtxsid", "preferred_name", "formula"])
    return workbooks.columns(workbooks.scan(s, folder), R.ALIASES).select("src_file", "sheet", "row_idx", "cas", "dtxsid", "preferred_name", "molecular_formula")


def registry_folder(s: SparkSession, d: str) -> str:
    """A folder of registry files: f0 as CSV with one header, f1 as CSV with another, f2 as workbooks of 500 rows."""
    folder = scratch(s)
    raw = view(s, d, "registry_raw")
    csv = lambda name, df: df.coalesce(1).write.option("header", True).option("emptyValue", "").csv(f"{folder}/{name}")
    own = lambda n: raw.filter(f"src_file = '{n}'").sortWithinPartitions("row_idx")
    csv("f0", own("f0").select("casrn", "dtxsid", "preferred_name", "molecular_formula", "average_mass"))
    csv("f1", own("f1").select(F.col("average_mass").alias("AVG_MASS"), F.col("casrn").alias("Cas Number"), F.col("preferred_name").alias("name"), F.col("dtxsid").alias("DTXCID"), F.col("molecular_formula").alias("mf")))
    f2 = own("f2").withColumn("book", F.format_string("f2-%06d", F.floor(F.col("row_idx") / 1500).cast("long"))).withColumn("sheet", F.lit("one"))
    workbooks.write(f2, f"{folder}/f2", "book", "sheet", "row_idx", ["casrn", "dtxsid", "preferred_name", "molecular_formula", "average_mass"])
    return folder


@query(
    "select src_file, casrn as cas, case when src_file = 'f2' then nullif(dtxsid, 'nan') else dtxsid end as dtxsid, nullif(preferred_name, '') as preferred_name, molecular_formula, average_mass, cast(row_number() over (partition by src_file order by row_idx) as bigint) as place from registry_raw",
    "registry_raw",
)
def load_registry_folder(s: SparkSession, d: str) -> DataFrame:
    """CSV files of two headers and workbooks, loaded under the ten fields, every row at its place in its file's order."""
    folder = registry_folder(s, d)
    found = [files.load_registry(s, f"{folder}/{n}")[0].withColumn("src_file", F.lit(n)).withColumn("file", F.col("src_file")) for n in ("f0", "f1")]
    books = files.load_registry(s, f"{folder}/f2")[0].withColumn("file", F.col("src_file")).withColumn("src_file", F.lit("f2"))
    place = F.row_number().over(Window.partitionBy("src_file").orderBy("file", "block", "row_idx"))
    rows = reduce(DataFrame.unionByName, [*found, books]).withColumn("place", place.cast("long"))
    return rows.select("src_file", "cas", "dtxsid", F.nullif(F.col("preferred_name"), F.lit("")).alias("preferred_name"), "molecular_formula", "average_mass", "place")


# Projections.

_CLEAN = """select casrn as cas, nullif(dtxsid, 'nan') as dtxsid, nullif(trim(preferred_name), '') as preferred_name, cast(null as varchar) as systematic_name,
    molecular_formula, average_mass, cast(null as varchar) as monoisotopic_mass, cast(null as varchar) as inchi, cast(null as varchar) as inchikey, cast(null as varchar) as smiles, src_file, row_idx from registry_raw"""
_RAW = _CLEAN.replace("nullif(dtxsid, 'nan') as ", "").replace("nullif(trim(preferred_name), '') as ", "")
_MERGED = "clean as (" + _CLEAN + """), merged as (select cas, arg_min(dtxsid, row(src_file, row_idx)) filter (dtxsid is not null) as dtxsid,
    arg_min(preferred_name, row(src_file, row_idx)) filter (preferred_name is not null) as preferred_name,
    arg_min(molecular_formula, row(src_file, row_idx)) as molecular_formula, arg_min(average_mass, row(src_file, row_idx)) as average_mass from clean group by cas)"""


@query("select casrn as cas, dtxsid, preferred_name, molecular_formula, average_mass, src_file, row_idx, k from registry_raw", "registry_raw")
def resolve_aliases(s: SparkSession, d: str) -> DataFrame:
    return R.resolve_aliases(view(s, d, "registry_raw"))


@query(_RAW, "registry_raw")
def conform_registry(s: SparkSession, d: str) -> DataFrame:
    return registry_source(s, d)


@query(_CLEAN, "registry_raw")
def scrub_nulls(s: SparkSession, d: str) -> DataFrame:
    return registry_clean(s, d)


@query("select k, ordinal, try_cast(nullif(toxval_numeric, 'n/a') as double) as toxval_numeric from toxval_raw", "toxval_raw")
def coerce_numeric(s: SparkSession, d: str) -> DataFrame:
    return toxvals(s, d).select("k", "ordinal", "toxval_numeric")


@query("select k, ordinal, cast(toxval_numeric as double) as toxval_numeric, study_type from toxval_raw where toxval_numeric <> 'n/a'", "toxval_raw")
def numeric_only(s: SparkSession, d: str) -> DataFrame:
    return V.numeric_only(toxvals(s, d)).select("k", "ordinal", "toxval_numeric", "study_type")


# Tables and files that are written: what is read back equals what went in.


@query("also " + _MERGED + " select cas, dtxsid, replace(replace(cas, '-', ''), ' ', '') as cas_key from merged", "registry_raw")
def write_registry(s: SparkSession, d: str) -> DataFrame:
    return tables.write_registry(registry_merged(s, d), scratch(s)).table.select("cas", "dtxsid", "cas_key")


@query("select dtxsid, ordinal, study_type, try_cast(nullif(toxval_numeric, 'n/a') as double) as toxval_numeric from toxval_raw", "toxval_raw")
def write_toxvals(s: SparkSession, d: str) -> DataFrame:
    return tables.write_toxvals(toxvals(s, d), scratch(s)).table.select("dtxsid", "ordinal", "study_type", "toxval_numeric")


@query('select casrn as "CASRN", arg_min(dtxsid, row(src_file, row_idx)) as "DTXSID" from registry_raw group by casrn', "registry_raw")
def write_mapping_csv(s: SparkSession, d: str) -> DataFrame:
    raw = view(s, d, "registry_raw").withColumnRenamed("casrn", "cas")
    return tables.write_mapping(raw, scratch(s), ORDER).table


@query(
    "also " + _MERGED + """ select 'registry' as name, count(*) as n, count(dtxsid) as counted, true as has_bytes, false as large from merged
    union all select 'toxvals', count(*), count(try_cast(nullif(toxval_numeric, 'n/a') as double)), true, false from toxval_raw union all select 'mapping', count(*), count(*), true, false from merged""",
    "registry_raw", "toxval_raw",
)
def write_counts(s: SparkSession, d: str) -> DataFrame:
    """What the three writers count while they write: rows, rows with an id or a number, and whether files are over the warning's size."""
    raw = view(s, d, "registry_raw").withColumnRenamed("casrn", "cas")
    done = {"registry": tables.write_registry(registry_merged(s, d), scratch(s)), "toxvals": tables.write_toxvals(toxvals(s, d), scratch(s)), "mapping": tables.write_mapping(raw, scratch(s), ORDER)}
    return s.createDataFrame([(n, w.rows, next(iter(w.counts.values())), w.bytes > 0, w.bytes > tables.LARGE) for n, w in done.items()], "name string, n long, counted long, has_bytes boolean, large boolean")


@query("also " + _MERGED + " select m.cas, t.dtxsid, t.ordinal, t.study_type, try_cast(nullif(t.toxval_numeric, 'n/a') as double) as toxval_numeric from merged m join toxval_raw t on t.dtxsid = m.dtxsid", "registry_raw", "toxval_raw")
def toxvals_by_cas_of_buckets(s: SparkSession, d: str) -> DataFrame:
    """Both tables written in buckets of the substance id, then joined where the buckets lie."""
    registry = tables.write_buckets(registry_merged(s, d).select("cas", "dtxsid"), scratch(s), "dtxsid", 8).table
    values = tables.write_buckets(toxvals(s, d), scratch(s), "dtxsid", 8, "study_type").table
    return V.toxvals_of(registry, values).select("cas", "dtxsid", "ordinal", "study_type", "toxval_numeric")


@query(r"select casrn as cas, src_file, row_idx, case when not regexp_matches(casrn, '^\d{1,9}-\d{2}-\d$') then 'bad_format' else 'bad_check' end as status from registry_raw where k % 7 = 0 or not regexp_matches(casrn, '^\d{1,9}-\d{2}-\d$')", "registry_raw")
def write_rejects(s: SparkSession, d: str) -> DataFrame:
    raw = view(s, d, "registry_raw").select(F.col("casrn").alias("cas"), "src_file", "row_idx")
    return tables.write_rejects(raw, scratch(s)).table


@query(r"select case when not regexp_matches(casrn, '^\d{1,9}-\d{2}-\d$') then 'bad_format' when k % 7 = 0 then 'bad_check' else 'valid' end as status, count(*) as n from registry_raw group by 1", "registry_raw")
def rejects_audit(s: SparkSession, d: str) -> DataFrame:
    """Rows of every status, counted by the scan that writes the rejects."""
    counts = tables.write_rejects(view(s, d, "registry_raw").select(F.col("casrn").alias("cas")), scratch(s)).counts
    return s.createDataFrame([(k, n) for k, n in counts.items() if n], "status string, n long")


# Identifiers.

@query(r"select query, regexp_matches(trim(query), '^\d{1,9}-\d{2}-\d$') as is_cas, count(*) as n from queries group by 1, 2", "queries")
def cas_format_audit(s: SparkSession, d: str) -> DataFrame:
    q = view(s, d, "queries")
    return q.groupBy("query", cas.is_cas(F.col("query")).alias("is_cas")).agg(F.count("*").alias("n"))


@query(
    r"""select src_file, case when not regexp_matches(casrn, '^\d{1,9}-\d{2}-\d$') then 'bad_format' when k % 7 = 0 then 'bad_check' else 'valid' end as status, count(*) as n from registry_raw group by 1, 2""",
    "registry_raw",
)
def cas_validate_audit(s: SparkSession, d: str) -> DataFrame:
    return R.cas_audit(view(s, d, "registry_raw"), "casrn", "src_file")


@query(r"select row_idx, coalesce(nullif(regexp_extract(trim(query), '(?:^|\s)[(,]*(\d{1,9}-\d{2}-\d)[),]*(?:\s|$)', 1), ''), trim(query)) as found from queries", "queries")
def cas_extract(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "queries").select("row_idx", cas.first_cas(F.col("query")).alias("found"))


@query(r"select row_idx, case when regexp_matches(trim(query), '^\d{1,9}-\d{2}-\d$') then 'cas' else 'name' end as kind from queries", "queries")
def classify_query_type(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "queries").select("row_idx", F.when(cas.is_cas(F.col("query")), "cas").otherwise("name").alias("kind"))


# Look-ups.


@query(
    "also " + _MERGED + """, every as (select *, replace(replace(cas, '-', ''), ' ', '') as cas_key from (select cas, dtxsid, preferred_name, molecular_formula, average_mass from merged
        union all select casrn, concat('RIVAL', k), 'rival', null, null from registry_rivals) m),
    asked as (select row_idx, query from queries union all select k, casrn from registry_rivals),
    best as (select q, arg_min(row(cas, dtxsid, preferred_name, molecular_formula, average_mass), row(cas <> q, cas)) as r from (select distinct query as q from asked) a join every on cas_key = replace(replace(q, '-', ''), ' ', '') group by q)
    select row_idx, query, r[1] as cas, r[2] as dtxsid, r[3] as preferred_name, r[4] as molecular_formula, r[5] as average_mass from asked left join best on q = query""",
    "registry_raw", "queries", "registry_rivals",
)
def lookup_registry_by_cas(s: SparkSession, d: str) -> DataFrame:
    """Numbers in several forms; one chemical in four has a rival with the same digits, so the exact number has to win."""
    given = landed_registry(s, d)
    rivals = view(s, d, "registry_rivals", **given)
    fields = ["cas", "dtxsid", "preferred_name", "molecular_formula", "average_mass"]
    none = F.lit(None).cast("string")
    others = rivals.select(F.col("casrn").alias("cas"), F.concat(F.lit("RIVAL"), F.col("k").cast("string")).alias("dtxsid"), F.lit("rival").alias("preferred_name"), none.alias("molecular_formula"), none.alias("average_mass"))
    every = registry_merged(s, d, **given).select(*fields).unionByName(others).withColumn("ordinal", F.col("cas"))
    asked = view(s, d, "queries", **given).unionByName(rivals.select(F.col("k").alias("row_idx"), F.col("casrn").alias("query")))
    return R.lookup_by_cas(asked, every, ["ordinal"])


_TWO = ", ".join(f"arg_min({f}, row(src_file, row_idx)) as {f}" for f in ("cas", "molecular_formula"))


@query(
    f"also clean as ({_CLEAN}), one as (select dtxsid, {_TWO} from clean where dtxsid is not null group by dtxsid) select q.k, q.query, o.cas, o.molecular_formula from (select distinct k, dtxsid as query from toxval_raw) q left join one o on o.dtxsid = q.query",
    "registry_raw", "toxval_raw",
)
def lookup_registry_by_dtxsid(s: SparkSession, d: str) -> DataFrame:
    q = view(s, d, "toxval_raw").select("k", F.col("dtxsid").alias("query")).distinct()
    return R.lookup_by_dtxsid(q, registry_clean(s, d).select("dtxsid", "cas", "molecular_formula", *ORDER), ORDER).drop("dtxsid")


@query("select t.dtxsid, row_number() over (partition by t.dtxsid order by t.study_type nulls first, t.ordinal) as place, t.ordinal, t.study_type, try_cast(nullif(t.toxval_numeric, 'n/a') as double) as toxval_numeric, t.toxval_units from toxval_raw t join (select distinct dtxsid from registry_raw) q on q.dtxsid = t.dtxsid", "toxval_raw", "registry_raw")
def lookup_toxvals(s: SparkSession, d: str) -> DataFrame:
    q = view(s, d, "registry_raw").select("dtxsid").distinct()
    return V.in_study_order(V.toxvals_of(q, dealt_toxvals(s, d).drop("k")), "ordinal").select("dtxsid", "place", "ordinal", "study_type", "toxval_numeric", "toxval_units")


@query(
    "also " + _MERGED + " select m.cas, t.dtxsid, t.ordinal, t.study_type, try_cast(nullif(t.toxval_numeric, 'n/a') as double) as toxval_numeric from merged m join toxval_raw t on t.dtxsid = m.dtxsid",
    "registry_raw", "toxval_raw",
)
def toxvals_by_cas(s: SparkSession, d: str) -> DataFrame:
    return V.toxvals_of(registry_merged(s, d).select("cas", "dtxsid"), toxvals(s, d)).select("cas", "dtxsid", "ordinal", "study_type", "toxval_numeric")


@query(
    "select q.row_idx, q.kind, q.query, x.cid from (select row_idx, 'cas' as kind, casrn as query from registry_raw union all select p_partkey, 'name', p_name from part) q left join (select identifier_type, identifier, arg_min(cid, row(ordinal, cid)) as cid from xref group by 1, 2) x on x.identifier_type = q.kind and x.identifier = q.query",
    "registry_raw", "xref",
)
def resolve_compound(s: SparkSession, d: str) -> DataFrame:
    a = view(s, d, "registry_raw").select("row_idx", F.lit("cas").alias("kind"), F.col("casrn").alias("query"))
    b = view(s, d, "part").select(F.col("p_partkey").alias("row_idx"), F.lit("name").alias("kind"), F.col("p_name").alias("query"))
    return D.resolve(a.unionByName(b), view(s, d, "xref"), "kind").select("row_idx", "kind", "query", "cid")


@query("also " + _MERGED + " select cas, dtxsid, preferred_name from merged", "registry_raw")
def registry_simple(s: SparkSession, d: str) -> DataFrame:
    return R.registry_simple(registry_merged(s, d))


# Set operations.


@query("select dtxsid, study_type, toxval_units, cast(null as varchar) as casrn, cast(null as varchar) as average_mass from toxval_raw union all select dtxsid, null, null, casrn, average_mass from registry_raw", "toxval_raw", "registry_raw")
def union_sheets(s: SparkSession, d: str) -> DataFrame:
    return V.union_sheets([view(s, d, "toxval_raw").select("dtxsid", "study_type", "toxval_units"), view(s, d, "registry_raw").select("dtxsid", "casrn", "average_mass")])


@query("select dtxsid, study_type, " + ", ".join(f"case when k % 40 = {i} then toxval_units end as extra{i}" for i in range(40)) + " from toxval_raw", "toxval_raw")
def union_many_sheets(s: SparkSession, d: str) -> DataFrame:
    """Forty kinds of sheets, each with a column of its own, in one pass over their rows."""
    extra = F.concat(F.lit("extra"), (F.col("k") % 40).cast("string"))
    rows = view(s, d, "toxval_raw").select(F.array(F.lit("study_type"), extra, F.lit("dtxsid")).alias("header"), F.array("study_type", "toxval_units", "dtxsid").alias("cells"))
    return V.union_rows(rows, ["dtxsid", "study_type", *(f"extra{i}" for i in range(40))])


_DUCK_TOKENS = r"regexp_extract_all(value, '(?i)\b(rat|mouse|rabbit|dog|guinea pig|human|oral|dermal|inhalation|ip|iv|sc|ld50|lc50|fish|trout|daphnia|algae|aquatic)\b', 1)"
_DUCK_UNIT = r"nullif(regexp_extract(value, '(mg/kg|mg/m³|ppm|g/kg|mL/kg|mg/L|µg/kg|mg/m3|ppb)(?:[^\p{L}\p{N}_]|$)', 1, 'i'), '')"
_DUCK_ROUTE = """case when regexp_matches(lower(value), 'fish|trout|daphnia|algae|aquatic') then 'Ecotoxicity (aquatic)'
    when regexp_matches(lower(value), 'dermal|skin') then 'Dermal' when regexp_matches(lower(value), 'inhalation|inhaled|mg/m|ppm') then 'Inhalation'
    when regexp_matches(lower(value), 'oral|po |rat') then 'Oral' else 'Other' end"""
_DUCK_SPECIES = f"""case when len(sp) > 0 then array_to_string(sp, ', ')
    when route = 'Ecotoxicity (aquatic)' then case when regexp_matches(lower(value), 'fish|trout') then 'fish' when contains(lower(value), 'daphnia') then 'Daphnia' when contains(lower(value), 'algae') then 'algae' else 'aquatic' end
    when route in ('Dermal', 'Inhalation', 'Oral') and contains(lower(value), 'rat') then 'rat' else '—' end"""
_DUCK_MINED = f"""mined as (select *, {_DUCK_SPECIES} as species from (select *, list_filter(low, lambda x, i: list_position(low, x) = i and x not in ('oral', 'dermal', 'inhalation', 'ip', 'iv', 'sc', 'ld50', 'lc50')) as sp
    from (select *, {_DUCK_UNIT} as unit, {_DUCK_ROUTE} as route, list_transform({_DUCK_TOKENS}, lambda x: lower(x)) as low from tox_text) a) b)"""
_DUCK_ENDS = _DUCK_MINED + """, ends as (select k as chem, ordinal, 'PubChem' as source, case when trim(type) = '' then 'Toxicity' else trim(type) end as endpoint, value, cast(null as double) as value_num, unit, species, route, source_section as details from mined
    union all select k, ordinal, 'ToxValDB', study_type, coalesce(cast(try_cast(nullif(toxval_numeric, 'n/a') as double) as varchar), ''), try_cast(nullif(toxval_numeric, 'n/a') as double), toxval_units, null, null, '' from toxval_raw)"""


@query("also " + _DUCK_ENDS + " select * from ends", "tox_text", "toxval_raw")
def union_endpoints(s: SparkSession, d: str) -> DataFrame:
    return endpoints(s, d)


@query("select casrn, arg_min(dtxsid, row(src_file, row_idx)) as dtxsid, arg_min(row_idx, row(src_file, row_idx)) as row_idx from registry_raw group by casrn", "registry_raw")
def dedupe_keep_first(s: SparkSession, d: str) -> DataFrame:
    raw = view(s, d, "registry_raw").select("casrn", "dtxsid", *ORDER)
    return R.keep_first(raw, "casrn", ORDER).drop("src_file")


@query("also " + _MERGED + " select * from merged", "registry_raw")
def coalesce_merge_registry(s: SparkSession, d: str) -> DataFrame:
    return registry_merged(s, d).select("cas", "dtxsid", "preferred_name", "molecular_formula", "average_mass")


# Aggregations.

_NUM = "try_cast(nullif(toxval_numeric, 'n/a') as double)"
_SUM = f"count(*) as record_count, count({_NUM}) as numeric_count, min({_NUM}) as min_value, max({_NUM}) as max_value"


@query("also " + _MERGED + f" select m.cas, t.study_type, {_SUM} from merged m join toxval_raw t on t.dtxsid = m.dtxsid group by 1, 2", "registry_raw", "toxval_raw")
def toxicity_summary(s: SparkSession, d: str) -> DataFrame:
    """The flagship: toxicity records of every registry chemical by study type."""
    t = V.toxvals_of(registry_merged(s, d).select("cas", "dtxsid"), toxvals(s, d).select("dtxsid", "study_type", "toxval_numeric"))
    return V.summary(t, ["cas", "study_type"])


@query(
    "also " + _MERGED + f", sums as (select m.cas, t.study_type, {_SUM} from merged m join toxval_raw t on t.dtxsid = m.dtxsid group by 1, 2) select *, row_number() over (partition by cas order by record_count desc, study_type nulls last) as place from sums",
    "registry_raw", "toxval_raw",
)
def sort_summary(s: SparkSession, d: str) -> DataFrame:
    return V.in_summary_order(toxicity_summary(s, d), "cas")


@query("select 'registry' as \"table\", count(*) as rows, count(distinct dtxsid) as chemicals from registry_raw union all select 'toxvals', count(*), count(distinct dtxsid) from toxval_raw", "registry_raw", "toxval_raw")
def table_stats(s: SparkSession, d: str) -> DataFrame:
    return V.table_stats(view(s, d, "toxval_raw"), view(s, d, "registry_raw"))


@query(
    "select src_file as name, count(*) as n, true as near from registry_raw group by 1 union all select 'all', count(*), true from registry_raw union all select 'merged again', count(*), true from registry_raw",
    "registry_raw",
)
def table_sketches(s: SparkSession, d: str) -> DataFrame:
    """Rows and about how many chemicals each source has, kept as sketches; all sources' from their union, once more from a union of
    unions. near: within 5 % of the exact count."""
    raw = view(s, d, "registry_raw")
    kept = land(V.sketches(raw, "src_file", "dtxsid"))
    whole = V.merged_sketches(kept, F.lit("all").alias("name"))
    parts = V.merged_sketches(kept, F.when(F.col("name") == "f0", "f0").otherwise("rest").alias("name"))
    told = V.sketch_counts(kept.unionByName(whole).unionByName(V.merged_sketches(parts, F.lit("merged again").alias("name"))))
    exact = raw.groupBy(F.col("src_file").alias("name")).agg(F.countDistinct("dtxsid").alias("x")).unionByName(raw.agg(F.countDistinct("dtxsid").alias("x")).select(F.explode(F.array(F.lit("all"), F.lit("merged again"))).alias("name"), "x"))
    return told.join(exact, "name").select("name", F.col("rows").alias("n"), (F.abs(F.col("chemicals") - F.col("x")) <= 0.05 * F.col("x")).alias("near"))


@query("also " + _MERGED + " select count(*) as total, count(dtxsid) as with_dtxsid, count(preferred_name) as with_preferred_name, count(molecular_formula) as with_molecular_formula, count(average_mass) as with_average_mass, cast(0 as bigint) as with_smiles from merged", "registry_raw")
def registry_completeness(s: SparkSession, d: str) -> DataFrame:
    return R.completeness(registry_merged(s, d), ["dtxsid", "preferred_name", "molecular_formula", "average_mass", "smiles"])


@query("select dtxsid, coalesce(nullif(trim(study_type), ''), 'other') as study_group, ordinal, toxval_units from toxval_raw", "toxval_raw")
def group_by_study_type(s: SparkSession, d: str) -> DataFrame:
    return V.with_study_group(view(s, d, "toxval_raw")).select("dtxsid", "study_group", "ordinal", "toxval_units")


_CAT = """case when study_type = 'acute LD50' then 'acute_toxicity' when study_type = 'Repeat dose 28-day' then 'repeated_dose' when study_type = 'developmental' then 'developmental'
    when study_type = 'reproduction' then 'reproductive' when study_type = 'ecotox fish' then 'ecotoxicity' else 'other' end"""


@query("select dtxsid, " + ", ".join(f"count(*) filter (category = '{c}') as {c}" for c in V.CATEGORIES) + f" from (select *, {_CAT} as category from toxval_raw) t group by dtxsid", "toxval_raw")
def group_by_tox_category(s: SparkSession, d: str) -> DataFrame:
    return V.category_counts(view(s, d, "toxval_raw"))


@query(f"select k, ordinal, {_CAT} as category from toxval_raw", "toxval_raw")
def categorize_study(s: SparkSession, d: str) -> DataFrame:
    return V.with_category(view(s, d, "toxval_raw")).select("k", "ordinal", "category")


_DUCK_ECO = r"""eco as (select k, ordinal, value, case when regexp_matches(lower(value), 'fish|trout') then 'fish' when contains(lower(value), 'daphnia') then 'Daphnia' when contains(lower(value), 'algae') then 'algae' else 'aquatic' end as species,
    upper(nullif(regexp_extract(value, '\b(LC50|EC50|LC10|LC20|LC90|EC10|EC20|EC90|NOEC|LOEC)\b', 1, 'i'), '')) as endpoint, nullif(regexp_extract(value, '(\d+\s*(?:h|hr|hrs|hour|hours|d|day|days))\b', 1, 'i'), '') as duration,
    cast(replace(regexp_replace(nullif(regexp_extract(value, '([<>~]?\s*\d+(?:[.,]\d+)?)\s*(mg/L|µg/L|ug/L|mg/kg|g/L|mg/l)\b', 1, 'i'), ''), '[<>~]\s*', ''), ',', '') as double) as value_num,
    nullif(regexp_extract(value, '([<>~]?\s*\d+(?:[.,]\d+)?)\s*(mg/L|µg/L|ug/L|mg/kg|g/L|mg/l)\b', 2, 'i'), '') as unit,
    try_cast(nullif(regexp_extract(value, '(?:CI|confidence interval)[^0-9]*([0-9]+(?:\.\d+)?)\s*[–-]\s*([0-9]+(?:\.\d+)?)', 1, 'i'), '') as double) as ci_low,
    try_cast(nullif(regexp_extract(value, '(?:CI|confidence interval)[^0-9]*([0-9]+(?:\.\d+)?)\s*[–-]\s*([0-9]+(?:\.\d+)?)', 2, 'i'), '') as double) as ci_high
    from tox_text where regexp_matches(lower(value), 'fish|trout|daphnia|algae|aquatic'))"""


@query("also " + _DUCK_ECO + ", own as (select k, arg_min(value_num, ordinal) filter (value_num <> 0 and not coalesce(starts_with(endpoint, 'EC'), false)) as lc50, arg_max(value_num, ordinal) filter (value_num is not null and starts_with(endpoint, 'EC')) as ec50, arg_min(species, ordinal) filter (value_num is not null) as species, arg_max(value[:250], ordinal) filter (value_num is not null) as excerpt, count(*) as entries from eco group by k), other as (select k, arg_min(value[:250], ordinal) as x from tox_text where contains(upper(value), 'LC50') and contains(lower(value), 'mg') and contains(value, 'L') group by k) select coalesce(own.k, other.k) as k, lc50, ec50, species, case when entries is null then x else excerpt end as excerpt, coalesce(entries, 1) as entries from own full join other on own.k = other.k", "tox_text")
def ecotox_summary(s: SparkSession, d: str) -> DataFrame:
    return E.ecotox_summary(view(s, d, "tox_text"), "k", "ordinal")


@query("also " + _DUCK_ECO + " select k, ordinal, species, endpoint, duration, value_num, coalesce(unit, 'mg/L') as unit, ci_low, ci_high from eco", "tox_text")
def parse_ecotox(s: SparkSession, d: str) -> DataFrame:
    return E.ecotox_entries(view(s, d, "tox_text")).select("k", "ordinal", "species", "endpoint", "duration", "value_num", "unit", "ci_low", "ci_high")


@query("also " + _DUCK_ECO + " select k, ordinal, case when value_num is null then 'text' else 'quantitative' end as kind, case when ci_low is null or ci_high is null then '' else concat(cast(ci_low as varchar), '–', cast(ci_high as varchar)) end as ci from eco", "tox_text")
def split_ecotox(s: SparkSession, d: str) -> DataFrame:
    return E.split_ecotox(E.ecotox_entries(view(s, d, "tox_text"))).select("k", "ordinal", "kind", "ci")


def _duck_band(p: str, dose: str = "") -> str:
    return "case " + " ".join(f"when {dose or p} <= {t} then {n}" for n, t in enumerate(E.BANDS[p], 1)) + " else 5 end"


_DUCK_DOSES = r"""doses as (select k, ordinal, case when contains(v, 'ld50') and contains(v, 'mg') and contains(v, 'kg') and not regexp_matches(v, 'dermal|skin') then try_cast(nullif(regexp_extract(v, '(\d+(?:\.\d+)?)\s*mg\s*/\s*kg', 1), '') as double) end as oral,
    case when regexp_matches(v, 'dermal|skin') and contains(v, 'ld50') then try_cast(nullif(regexp_extract(v, '(\d+(?:\.\d+)?)\s*mg\s*/\s*kg', 1), '') as double) end as dermal,
    case when contains(v, 'lc50') then try_cast(replace(nullif(regexp_extract(v, '(\d+(?:[.,]\d+)*)\s*mg\s*/\s*m', 1), ''), ',', '') as double) end as inhalation from (select *, lower(value) as v from tox_text) t)"""


@query("also " + _DUCK_DOSES + ", first as (select k, " + ", ".join(f"arg_min({p}, ordinal) filter ({p} is not null) as {p}" for p in E.BANDS) + " from doses group by k) " + " union all ".join(f"select k, '{p}' as pathway, {p} as dose, '{'mg/m3' if p == 'inhalation' else 'mg/kg'}' as unit, {_duck_band(p)} as band from first where {p} is not null" for p in E.BANDS), "tox_text")
def exposure_bands(s: SparkSession, d: str) -> DataFrame:
    return E.exposure_bands(view(s, d, "tox_text"), "k", "ordinal")


# Text mining.


@query(f"select k, ordinal, {_DUCK_UNIT} as unit from tox_text", "tox_text")
def extract_unit(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "tox_text").select("k", "ordinal", T.unit_of(F.col("value")).alias("unit"))


@query(f"select distinct k, ordinal, unnest({_DUCK_TOKENS}) as token from tox_text", "tox_text")
def extract_species_route(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "tox_text").select("k", "ordinal", F.explode(T.species_route_tokens(F.col("value"))).alias("token"))


@query("also " + _DUCK_MINED + " select k, ordinal, route, species from mined", "tox_text")
def classify_route_species(s: SparkSession, d: str) -> DataFrame:
    return mined(s, d).select("k", "ordinal", "route", "species")


@query("select k, ordinal, value, contains(upper(value), 'LD50') as is_ld50 from tox_text where regexp_matches(upper(value), 'LD50|LC50')", "tox_text")
def ld50_lc50_lists(s: SparkSession, d: str) -> DataFrame:
    t = view(s, d, "tox_text").select("k", "ordinal", "value")
    return E.naming(t, "LD50").withColumn("is_ld50", F.lit(True)).unionByName(E.naming(t, "LC50").withColumn("is_ld50", F.lit(False)))


# Statements.

_DUCK_CODES = r"""codes as (select distinct p_partkey, kind, trim(regexp_replace(code, '\s*\([^)]+\)', '', 'g')) as code from (select p_partkey, kind, unnest(case kind when 'H' then regexp_extract_all(txt, 'H\d+(?:\+\d+)?(?:\s*\([^)]+\))?') else regexp_extract_all(txt, 'P\d+(?:\+\d+)?(?:\s*\([^)]+\))?') end) as code from ghs_text where kind in ('H', 'P')) c)"""
_DUCK_PHRASES = "phrases as (select * from (values " + ", ".join(f"('{c}', '{p}')" for c, p in G.PHRASES.items()) + ") t(code, phrase))"


def statement_codes(s: SparkSession, d: str) -> DataFrame:
    t = view(s, d, "ghs_text").filter("kind in ('H', 'P')")
    return A.codes(t, "p_partkey", "kind", "txt", F.col("item"))


@query("also " + _DUCK_CODES + " select * from codes", "ghs_text")
def extract_ghs(s: SparkSession, d: str) -> DataFrame:
    return statement_codes(s, d).select("p_partkey", "kind", "code")


@query(f"also {_DUCK_CODES}, {_DUCK_PHRASES} select c.p_partkey, c.code, coalesce(p.phrase, concat(c.code, ': (phrase not found)')) as phrase, concat(c.code, ': ', coalesce(p.phrase, concat(c.code, ': (phrase not found)'))) as line from codes c left join phrases p on p.code = c.code", "ghs_text")
def expand_ghs_phrases(s: SparkSession, d: str) -> DataFrame:
    return G.expand(statement_codes(s, d)).select("p_partkey", "code", "phrase", "line")


@query(f"also {_DUCK_CODES}, {_DUCK_PHRASES} select c.p_partkey, c.kind, c.code, p.phrase from codes c join phrases p on p.code = c.code", "ghs_text")
def drop_unknown_phrases(s: SparkSession, d: str) -> DataFrame:
    return G.known_only(statement_codes(s, d)).select("p_partkey", "kind", "code", "phrase")


@query("also " + _DUCK_CODES + " select p_partkey, code from codes where code like 'H4%'", "ghs_text")
def aquatic_h_codes(s: SparkSession, d: str) -> DataFrame:
    return G.aquatic(statement_codes(s, d)).select("p_partkey", "code")


@query(f"also {_DUCK_CODES}, {_DUCK_PHRASES} select c.p_partkey, count(*) filter (kind = 'H') as n_h, count(*) filter (kind = 'P') as n_p from codes c join phrases p on p.code = c.code group by 1", "ghs_text")
def ghs_statement_counts(s: SparkSession, d: str) -> DataFrame:
    return G.counts(statement_codes(s, d), "p_partkey")


@query("select p_partkey, txt as signal_word from ghs_text where kind = 'S' and lower(trim(txt)) not in ('none', 'n/a', '')", "ghs_text")
def shown_signal_words(s: SparkSession, d: str) -> DataFrame:
    return G.shown_signals(view(s, d, "ghs_text").filter("kind = 'S'").select("p_partkey", F.col("txt").alias("signal_word")))


# Annotation documents.

@query("also " + _DUCK_ITEMS + " select doc_id, own_heading, heading, name from items", *_ITEM_VIEWS)
def flatten_annotations(s: SparkSession, d: str) -> DataFrame:
    return items(s, d).select("doc_id", "own_heading", "heading", "name")


@query(
    """also recursive walk as (select doc_id, cast(i as varchar) as path, json_extract(doc, concat('$.Record.Section[', i, ']')) as node, nullif(json_extract_string(doc, concat('$.Record.Section[', i, '].TOCHeading')), '') as heading
    from (select *, unnest(range(cast(json_array_length(doc, '$.Record.Section') as bigint))) as i from deep_docs) r
    union all select doc_id, concat(path, '.', i), json_extract(node, concat('$.Section[', i, ']')), coalesce(nullif(json_extract_string(node, concat('$.Section[', i, '].TOCHeading')), ''), heading) from (select *, unnest(range(cast(json_array_length(node, '$.Section') as bigint))) as i from walk) w)
    select doc_id, path, cast(i as int) as info_pos, node ->> '$.TOCHeading' as own_heading, heading, node ->> concat('$.Information[', i, '].Name') as name, node ->> concat('$.Information[', i, '].Value') as raw
    from (select *, unnest(range(cast(json_array_length(node, '$.Information') as bigint))) as i from walk) x""",
    "deep_docs",
)
def flatten_deep_annotations(s: SparkSession, d: str) -> DataFrame:
    """Documents of up to 17 levels, every item with its place."""
    return A.flatten(view(s, d, "deep_docs")).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "."))


@query("also " + _DUCK_ITEMS + " select doc_id, name, trim(text) as text from items", *_ITEM_VIEWS)
def annotation_text(s: SparkSession, d: str) -> DataFrame:
    return items(s, d).select("doc_id", "name", A.text(F.col("raw")).alias("text"))


@query("also " + _DUCK_ITEMS + " select doc_id, concat('https://example.org/', md5(text)) as url from items", *_ITEM_VIEWS)
def annotation_urls(s: SparkSession, d: str) -> DataFrame:
    return items(s, d).select("doc_id", F.explode(A.urls(F.col("raw"))).alias("url"))


@query("also " + _DUCK_CODES + " select distinct cast(floor(p_partkey / 2.0) as bigint) as doc_id, kind, code from codes", "ghs_text")
def document_statements(s: SparkSession, d: str) -> DataFrame:
    return A.statements(items(s, d)).select("doc_id", "kind", "code")


@query("select cast(floor(p_partkey / 2.0) as bigint) as doc_id, arg_max(txt, p_partkey) as signal_word from ghs_text where kind = 'S' group by 1", "ghs_text")
def document_signal_words(s: SparkSession, d: str) -> DataFrame:
    return A.signal_words(items(s, d))


@query("select k as doc_id, row_number() over (partition by k order by spot) as place, txt as pictogram from (select cast(floor(p_partkey / 2.0) as bigint) as k, txt, min(p_partkey) as spot from ghs_text where kind = 'G' group by 1, 2) g", "ghs_text")
def document_pictograms(s: SparkSession, d: str) -> DataFrame:
    """Names of each chemical's pictograms in document order."""
    lists = D.ordered(A.pictograms(items(s, d)), "doc_id", "pictogram", "at", "names")
    return lists.select("doc_id", F.posexplode("names").alias("pos", "pictogram")).select("doc_id", (F.col("pos") + 1).cast("long").alias("place"), "pictogram")


_DUCK_METRICS = "case name when 'Flash Point' then 'flash_point' when 'Vapor Pressure' then 'vapor_pressure' when 'NFPA Health Rating' then 'nfpa' when 'IARC Carcinogens' then 'iarc' else 'prop65' end"


@query(f"select distinct cast(floor(p_partkey / 2.0) as bigint) as doc_id, {_DUCK_METRICS} as metric, txt as text from metric_text", "metric_text")
def extract_hazard_metrics(s: SparkSession, d: str) -> DataFrame:
    return A.metrics(items(s, d)).select("doc_id", "metric", "text")


@query(
    f"""also {_DUCK_ITEMS} select doc_id, name as type, text as value, {_DUCK_UNIT.replace("(value", "(text")} as unit, heading as source_section,
    array_to_string(list_sort(list_distinct(list_transform({_DUCK_TOKENS.replace("(value", "(text")}, lambda x: lower(x)))), ',') as tokens, concat('https://example.org/', md5(text)) as urls from items where regexp_matches(lower(heading), 'tox|safety|hazard|health|exposure|pharmacokinetics|carcinogen')""",
    *_ITEM_VIEWS,
)
def extract_tox_endpoints(s: SparkSession, d: str) -> DataFrame:
    e = A.tox_endpoints(items(s, d))
    tokens = F.array_join(F.array_sort(F.array_distinct(F.transform("species_route", lambda x: F.lower(x)))), ",")
    return e.select("doc_id", "type", "value", "unit", "source_section", F.coalesce(tokens, F.lit("")).alias("tokens"), F.array_join("reference_urls", ",").alias("urls"))


@query("select p_partkey, metric, row_number() over (partition by p_partkey, metric order by spot) as place, txt from (select p_partkey, " + _DUCK_METRICS + " as metric, txt, min(item) as spot from metric_text group by 1, 2, 3) m", "metric_text")
def ordered_distinct(s: SparkSession, d: str) -> DataFrame:
    m = view(s, d, "metric_text")
    kind = F.when(F.col("name") == "Flash Point", "flash_point").when(F.col("name") == "Vapor Pressure", "vapor_pressure").when(F.col("name") == "NFPA Health Rating", "nfpa").when(F.col("name") == "IARC Carcinogens", "iarc").otherwise("prop65")
    keyed = m.withColumn("key", F.struct("p_partkey", kind.alias("metric")))
    lists = D.ordered(keyed, "key", "txt", "item", "texts")
    return lists.select("key.*", F.posexplode("texts").alias("pos", "txt")).select("p_partkey", "metric", (F.col("pos") + 1).cast("long").alias("place"), "txt")


# Reports.

_DUCK_PRIO = _DUCK_ENDS + r", prio as (select *, case when coalesce(unit, '') <> '' and (value_num is not null or regexp_matches(trim(value), '^[<>~]?\s*\d+(?:[.,]\d+)?')) then 'quantitative' else 'categorical' end as priority from ends)"


@query("also " + _DUCK_PRIO + " select chem, ordinal, source, endpoint, value_num, unit, priority from prio", "tox_text", "toxval_raw")
def prioritize_endpoints(s: SparkSession, d: str) -> DataFrame:
    return E.prioritize(endpoints(s, d)).select("chem", "ordinal", "source", "endpoint", "value_num", "unit", "priority")


@query("also " + _DUCK_PRIO + " select chem, ordinal, case priority when 'quantitative' then 'Quantitative' else 'Categorical' end as type, coalesce(endpoint, '—') as endpoint, case priority when 'categorical' then value[:200] else value end as value, value_num, coalesce(unit, '') as units, coalesce(species, '') as species, coalesce(route, '') as route, source from prio", "tox_text", "toxval_raw")
def display_endpoints(s: SparkSession, d: str) -> DataFrame:
    return E.display(E.prioritize(endpoints(s, d)))


@query("also " + _DUCK_PRIO + " select chem, row_number() over (partition by chem order by case priority when 'quantitative' then 0 else 1 end, source, ordinal) as place, source, ordinal from prio", "tox_text", "toxval_raw")
def quantitative_first(s: SparkSession, d: str) -> DataFrame:
    return E.quantitative_first(E.display(E.prioritize(endpoints(s, d)))).select("chem", "place", "source", "ordinal")


@query("also " + _DUCK_ENDS + " select chem, ordinal, source, coalesce(route, '—') as route, coalesce(species, '—') as species, coalesce(endpoint, '—') as endpoint, value, value_num, coalesce(unit, '—') as unit from ends", "tox_text", "toxval_raw")
def complete_endpoints(s: SparkSession, d: str) -> DataFrame:
    return E.complete(endpoints(s, d))


METRIC_NAMES = {"Flash Point": "flash_point", "Vapor Pressure": "vapor_pressure", "NFPA Health Rating": "nfpa", "IARC Carcinogens": "iarc", "California Proposition 65": "prop65"}


def metric_lists(s: SparkSession, d: str) -> DataFrame:
    """(k, flash_point, vapor_pressure, nfpa, iarc, prop65) lists of each compound's metrics."""
    return D.listed(of_chemical(view(s, d, "metric_text")), "k", "name", "txt", "at", METRIC_NAMES)


def statement_lists(s: SparkSession, d: str) -> DataFrame:
    """(k, h_codes, p_codes, pictograms, signal_word) of each compound, in document order."""
    ghs = of_chemical(view(s, d, "ghs_text"))
    codes = A.codes(ghs.filter("kind in ('H', 'P')"), "k", "kind", "txt", F.col("at"))
    names = ghs.filter("kind = 'G'").select("k", "kind", F.col("txt").alias("code"), F.struct(F.col("at").alias("o"), F.lit(0).alias("pos")).alias("at"))
    lists = D.listed(codes.unionByName(names), "k", "kind", "code", "at", {"H": "h_codes", "P": "p_codes", "G": "pictograms"})
    words = ghs.filter("kind = 'S'").groupBy("k").agg(F.max_by("txt", "at").alias("signal_word"))
    return lists.join(words, "k", "full")


_DUCK_LISTS = """lists as (select k, string_agg(txt, ' | ' order by spot) filter (name = 'Flash Point') as fp, string_agg(txt, ' | ' order by spot) filter (name = 'Vapor Pressure') as vp, string_agg(txt, '; ' order by spot) filter (name = 'NFPA Health Rating') as nfpa, string_agg(txt, '; ' order by spot) filter (name = 'IARC Carcinogens') as iarc, string_agg(txt, '; ' order by spot) filter (name = 'California Proposition 65') as prop65, count(*) filter (name = 'Flash Point') as nf, count(*) filter (name = 'Vapor Pressure') as nv
    from (select cast(floor(p_partkey / 2.0) as bigint) as k, name, txt, min(row(p_partkey, item)) as spot from metric_text group by 1, 2, 3) m group by k)"""


@query(
    "also " + _DUCK_LISTS + ", rows_of as (select c.*, l.fp, l.vp, l.nf, l.nv from compound c left join lists l on l.k = c.k) select cid, 'Molecular Formula' as property, formula as value, '—' as unit, '' as observations from rows_of union all select cid, 'Molecular Weight', coalesce(printf('%.2f', mw), mw_text, '—'), 'g/mol', '' from rows_of"
    " union all select cid, 'Flash Point', coalesce(fp, '—'), '°C (typical)', case when nf > 1 then 'Multiple values' else '' end from rows_of union all select cid, 'Vapor Pressure', coalesce(vp, '—'), 'mmHg (typical)', case when nv > 1 then 'Multiple values' else '' end from rows_of",
    "compound", "metric_text",
)
def property_table(s: SparkSession, d: str) -> DataFrame:
    c = D.compounds(view(s, d, "compound")).withColumn("k", F.col("cid") - 1000)
    return D.property_table(c.join(metric_lists(s, d), "k", "left"))


@query("also " + _MERGED + " select cas, 'DTXSID' as section, 'DTXSID' as label, dtxsid as value from merged where dtxsid is not null union all select cas, 'Names', 'Preferred name', preferred_name from merged where preferred_name is not null union all select cas, 'Molecular', 'Formula', molecular_formula from merged union all select cas, 'Molecular', 'Average mass', average_mass from merged", "registry_raw")
def registry_sections(s: SparkSession, d: str) -> DataFrame:
    return R.sections(registry_merged(s, d))


def chemical_key(s: SparkSession, d: str, **given: DataFrame) -> DataFrame:
    """(cas, k): the registry number of every chemical."""
    return view(s, d, "registry_raw", **given).select(F.col("casrn").alias("cas"), "k").distinct()


def aquatic(s: SparkSession, d: str) -> DataFrame:
    """(k, lc50, ec50) of every chemical with aquatic sentences."""
    return E.ecotox_own(E.ecotox_entries(sentences(s, d).select("k", "ordinal", "value")), "k", "ordinal").select("k", "lc50", "ec50")


def dossiers(s: SparkSession, d: str, *facets: DataFrame, **given: DataFrame) -> DataFrame:
    """One row for each registry chemical with its compound, statements and metrics, and the other facets given by k; facets may be
    missing. Only what a query shows is given: a facet that is joined is computed, shown or not."""
    given = given or landed_registry(s, d)
    base = registry_merged(s, d, **given).select("cas", "dtxsid", "preferred_name").join(chemical_key(s, d, **given), "cas", "left")
    cid = D.resolve(base.select("cas", F.lit("cas").alias("kind"), F.col("cas").alias("query")), view(s, d, "xref", **given).filter("identifier_type = 'cas'"), "kind").select("cas", "cid")
    # Facets that are small come first, those made of sentences last, where these lie.
    small = D.assemble(base, "cas", cid).join(D.compounds(view(s, d, "compound")), "cid", "left")
    full = D.assemble(small, "k", statement_lists(s, d), metric_lists(s, d), *facets)
    return full.withColumns({c: D.joined_or_null(F.col(c)) for c in ("nfpa", "iarc", "prop65")})


def with_toxval_counts(s: SparkSession, d: str, dossier: DataFrame) -> DataFrame:
    tox = toxvals(s, d).groupBy("dtxsid").agg(F.count("*").alias("n_toxvals"))
    return dossier.join(tox, "dtxsid", "left").withColumns({"n_toxvals": F.coalesce("n_toxvals", F.lit(0)).cast("long"), "has_toxvals": F.col("n_toxvals").isNotNull()})


_DUCK_DOSSIER = _MERGED + """, keyed as (select m.*, r.k from merged m left join (select distinct casrn, k from registry_raw) r on r.casrn = m.cas), ids as (select identifier, arg_min(cid, row(ordinal, cid)) as cid from xref where identifier_type = 'cas' group by 1),
    tox as (select dtxsid, count(*) as n from toxval_raw group by 1)"""


_DUCK_TOLD = r"""seen as (select cast(floor(p_partkey / 2.0) as bigint) as k, kind, trim(regexp_replace(c[pos], '\s*\([^)]+\)', '', 'g')) as code, min(row(p_partkey, item, pos)) as spot from (select *, unnest(range(1, len(c) + 1)) as pos
    from (select *, case kind when 'H' then regexp_extract_all(txt, 'H\d+(?:\+\d+)?(?:\s*\([^)]+\))?') else regexp_extract_all(txt, 'P\d+(?:\+\d+)?(?:\s*\([^)]+\))?') end as c from ghs_text where kind in ('H', 'P')) t) u group by 1, 2, 3),
    told as (select k, string_agg(code, ' | ' order by spot) filter (kind = 'H') as h, string_agg(code, ' | ' order by spot) filter (kind = 'P') as p, string_agg(code, ' | ' order by spot) filter (code like 'H4%') as a from seen group by k)"""
_DUCK_AQUATIC = _DUCK_ECO + ", doses as (select k, arg_min(value_num, ordinal) filter (value_num <> 0 and not coalesce(starts_with(endpoint, 'EC'), false)) as lc50, arg_max(value_num, ordinal) filter (value_num is not null and starts_with(endpoint, 'EC')) as ec50 from eco group by k)"
_DUCK_FACETS = """signals as (select cast(floor(p_partkey / 2.0) as bigint) as k, arg_max(txt, p_partkey) as word from ghs_text where kind = 'S' group by 1),
    names as (select k, string_agg(txt, ' | ' order by spot) as g from (select cast(floor(p_partkey / 2.0) as bigint) as k, txt, min(p_partkey) as spot from ghs_text where kind = 'G' group by 1, 2) x group by k),
    lethal as (select k, string_agg(value[:400], ' | ' order by ordinal) filter (contains(upper(value), 'LD50')) as ld50, string_agg(value[:400], ' | ' order by ordinal) filter (contains(upper(value), 'LC50')) as lc50 from tox_text group by k)"""
_DUCK_FIRST = _DUCK_DOSES.replace("doses as", "dosed as") + ", first as (select k, " + ", ".join(f"arg_min({p}, ordinal) filter ({p} is not null) as {p}" for p in E.BANDS) + " from dosed group by k)"


@query(
    f"also {_DUCK_DOSSIER}, {_DUCK_LISTS}, {_DUCK_TOLD}, {_DUCK_AQUATIC}, {_DUCK_FACETS}, {_DUCK_FIRST} select m.cas, m.dtxsid, m.preferred_name, i.cid, c.formula, coalesce(printf('%.2f', c.mw), c.mw_text) as mw, coalesce(c.iupac_name, c.iupac_name_legacy) as iupac_name, coalesce(c.smiles, c.isomeric_smiles, c.canonical_smiles) as smiles,"
    " coalesce(replace(l.fp, ' | ', '; '), '') as flash_point, coalesce(replace(l.vp, ' | ', '; '), '') as vapor_pressure, l.nfpa, l.iarc, l.prop65, coalesce(h.h, '') as h_codes, coalesce(h.p, '') as p_codes, s.word as signal_word, coalesce(g.g, '') as pictograms, coalesce(x.ld50, '') as ld50, coalesce(x.lc50, '') as lc50_texts,"
    + ", ".join(f"f.{p} as {p}_dose, case when f.{p} is not null then {_duck_band(p, 'f.' + p)} end as {p}_band" for p in E.BANDS)
    + ", e.lc50, e.ec50, coalesce(t.n, 0) as n_toxvals from keyed m left join ids i on i.identifier = m.cas left join compound c on c.cid = i.cid left join lists l on l.k = m.k left join told h on h.k = m.k left join signals s on s.k = m.k left join names g on g.k = m.k left join lethal x on x.k = m.k left join first f on f.k = m.k left join doses e on e.k = m.k left join tox t on t.dtxsid = m.dtxsid",
    "registry_raw", "xref", "compound", "toxval_raw", "metric_text", "ghs_text", "tox_text",
)
def assemble_dossier(s: SparkSession, d: str) -> DataFrame:
    """Every facet of every chemical; lists as texts."""
    lists = [D.joined(F.col(c), sep).alias(c) for c, sep in {"flash_point": "; ", "vapor_pressure": "; ", "h_codes": " | ", "p_codes": " | ", "pictograms": " | ", "ld50": " | ", "lc50_texts": " | "}.items()]
    doses = [F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in E.BANDS for c in ("dose", "band")]
    texts = sentences(s, d).select("k", "ordinal", "value")
    bands = D.band_columns(E.exposure_bands(texts, "k", "ordinal"), "k")
    full = with_toxval_counts(s, d, dossiers(s, d, aquatic(s, d), bands, D.toxicity_lists(texts, "k", "ordinal")))
    return full.select("cas", "dtxsid", "preferred_name", "cid", "formula", "mw", "iupac_name", "smiles", *lists, "nfpa", "iarc", "prop65", "signal_word", *doses, "lc50", "ec50", "n_toxvals")


@query(f"also {_DUCK_DOSSIER}, {_DUCK_LISTS}, {_DUCK_TOLD}, {_DUCK_AQUATIC}, {_DUCK_MINED} select m.cas as \"CAS\", coalesce(m.dtxsid, '') as \"DTXSID\", coalesce(m.preferred_name, '') as \"Preferred_Name\", coalesce(c.iupac_name, c.iupac_name_legacy, '') as \"IUPAC_Name\", coalesce(replace(l.fp, ' | ', '; '), '') as \"Flash_Point\", coalesce(replace(l.vp, ' | ', '; '), '') as \"Vapor_Pressure\", coalesce(h.h, '') as \"GHS_H\", coalesce(h.p, '') as \"GHS_P\", coalesce(h.a, '') as \"Aquatic_H\", x.lc50 as \"Aquatic_LC50_mg_L\", x.ec50 as \"Aquatic_EC50_mg_L\", coalesce(c.formula, '') as \"Formula\", coalesce(printf('%.2f', c.mw), c.mw_text, '') as \"MW\", coalesce(e.ordinal, 0) as \"Row\", coalesce(e.route, '') as \"Exposure_Pathway\", coalesce(e.species, '') as \"Species\", trim(coalesce(e.type, '')) as \"Endpoint\", coalesce(e.value, '') as \"Value\", coalesce(e.unit, '') as \"Unit\" from keyed m left join ids i on i.identifier = m.cas left join compound c on c.cid = i.cid left join mined e on e.k = m.k left join lists l on l.k = m.k left join told h on h.k = m.k left join doses x on x.k = m.k", "registry_raw", "xref", "compound", "toxval_raw", "tox_text", "metric_text", "ghs_text")
def report_csv(s: SparkSession, d: str) -> DataFrame:
    given = landed_registry(s, d)
    return D.report_csv(dossiers(s, d, aquatic(s, d), **given), mined(s, d), by="k")


_REPORT_VIEWS = ("registry_raw", "xref", "compound", "toxval_raw", "tox_text", "metric_text", "ghs_text")
_DUCK_REPORT = f"""also {_DUCK_DOSSIER}, {_DUCK_LISTS}, {_DUCK_TOLD}, {_DUCK_AQUATIC}, {_DUCK_MINED}, {_DUCK_FACETS}, coded as (select k, list(code order by spot) filter (kind = 'H') as h, list(code order by spot) filter (kind = 'P') as p, list(code order by spot) filter (code like 'H4%') as a from seen group by k),
    rows_of as (select k, list(struct_pack(exposure_pathway := route, species := species, endpoint := type, value := value, unit := unit, source_section := source_section) order by ordinal) as l from mined group by k),
    entries as (select k, list(struct_pack(value := value[:400], species := species, unit := coalesce(unit, 'mg/L'), endpoint := endpoint, duration := duration, value_num := value_num, ci_low := ci_low, ci_high := ci_high, conditions := trim(value)) order by ordinal) as l from eco group by k)
    select m.cas, to_json(struct_pack(query_info := struct_pack("timestamp" := '2024-01-01T00:00:00', cas_number := m.cas),
    identifiers := struct_pack(iupac_name := coalesce(c.iupac_name, c.iupac_name_legacy), cid := i.cid, formula := c.formula, mw := coalesce(printf('%.2f', c.mw), c.mw_text), smiles := coalesce(c.smiles, c.isomeric_smiles, c.canonical_smiles), dsstox := struct_pack(dtxsid := m.dtxsid, preferred_name := m.preferred_name)),
    physical_properties := struct_pack(flash_point := coalesce(replace(l.fp, ' | ', '; '), ''), vapor_pressure := coalesce(replace(l.vp, ' | ', '; '), '')),
    ghs := struct_pack(h_codes := coalesce(h.h, []), p_codes := coalesce(h.p, []), signal_word := coalesce(s.word, '')),
    ecotoxicity := struct_pack(h_codes_aquatic := coalesce(h.a, []), aquatic_lc50_mg_l := x.lc50, aquatic_ec50_mg_l := x.ec50, entries := coalesce(e.l, [])),
    toxicity_endpoints := coalesce(r.l, []), toxvaldb_available := t.n is not null)) as report
    from keyed m left join ids i on i.identifier = m.cas left join compound c on c.cid = i.cid left join lists l on l.k = m.k left join coded h on h.k = m.k left join signals s on s.k = m.k left join doses x on x.k = m.k left join rows_of r on r.k = m.k left join entries e on e.k = m.k left join tox t on t.dtxsid = m.dtxsid"""


@query(_DUCK_REPORT, *_REPORT_VIEWS)
def report_json(s: SparkSession, d: str) -> DataFrame:
    given = landed_registry(s, d)
    dossier = with_toxval_counts(s, d, dossiers(s, d, **given))
    # The lists, far larger than all else, are gathered in one pass and joined last, where the sentences lie.
    return D.report_json(dossier, D.report_lists(E.with_ecotox(mined(s, d)), "k"), "cas", "2024-01-01T00:00:00", by="k")


@query(ORACLE_SQL["report_csv"])
def write_report_csv(s: SparkSession, d: str) -> DataFrame:
    """The flat report written as CSV files in hash buckets of the chemical, checked and read back."""
    return tables.write_report(report_csv(s, d), scratch(s)).table


@query(ORACLE_SQL["report_json"].replace("select m.cas, to_json(", "select to_json(", 1))
def write_report_json(s: SparkSession, d: str) -> DataFrame:
    """The nested reports written as lines of JSON and read back."""
    return tables.write_json_reports(report_json(s, d), scratch(s)).table
