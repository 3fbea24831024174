"""Chemical tables derived from the driver's star schema, in SQL that Spark and DuckDB read alike.

Two parts make one chemical k; each lineitem is one toxicity record and one toxicity sentence of its part's chemical."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_BODY = "((k + 50) * 100 + k % 100)"
_SUM = " + ".join(f"(cast(floor({_BODY} / {10**j}.0) as bigint) % 10) * {j + 1}" for j in range(8))
#: The check digit; every seventh chemical has a wrong one.
_CHECK = f"(({_SUM} + case when k % 7 = 0 then 1 else 0 end) % 10)"
_CASRN = f"concat(cast(k + 50 as string), '-', lpad(cast(k % 100 as string), 2, '0'), '-', cast({_CHECK} as string))"

#: Each view may use the tables and the views before it.
VIEWS = {
    "registry_raw": f"""select *, {_CASRN} as casrn from (
        select cast(floor(p_partkey / 2.0) as bigint) as k, p_partkey as row_idx, concat('f', cast(p_partkey % 3 as string)) as src_file,
        case when p_partkey % 9 = 0 then 'nan' else concat('DTXSID', cast(7000000 + cast(floor(p_partkey / 2.0) as bigint) as string)) end as dtxsid,
        case when p_partkey % 5 = 0 then '' else p_name end as preferred_name, p_type as molecular_formula,
        cast(p_retailprice as string) as average_mass from part) p""",
    "toxval_raw": f"""select cast(floor(l_partkey / 2.0) as bigint) as k, concat('DTXSID', cast(7000000 + cast(floor(l_partkey / 2.0) as bigint) as string)) as dtxsid,
        cast(row_number() over (partition by cast(floor(l_partkey / 2.0) as bigint) order by {_ORDER}) as bigint) as ordinal,
        case when l_linenumber = 7 then null when l_linenumber = 6 then 'n/a' else cast(l_quantity as string) end as toxval_numeric,
        case when l_linenumber = 7 then null when l_linenumber % 2 = 0 then 'mg/L' else 'mg/kg' end as toxval_units,
        case concat(l_returnflag, l_linestatus) when 'AF' then 'acute LD50' when 'AO' then 'Repeat dose 28-day' when 'NF' then 'developmental'
        when 'NO' then 'reproduction' when 'RF' then 'ecotox fish' else null end as study_type from lineitem""",
    "tox_text": f"""select cast(floor(l_partkey / 2.0) as bigint) as k,
        cast(row_number() over (partition by cast(floor(l_partkey / 2.0) as bigint) order by {_ORDER}) as bigint) as ordinal, 'Toxicity' as source_section,
        case l_linenumber when 1 then 'Acute' when 2 then ' ' else 'Effects' end as type,
        case l_linenumber when 1 then concat('LD50 Rat oral ', cast(l_quantity as string), ' mg/kg') when 2 then concat('LD50 rabbit dermal ', cast(l_quantity * 10 as string), ' mg/kg skin')
        when 3 then concat('LC50 rat inhalation ', cast(l_quantity * 100 as string), ' mg/m³ 4 h') when 4 then concat('LC50 fish (trout) ', cast(l_quantity as string), ' mg/L 96 h (95% CI: 1.2-3.4)')
        when 5 then concat('EC50 Daphnia magna ', cast(l_quantity as string), ' µg/L 48 hr') when 6 then concat('NOEC algae <', cast(l_quantity as string), ' mg/L 72 hours')
        else 'Irritating concentration reported' end as value from lineitem""",
    "ghs_text": """select p_partkey, 'H' as kind, 1 as item, case p_partkey % 4 when 0 then 'H225 (100%): Highly Flammable liquid; H319 (87.5%)' when 1 then 'H300+310 (10%); H410' when 2 then 'H360FD; H999' else 'Not Classified' end as txt from part
        union all select p_partkey, 'P', 2, case p_partkey % 2 when 0 then 'P210, P261, and P305+P351+P338' else 'P273, and P501' end from part
        union all select p_partkey, 'S', 3, case p_partkey % 3 when 0 then 'Danger' when 1 then 'Warning' else 'N/A' end from part
        union all select p_partkey, 'G', 4, case p_partkey % 3 when 0 then 'Flame' when 1 then 'Irritant' else 'Environmental Hazard' end from part""",
    "payloads": """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case when l_linenumber % 2 = 0
        then concat('{"data":[{"studyType":"acute LD50","toxValNumeric":', cast(l_quantity as string), ',"toxValUnits":"mg/kg"}]}')
        else concat('[{"study_type":"ecotox fish","toxval_numeric":', cast(l_quantity as string), ',"toxval_units":"mg/L"}]') end as payload from lineitem""",
    "compound": """select 1000 + k as cid, case when k % 3 = 0 then null else concat('S', cast(k as string)) end as smiles, case when k % 6 = 0 then null else concat('I', cast(k as string)) end as isomeric_smiles,
        concat('C', cast(k as string)) as canonical_smiles, formula, case when k % 9 <> 0 then price end as mw, case when k % 18 = 0 then concat('ca. ', cast(k as string)) end as mw_text,
        case when k % 5 <> 0 then name end as iupac_name, case when k % 10 = 0 then concat('legacy ', name) end as iupac_name_legacy, k from (
        select cast(floor(p_partkey / 2.0) as bigint) as k, p_type as formula, p_retailprice as price, p_name as name from part where p_partkey % 2 = 0) c""",
    "xref": """select 'cas' as identifier_type, casrn as identifier, 1000 + k as cid, cast(0 as bigint) as ordinal from registry_raw where row_idx % 2 = 0 and k % 10 <> 0
        union all select 'cas', casrn, 900000 + k, cast(1 as bigint) from registry_raw where row_idx % 2 = 0 and k % 4 = 0
        union all select 'name', p_name, 1000 + cast(floor(p_partkey / 2.0) as bigint), cast(floor(p_partkey / 2.0) as bigint) from part where p_partkey % 2 = 0""",
    "queries": """select row_idx, case row_idx % 5 when 0 then casrn when 1 then replace(casrn, '-', '') when 2 then concat('  ', casrn, ' ')
        when 3 then concat(casrn, ' (', preferred_name, ')') else concat('name ', cast(row_idx as string)) end as query from registry_raw""",
    "deep_docs": """select k as doc_id, concat('{"Record":{"Section":[{"TOCHeading":"', name, '"},', repeat('{"TOCHeading":"Level","Information":[{"Name":"n","Value":1},{"Name":"m"}],"Section":[{"TOCHeading":"","Information":[{"Value":{"StringWithMarkup":[{"String":"s"}]}}]},', d),
        '{"TOCHeading":"Leaf","Information":[{"Name":"leaf","Value":"', name, '"}],"Section":[]}', repeat(']}', d), ']}}') as doc from (
        select cast(floor(p_partkey / 2.0) as bigint) as k, cast(1 + p_size % 16 as int) as d, p_name as name from part where p_partkey % 2 = 0) p""",
    "registry_rivals": """select k, concat(substr(digits, 1, 1), '-', substr(digits, 2)) as casrn from (select k, replace(casrn, '-', '') as digits from registry_raw where row_idx % 8 = 0) r""",
    "metric_text": """select p_partkey, item, name, txt from (
        select p_partkey, 1 as item, 'Flash Point' as name, concat(cast(p_size as string), ' °C') as txt from part
        union all select p_partkey, 2, 'Flash Point', concat(cast(p_size as string), ' °C') from part where p_partkey % 2 = 0
        union all select p_partkey, 3, 'Vapor Pressure', concat(cast(p_size * 2 as string), ' mmHg') from part where p_partkey % 3 <> 0
        union all select p_partkey, 4, 'Vapor Pressure', concat(cast(p_size * 3 as string), ' mmHg') from part where p_partkey % 4 = 0
        union all select p_partkey, 5, 'NFPA Health Rating', p_brand from part where p_partkey % 5 = 0
        union all select p_partkey, 6, 'IARC Carcinogens', 'Group 2B' from part where p_partkey % 6 = 0
        union all select p_partkey, 7, 'California Proposition 65', 'Listed' from part where p_partkey % 7 = 0) m""",
}
_TABLES = ("part", "lineitem")
_NEEDS = {v: [n for n in (*VIEWS, *_TABLES) if f"from {n}" in sql and n != v] for v, sql in VIEWS.items()}


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A derived table as a DataFrame; views that are given are taken as they are."""
    if name in given:
        return given[name]
    if name in _TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = {n: view(spark, sf_dir, n, **given) for n in _NEEDS[name]}
    sql = VIEWS[name]
    for n in needs:
        sql = sql.replace(f"from {n}", f"from {{{n}}}")
    marks = {f"{{{n}}}": f"__{n}__" for n in needs}
    # Braces of JSON texts are no parameters.
    for mark, code in marks.items():
        sql = sql.replace(mark, code)
    sql = sql.replace("{", "{{").replace("}", "}}")
    for mark, code in marks.items():
        sql = sql.replace(code, mark)
    return spark.sql(sql, **needs)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the derived tables it uses as common table expressions."""
    order: list[str] = []

    def add(n: str) -> None:
        if n in VIEWS and n not in order:
            for m in _NEEDS[n]:
                add(m)
            order.append(n)

    for n in names:
        add(n)
    sql, recursive = (sql.replace("also recursive ", "also ", 1), "recursive ") if sql.startswith("also recursive ") else (sql, "")
    return f"with {recursive}" + ",\n".join(f"{n} as ({VIEWS[n]})" for n in order) + ("," if sql.lstrip().startswith("also ") else "") + "\n" + sql.lstrip().removeprefix("also ")
