"""Compounds, dossiers and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DASH, blank_to_null, with_once
from .endpoints import aquatic_doses


def compounds(df: DataFrame) -> DataFrame:
    """(cid, smiles, formula, mw, iupac_name): the first structure that is there; the mass with two decimals, or as the text mw_text if
    it is no number; the name, or the older iupac_name_legacy. The last two columns may be missing."""
    own = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    mass = F.coalesce(F.when(F.col("mw").isNotNull(), F.format_string("%.2f", "mw")), own("mw_text"))
    return df.select("cid", F.coalesce("smiles", "isomeric_smiles", "canonical_smiles").alias("smiles"), "formula", mass.alias("mw"), F.coalesce(F.nullif("iupac_name", F.lit("")), own("iupac_name_legacy")).alias("iupac_name"))


def resolve(queries: DataFrame, xref: DataFrame, kind: str, query: str = "query") -> DataFrame:
    """Each query row with its first compound id; queries has the kind of identifier, 'cas' or 'name'."""
    first = xref.groupBy(F.col("identifier_type").alias(kind), F.col("identifier").alias(query)).agg(F.min_by("cid", F.struct("ordinal", "cid")).alias("cid"))
    return queries.join(first, [kind, query], "left")


def ordered(df: DataFrame, key: str, value: str, at: str, name: str) -> DataFrame:
    """One row for each key with its distinct values in the order they are first seen."""
    once = df.groupBy(key, value).agg(F.min(at).alias("at"))
    return once.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias(name))


def listed(df: DataFrame, key: str, kind: str, value: str, at: str, names: dict[str, str]) -> DataFrame:
    """One row for each key with a list for each kind, under its name: distinct values in the order they are first seen. All lists
    come from one pass; a kind without values has an empty list."""
    once = df.filter(F.col(kind).isin(*names)).groupBy(key, kind, value).agg(F.min(at).alias("at"))
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col(kind) == k, F.struct("at", value))))
    return once.groupBy(key).agg(*[F.transform(of(k), lambda x: x[value]).alias(n) for k, n in names.items()])


def toxicity_lists(texts: DataFrame, key: str, ordinal: str, value: str = "value", most: int = 400) -> DataFrame:
    """(key, ld50, lc50): values that name LD50 or LC50, in document order, at most ``most`` characters of each."""
    up = F.col("__up")
    cut = F.struct(ordinal, F.substring(value, 1, most).alias("v"))
    of = lambda what: F.transform(F.array_sort(F.collect_list(F.when(F.contains(up, F.lit(what)), cut))), lambda x: x["v"])
    return with_once(texts, "__up", F.upper(value)).filter(F.contains(up, F.lit("LD50")) | F.contains(up, F.lit("LC50"))).groupBy(key).agg(of("LD50").alias("ld50"), of("LC50").alias("lc50_texts"))


def band_columns(bands: DataFrame, key: str) -> DataFrame:
    """(key, oral, dermal, inhalation): each pathway's (dose, unit, band), null where there is none."""
    one = F.struct("dose", "unit", "band")
    return bands.groupBy(key).agg(*[F.max(F.when(F.col("pathway") == p, one)).alias(p) for p in ("oral", "dermal", "inhalation")])


def joined_or_null(values: Column, sep: str = "; ") -> Column:
    return F.when(F.size(values) > 0, F.array_join(values, sep))


def joined(values: Column, sep: str = "; ") -> Column:
    return F.coalesce(F.array_join(values, sep), F.lit(""))


def assemble(base: DataFrame, key: str, *facets: DataFrame) -> DataFrame:
    """Left joins of facets that have one row for each key; a facet may be missing."""
    for f in facets:
        base = base.join(f, key, "left")
    return base


def property_table(df: DataFrame, key: str = "cid") -> DataFrame:
    """(key, property, value, unit, observations): four rows for each compound; df has formula, mw and the lists flash_point
    and vapor_pressure."""
    listed = lambda c: (F.coalesce(blank_to_null(F.array_join(c, " | ")), F.lit(DASH)), F.when(F.size(c) > 1, "Multiple values").otherwise(""))
    flash, vapor = listed("flash_point"), listed("vapor_pressure")
    plain = lambda c: (F.coalesce(blank_to_null(F.col(c)), F.lit(DASH)), F.lit(""))
    rows = [("Molecular Formula", DASH, plain("formula")), ("Molecular Weight", "g/mol", plain("mw")), ("Flash Point", "°C (typical)", flash), ("Vapor Pressure", "mmHg (typical)", vapor)]
    long = F.explode(F.array(*[F.struct(F.lit(p).alias("property"), v.alias("value"), F.lit(u).alias("unit"), o.alias("observations")) for p, u, (v, o) in rows]))
    return df.select(key, long.alias("x")).select(key, "x.*")


def report_csv(dossier: DataFrame, endpoints: DataFrame, key: str = "cas", by: str | None = None) -> DataFrame:
    """The flat report: a chemical's base columns on each of its endpoint rows, on one row with an empty tail if it has none.

    dossier has the base columns and lists; endpoints has route, species, type, value, unit and ordinal. They are joined by ``by``,
    the key if none is given: the many endpoints needn't have the key, nor move to it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    tail = endpoints.select(by or key, "ordinal", F.struct("route", "species", "type", "value", "unit").alias("e"))
    both = dossier.join(tail, by or key, "left")
    return both.select(
        F.col(key).alias("CAS"), text("dtxsid").alias("DTXSID"), text("preferred_name").alias("Preferred_Name"), text("iupac_name").alias("IUPAC_Name"), text("formula").alias("Formula"), text("mw").alias("MW"),
        joined(F.col("flash_point")).alias("Flash_Point"), joined(F.col("vapor_pressure")).alias("Vapor_Pressure"),
        joined(F.col("h_codes"), " | ").alias("GHS_H"), joined(F.col("p_codes"), " | ").alias("GHS_P"), joined(F.filter("h_codes", lambda h: F.startswith(h, F.lit("H4"))), " | ").alias("Aquatic_H"),
        F.col("lc50").alias("Aquatic_LC50_mg_L"), F.col("ec50").alias("Aquatic_EC50_mg_L"), F.coalesce("ordinal", F.lit(0)).alias("Row"),
        text("e.route").alias("Exposure_Pathway"), text("e.species").alias("Species"), F.btrim(text("e.type")).alias("Endpoint"), text("e.value").alias("Value"), text("e.unit").alias("Unit"),
    )


def report_lists(endpoints: DataFrame, by: str) -> DataFrame:
    """(by, tox, eco, lc50, ec50): a chemical's endpoints and aquatic entries in document order, and the aquatic doses, all gathered in one pass.
    endpoints has the struct eco, null on rows that are no entry."""
    listed = lambda row, keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("ordinal", row.alias("x"))))), lambda x: x["x"])
    tox = F.struct(F.col("route").alias("exposure_pathway"), "species", F.col("type").alias("endpoint"), "value", "unit", "source_section")
    eco = F.struct(*[F.col(f"eco.{c}").alias(c) for c in ("value", "species", "unit", "endpoint", "duration", "value_num", "ci_low", "ci_high", "conditions")])
    lc50, ec50 = aquatic_doses(F.col("eco.value_num"), F.col("eco.endpoint"), F.col("ordinal"))
    return endpoints.groupBy(by).agg(listed(tox, F.lit(True)).alias("tox"), listed(eco, F.col("eco").isNotNull()).alias("eco"), lc50.alias("lc50"), ec50.alias("ec50"))


def report_json(dossier: DataFrame, lists: DataFrame, key: str, generated_at: str, by: str | None = None) -> DataFrame:
    """(key, report): the nested report as JSON; lists in document order, empty where there is nothing, missing values null. lists are those
    of report_lists(), which one chemical's dossier meets by ``by``, the key if none is given."""
    d = assemble(dossier, by or key, lists)
    full = lambda c: F.coalesce(F.col(c), F.array().cast(d.schema[c].dataType))
    codes = F.coalesce("h_codes", F.array().cast("array<string>"))
    return d.select(key, F.to_json(F.struct(
        F.struct(F.lit(generated_at).alias("timestamp"), F.col(key).alias("cas_number")).alias("query_info"),
        F.struct("iupac_name", "cid", "formula", "mw", "smiles", F.struct("dtxsid", "preferred_name").alias("dsstox")).alias("identifiers"),
        F.struct(joined(F.col("flash_point")).alias("flash_point"), joined(F.col("vapor_pressure")).alias("vapor_pressure")).alias("physical_properties"),
        F.struct(codes.alias("h_codes"), full("p_codes").alias("p_codes"), F.coalesce("signal_word", F.lit("")).alias("signal_word")).alias("ghs"),
        F.struct(F.filter(codes, lambda h: F.startswith(h, F.lit("H4"))).alias("h_codes_aquatic"), F.col("lc50").alias("aquatic_lc50_mg_l"), F.col("ec50").alias("aquatic_ec50_mg_l"), full("eco").alias("entries")).alias("ecotoxicity"),
        full("tox").alias("toxicity_endpoints"),
        F.col("has_toxvals").alias("toxvaldb_available"),
    ), {"ignoreNullFields": "false"}).alias("report"))
