"""Endpoints from toxicity texts: units, species, ecotoxicity, exposure bands, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Thresholds of the exposure bands.
BANDS = {"oral": [5, 50, 300, 2000, 5000], "dermal": [50, 200, 1000, 2000, 5000], "inhalation": [100, 500, 2500, 20000]}


def mine(texts: DataFrame, value: str = "value") -> DataFrame:
    """Adds unit, species_route, route and species to rows with a text."""
    return T.with_route_and_species(T.with_species_route(texts.withColumn("unit", T.unit_of(F.col(value))), value), value, "species_route")


def naming(texts: DataFrame, what: str, value: str = "value") -> DataFrame:
    """Rows whose text names LD50 or LC50, in any case."""
    return texts.filter(F.contains(F.upper(value), F.lit(what)))


def ecotox_entries(texts: DataFrame, value: str = "value") -> DataFrame:
    """Aquatic rows with their parsed sentence. Units aren't converted; a missing unit reads mg/L; value_mg_l is converted."""
    low = F.col("__low")
    a = T.with_once(T.with_once(texts, "__low", F.lower(value)).filter(T.has_any(low, T.AQUATIC)), "e", T.ecotox(F.col(value)))
    scale = F.when(F.lower("e.unit") == "mg/l", 1.0).when(F.lower("e.unit").isin("µg/l", "ug/l"), 1e-3).when(F.lower("e.unit") == "g/l", 1e3)
    kept = [c for c in texts.columns if c != value]
    return a.select(*kept, *[c.alias(n) for n, c in _entry(F.col("e"), F.col(value), low).items()], (F.col("e.value_num") * scale).alias("value_mg_l"))


def with_ecotox(texts: DataFrame, value: str = "value") -> DataFrame:
    """All rows, with the fields of ecotox_entries() but value_mg_l as the struct eco of the aquatic ones, null on the others."""
    low = F.col("__low")
    entry = T.once(T.ecotox(F.col(value)), lambda e: F.struct(*[c.alias(n) for n, c in _entry(e, F.col(value), low).items()]))
    return T.with_once(T.with_once(texts, "__low", F.lower(value)), "eco", F.when(T.has_any(low, T.AQUATIC), entry)).drop("__low")


def _entry(e: Column, value: Column, low: Column) -> dict[str, Column]:
    out = {"value": F.substring(value, 1, 400), "species": T.aquatic_species(low), "unit": F.coalesce(e["unit"], F.lit("mg/L"))}
    return out | {c: e[c] for c in ("endpoint", "duration", "value_num", "ci_low", "ci_high", "conditions")}


def ecotox_summary(texts: DataFrame, chem: str, ordinal: str, value: str = "value") -> DataFrame:
    """(chem, lc50, ec50, species, excerpt, entries): LC50 is the first value that isn't 0 of an endpoint other than EC...,
    EC50 and the excerpt are the last, the species is the first. A chemical without aquatic rows falls back on its first text
    with LC50, mg and a capital L: that gives an excerpt and an entry, no number."""
    own, o = ecotox_own(ecotox_entries(texts.select(chem, ordinal, value), value), chem, ordinal), F.col(ordinal)
    t = F.col(value)
    last = texts.filter(F.contains(F.upper(t), F.lit("LC50")) & F.contains(F.lower(t), F.lit("mg")) & F.contains(t, F.lit("L")))
    last = last.groupBy(chem).agg(F.min_by(F.substring(t, 1, 250), o).alias("other"))
    both = own.join(last, chem, "full")
    return both.select(chem, "lc50", "ec50", "species", F.when(F.col("entries").isNull(), F.col("other")).otherwise(F.col("excerpt")).alias("excerpt"), F.coalesce("entries", F.lit(1)).cast("long").alias("entries"))


def ecotox_own(entries: DataFrame, chem: str, ordinal: str) -> DataFrame:
    """The summary of the chemicals that have aquatic rows."""
    o, v = F.col(ordinal), F.col("value_num")
    lc50, ec50 = aquatic_doses(v, F.col("endpoint"), o)
    return entries.groupBy(chem).agg(
        lc50.alias("lc50"),
        ec50.alias("ec50"),
        F.min_by("species", F.when(v.isNotNull(), o)).alias("species"),
        F.max_by(F.substring("value", 1, 250), F.when(v.isNotNull(), o)).alias("excerpt"),
        F.count("*").alias("entries"),
    )


def aquatic_doses(v: Column, endpoint: Column, o: Column) -> tuple[Column, Column]:
    """Aggregates for a chemical: the first value that isn't 0 of an endpoint other than EC..., the last of one that is."""
    is_ec = F.coalesce(F.startswith(endpoint, F.lit("EC")), F.lit(False))
    return F.min_by(v, F.when(v.isNotNull() & (v != 0) & ~is_ec, o)), F.max_by(v, F.when(v.isNotNull() & is_ec, o))


def split_ecotox(entries: DataFrame) -> DataFrame:
    """Entries with kind quantitative or text, and the interval as text."""
    ci = F.when(F.col("ci_low").isNotNull() & F.col("ci_high").isNotNull(), F.concat_ws("–", F.col("ci_low").cast("string"), F.col("ci_high").cast("string"))).otherwise("")
    return entries.withColumns({"kind": F.when(F.col("value_num").isNotNull(), "quantitative").otherwise("text"), "ci": ci})


def exposure_bands(texts: DataFrame, chem: str, ordinal: str, value: str = "value") -> DataFrame:
    """(chem, pathway, dose, unit, band): the first qualifying oral LD50, dermal LD50 and inhalation LC50 of each chemical."""
    v, o = F.col("__low"), F.col(ordinal)
    has = lambda p: F.contains(v, F.lit(p))
    per_kg = T.extract(v, r"(\d+(?:\.\d+)?)\s*mg\s*/\s*kg", 1).try_cast("double")
    per_m = F.replace(T.extract(v, r"(\d+(?:[.,]\d+)*)\s*mg\s*/\s*m", 1), F.lit(","), F.lit("")).try_cast("double")
    skin = has("dermal") | has("skin")
    doses = {
        "oral": F.when(has("ld50") & has("mg") & has("kg") & ~skin, per_kg),
        "dermal": F.when(skin & has("ld50"), per_kg),
        "inhalation": F.when(has("lc50"), per_m),
    }
    # What can't give a dose doesn't reach the shuffle.
    near = T.with_once(T.with_once(texts, "__low", F.lower(value)), "__doses", F.struct(*[d.alias(p) for p, d in doses.items()])).select("*", "__doses.*").filter(F.coalesce(*doses).isNotNull())
    first = near.groupBy(chem).agg(*[F.min_by(p, F.when(F.col(p).isNotNull(), o)).alias(p) for p in doses])
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("pathway"), F.col(p).alias("dose"), F.lit("mg/m3" if p == "inhalation" else "mg/kg").alias("unit"), T.band(F.col(p), BANDS[p]).alias("band")) for p in doses]))
    return first.select(chem, rows.alias("x")).select(chem, "x.*").filter("dose is not null")


def union_endpoints(mined: DataFrame, toxvals: DataFrame, chem: str = "chem") -> DataFrame:
    """Endpoints of both sources with one set of columns: (chem, ordinal, source, endpoint, value, value_num, unit, species,
    route, details). mined has type and source_section; toxvals has study_type, toxval_numeric, toxval_units."""
    a = mined.select(chem, "ordinal", F.lit("PubChem").alias("source"), F.coalesce(T.blank_to_null(T.strip(F.col("type"))), F.lit("Toxicity")).alias("endpoint"), F.coalesce("value", F.lit("")).alias("value"), F.lit(None).cast("double").alias("value_num"), "unit", "species", "route", F.coalesce("source_section", F.lit("")).alias("details"))
    b = toxvals.select(chem, "ordinal", F.lit("ToxValDB").alias("source"), F.col("study_type").alias("endpoint"), F.coalesce(F.col("toxval_numeric").cast("string"), F.lit("")).alias("value"), F.col("toxval_numeric").alias("value_num"), F.col("toxval_units").alias("unit"), F.lit(None).cast("string").alias("species"), F.lit(None).cast("string").alias("route"), F.lit("").alias("details"))
    return a.unionByName(b)


def prioritize(endpoints: DataFrame) -> DataFrame:
    """Adds priority: quantitative if there is a unit and the value starts with a number, else categorical; long details are
    cut to 80 characters and dots."""
    good = (F.coalesce(F.col("unit"), F.lit("")) != "") & (F.col("value_num").isNotNull() | T.has_number(F.col("value")))
    cut = F.when(F.length("details") > 80, F.concat(F.substring("details", 1, 80), F.lit("..."))).otherwise(F.col("details"))
    return endpoints.withColumns({"priority": F.when(good, "quantitative").otherwise("categorical"), "details": cut})


def display(prioritized: DataFrame, chem: str = "chem") -> DataFrame:
    """The display table; categorical values are cut to 200 characters, missing texts are empty or dashes."""
    value = F.when(F.col("priority") == "categorical", F.substring("value", 1, 200)).otherwise(F.col("value"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return prioritized.select(chem, "ordinal", F.initcap("priority").alias("type"), F.coalesce("endpoint", F.lit(T.DASH)).alias("endpoint"), value.alias("value"), "value_num", blank(F.col("unit")).alias("units"), blank(F.col("species")).alias("species"), blank(F.col("route")).alias("route"), "source")


def quantitative_first(displayed: DataFrame, chem: str = "chem") -> DataFrame:
    """Adds place, from 1 inside each chemical: quantitative rows first, PubChem before ToxValDB, then document order. A reader sorts by it;
    nothing is sorted as a whole."""
    return displayed.withColumn("place", F.row_number().over(Window.partitionBy(chem).orderBy(F.desc("type"), "source", "ordinal")).cast("long"))


def complete(endpoints: DataFrame, chem: str = "chem") -> DataFrame:
    """All endpoints without cuts, dashes for what is missing."""
    dash = lambda c: F.coalesce(T.blank_to_null(F.col(c)), F.lit(T.DASH)).alias(c)
    return endpoints.select(chem, "ordinal", "source", dash("route"), dash("species"), dash("endpoint"), "value", "value_num", dash("unit"))
