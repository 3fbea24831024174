"""Toxicity values: look-ups, summaries, categories, payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, number, strip, study_category

# The categories of studies.
CATEGORIES = ["acute_toxicity", "carcinogenicity", "genotoxicity", "repeated_dose", "developmental", "reproductive", "neurotoxicity", "ecotoxicity", "other"]
PAYLOAD = "studyType string, study_type string, toxValNumeric string, toxval_numeric string, value string, toxValUnits string, toxval_units string, units string, species string, speciesName string, exposureRoute string, exposure_route string, reference string, citation string"


def coerce_numeric(df: DataFrame, column: str = "toxval_numeric") -> DataFrame:
    return df.withColumn(column, number(F.col(column)))


def numeric_only(df: DataFrame, column: str = "toxval_numeric") -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def union_sheets(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames with different columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_rows(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """rows(header array, cells array, ...) of any number of sheets under one set of columns: those given, or all headers in the order
    of their names, which takes a pass. A cell is that of the first header of the name; a sheet without it has null. The plan has
    one scan and a column for each header, however many sheets there are."""
    if columns is None:
        columns = [r["h"] for r in rows.select(F.explode("header").alias("h")).distinct().orderBy("h").collect()]
    at = lambda c: F.get("cells", F.nullif(F.array_position("header", c), F.lit(0)).cast("int") - 1)
    return rows.select(*[c for c in rows.columns if c not in ("header", "cells")], *[at(c).alias(c) for c in columns])


def sketches(df: DataFrame, by: str, column: str) -> DataFrame:
    """(name, rows, sketch): for each load its rows and a HyperLogLog sketch of the column's distinct values, some 4 KB; null
    isn't counted. Kept with the load, it is never computed from the rows again."""
    return df.groupBy(F.col(by).alias("name")).agg(F.count("*").alias("rows"), F.hll_sketch_agg(column, F.lit(12)).alias("sketch"))


def merged_sketches(kept: DataFrame, name: Column) -> DataFrame:
    """Sketches of loads put together under new names; the order and the grouping of unions don't change the counts much."""
    return kept.groupBy(name).agg(F.sum("rows").alias("rows"), F.hll_union_agg("sketch").alias("sketch"))


def sketch_counts(kept: DataFrame) -> DataFrame:
    """(name, rows, chemicals): about how many distinct values each sketch has seen; the standard error is 1.6 %."""
    return kept.select("name", "rows", F.hll_sketch_estimate("sketch").alias("chemicals"))


def toxvals_of(queries: DataFrame, toxvals: DataFrame, numeric: bool = False) -> DataFrame:
    """queries(dtxsid, ...) with all their toxicity rows; ids that don't start DTXSID have none."""
    asked = queries.filter(F.startswith(F.upper(strip(F.col("dtxsid"))), F.lit("DTXSID")))
    return asked.join(numeric_only(toxvals) if numeric else toxvals, "dtxsid")


def in_study_order(df: DataFrame, *ties: str) -> DataFrame:
    """Adds place, from 1 inside each substance: by study type, the missing one first, then by ``ties``. A reader sorts by it; nothing is
    sorted as a whole."""
    order = Window.partitionBy("dtxsid").orderBy(F.asc_nulls_first("study_type"), *ties)
    return df.withColumn("place", F.row_number().over(order).cast("long"))


def summary(toxvals: DataFrame, by: list[str]) -> DataFrame:
    """Records, numeric records, smallest and largest value of each group; partial sums before the shuffle."""
    v = F.col("toxval_numeric")
    return toxvals.groupBy(*by).agg(F.count("*").alias("record_count"), F.count(v).alias("numeric_count"), F.min(v).alias("min_value"), F.max(v).alias("max_value"))


def in_summary_order(summary: DataFrame, key: str) -> DataFrame:
    """Adds place, from 1 inside each key: study types with most records first, ties by name, the missing one last."""
    order = Window.partitionBy(key).orderBy(F.desc("record_count"), F.asc_nulls_last("study_type"))
    return summary.withColumn("place", F.row_number().over(order).cast("long"))


def table_stats(toxvals: DataFrame, registry: DataFrame) -> DataFrame:
    """(table, rows, chemicals) of both tables."""
    one = lambda df, name: df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.countDistinct("dtxsid").alias("chemicals"))
    return one(registry, "registry").unionByName(one(toxvals, "toxvals"))


def with_study_group(toxvals: DataFrame) -> DataFrame:
    return toxvals.withColumn("study_group", F.coalesce(blank_to_null(strip(F.col("study_type"))), F.lit("other")))


def with_category(toxvals: DataFrame, column: str = "study_type") -> DataFrame:
    return toxvals.withColumn("category", study_category(F.col(column)))


def category_counts(toxvals: DataFrame) -> DataFrame:
    """One row for each chemical with the number of its records in each category."""
    c = with_category(toxvals)
    return c.groupBy("dtxsid").agg(*[F.count_if(F.col("category") == x).alias(x) for x in CATEGORIES])


def read_payloads(df: DataFrame, column: str = "payload") -> DataFrame:
    """One row for each record of a JSON payload: a list under data or results, or a bare list; both spellings of the fields.

    A payload that is no JSON has no rows. Other columns stay."""
    doc = F.from_json(F.col(column), f"data array<struct<{_struct()}>>, results array<struct<{_struct()}>>")
    bare = F.from_json(F.col(column), f"array<struct<{_struct()}>>")
    is_list = F.startswith(F.ltrim(F.col(column)), F.lit("["))
    records = F.when(is_list, bare).otherwise(F.coalesce(doc["data"], doc["results"]))
    kept = [c for c in df.columns if c != column]
    r = df.select(*kept, F.explode(records).alias("r"))
    return r.select(
        *kept,
        F.coalesce("r.studyType", "r.study_type", F.lit("")).alias("study_type"),
        number(F.coalesce("r.toxValNumeric", "r.toxval_numeric", "r.value")).alias("value"),
        F.coalesce("r.toxValUnits", "r.toxval_units", "r.units", F.lit("")).alias("units"),
        F.coalesce("r.species", "r.speciesName", F.lit("")).alias("species"),
        F.coalesce("r.exposureRoute", "r.exposure_route", F.lit("")).alias("route"),
        F.coalesce("r.reference", "r.citation", F.lit("")).alias("reference"),
    ).withColumn("category", study_category(F.col("study_type")))


def _struct() -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.split() for x in PAYLOAD.split(", ")))
