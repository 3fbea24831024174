"""Registry and annotation files: discovery, one all-text scan for each kind of header, and what can't be read."""

from __future__ import annotations

import csv
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..operators import registry as R
from . import workbooks

CORRUPT = "_corrupt_record"
# What a placeholder of a large-file store says in its first bytes.
PLACEHOLDER = ["git-lfs", "oid sha256"]
#: What orders the rows of a folder's files: file, place of the split in it, row of the split.
ORDER = ["src_file", "block", "row_idx"]
REJECTS = "src_file string, reason string, line string"


def any_case(suffixes: tuple[str, ...]) -> str:
    """A glob of names with one of the suffixes, in any case."""
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes) + "}"


def discover(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("csv", "csv.gz", "xlsx", "xls")) -> DataFrame:
    """(path, length) of a folder's files with one of the suffixes, in the order of their names; contents aren't read."""
    return _listed(spark, folder, suffixes).select("path", "length").orderBy("path")


def _files(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", any_case(suffixes)).load(folder)
    return found.withColumn("src_file", F.col("_metadata.file_name"))


def _listed(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(src_file, path, length) of all files; scans leave empty ones out, listings don't."""
    found = _files(spark, folder, suffixes)
    names = [(unquote(p.rpartition("/")[2]), unquote(p)) for p in found.inputFiles()]
    every = spark.createDataFrame(names, "src_file string, listed string")
    return every.join(found.select("src_file", "path", "length"), "src_file", "left").select("src_file", F.coalesce("path", "listed").alias("path"), F.coalesce("length", F.lit(0)).cast("long").alias("length"))


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """(src_file, path, length, reason, header, breaks) of a folder's CSV files: why a file is left out, else null; its first line; whether
    quoted values of it have line breaks. One pass over the texts, aggregated before the shuffle.

    A placeholder, an empty file, one with bytes that are no UTF-8 text, and a compressed file that ends early have a reason.
    Compressed files may have up to 2 GB, as one task reads each."""
    every = _files(spark, folder, ("csv", "csv.gz"))
    fake = every.filter("length < 1024").filter(F.rlike(F.decode(F.substring("content", 1, 200), "iso-8859-1"), F.lit("|".join(PLACEHOLDER))))
    whole = every.filter(F.rlike("src_file", F.lit(r"(?i)\.gz$"))).select("src_file", "content").mapInPandas(_whole, "src_file string, whole boolean")
    lines = spark.read.option("pathGlobFilter", any_case(("csv", "csv.gz"))).option("ignoreCorruptFiles", True).text(folder)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    seen = lines.select(F.col("_metadata.file_name").alias("src_file"), "value", at.alias("at"), (quotes % 2 == 1).alias("odd"), F.rlike("value", F.lit("[\\x00�]")).alias("binary"))
    # The first line of a split is enough to find that of a file.
    seen = seen.groupBy("src_file").agg(F.min_by("value", "at").alias("header"), F.bool_or("odd").alias("breaks"), F.bool_or("binary").alias("binary"))
    named = _listed(spark, folder, ("csv", "csv.gz")).join(fake.select("src_file", F.lit(True).alias("fake")), "src_file", "left").join(whole, "src_file", "left").join(seen, "src_file", "left")
    reason = F.when(F.col("fake"), "placeholder").when(~F.col("whole"), "ends early").when(F.col("header").isNull(), "empty").when(F.col("binary"), "no text")
    return named.select("src_file", "path", "length", reason.alias("reason"), F.regexp_replace("header", "^﻿", "").alias("header"), "breaks")


def _whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whether compressed files decompress to their end."""
    for t in parts:
        good = []
        for content in t["content"]:
            data, end = bytes(content), False
            try:
                while data:
                    z, rest = zlib.decompressobj(31), data
                    for i in range(0, len(rest), 1 << 20):
                        z.decompress(rest[i : i + (1 << 20)])
                        if z.eof:
                            break
                    end, data = z.eof, (rest[i + (1 << 20) :] if z.eof else b"")
                    data = z.unused_data + data
            except zlib.error:
                end = False
            good.append(end)
        yield pd.DataFrame({"src_file": t["src_file"], "whole": good})


def scan_csv(spark: SparkSession, paths: str | list[str], header: list[str] | None = None, multi_line: bool = True) -> DataFrame:
    """CSV files with one header, every column text, nothing read as null; lines that don't fit are kept whole in _corrupt_record.

    Adds src_file, block and row_idx, which order the rows as the files have them. Without ``multi_line`` a large file is
    split; with it, quoted values may have line breaks."""
    if header is None:
        header = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(paths).columns
    schema = ST.StructType([ST.StructField(c, ST.StringType()) for c in [*header, CORRUPT]])
    df = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    df = df.option("multiLine", multi_line).option("nullValue", "\x00").option("emptyValue", "").option("columnPruning", False).csv(paths)
    return df.select("*", F.col("_metadata.file_name").alias("src_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row_idx"))


def _fits(columns: list[str]) -> Column:
    """Lines that fit. All columns are asked for as well: Spark reads no lines for the corrupt one alone."""
    return F.col(CORRUPT).isNull() & (F.length(F.concat_ws("", *[f"`{c}`" for c in columns])) >= 0)


def load_registry(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(registry, rejects): all CSV files and the first sheets of all workbooks of a folder under the ten fields, with ORDER's columns, which put
    rows of both kinds in one order; and (src_file, reason, line) of files and lines that are left out.

    Files are grouped by header, so the plan has a scan for each header and not for each file; a file's name, header and reason come to
    the driver, as any listing does. A file that can't be read doesn't stop the others."""
    found = profiles(spark, folder).orderBy("src_file").collect()
    bad = [(f["src_file"], f["reason"], None) for f in found if f["reason"]]
    groups: dict[tuple[tuple[str, ...], bool], list[str]] = defaultdict(list)
    for f in found:
        if f["reason"] is None:
            names = tuple(c.strip().upper() for c in next(csv.reader([f["header"]]), []))
            if set(R.ALIASES["cas"]) & set(names):
                groups[names, f["breaks"]].append(f["path"])
            else:
                bad.append((f["src_file"], "no registry number", None))
    good, lines = [], []
    for (names, breaks), paths in groups.items():
        own = [f"c{i}" for i in range(len(names))]  # headers may come twice; the first one counts
        raw = scan_csv(spark, paths, own, breaks)
        lines.append(raw.filter(~_fits(own)).select("src_file", F.lit("line").alias("reason"), F.col(CORRUPT).alias("line")))
        field = {f: own[names.index(a)] for f, aliases in R.ALIASES.items() for a in reversed(aliases) if a in names}
        good.append(raw.filter(_fits(own)).select(*[F.col(field[f]).alias(f) if f in field else F.lit(None).cast("string").alias(f) for f in R.FIELDS], *ORDER))
    if not discover(spark, folder, ("xlsx", "xls")).isEmpty():
        books = workbooks.scan(spark, folder, sheets="first", columns=",".join(sorted({a for names in R.ALIASES.values() for a in names})))
        fake = _files(spark, folder, ("xlsx", "xls")).filter("length < 1024").filter(F.rlike(F.decode(F.substring("content", 1, 200), "iso-8859-1"), F.lit("|".join(PLACEHOLDER)))).select("src_file")
        fake = {r["src_file"] for r in fake.collect()}
        broken = F.when(F.col("src_file").isin(*fake), "placeholder").otherwise(F.col("error"))
        without = F.when(~F.exists("header", lambda h: F.upper(h).isin(*R.ALIASES["cas"])), "no registry number")
        lines.append(books.filter("error is not null or row_idx = 0").select("src_file", F.when(F.col("error").isNotNull(), broken).otherwise(without).alias("reason"), F.lit(None).cast("string").alias("line")).filter("reason is not null"))
        fields = workbooks.columns(books, R.ALIASES)
        good.append(fields.select(*[R.na_to_null(F.col(f)).alias(f) for f in R.FIELDS], "src_file", F.lit(0).cast("long").alias("block"), "row_idx").filter("cas is not null"))
    none = spark.createDataFrame([], ", ".join(f"{f} string" for f in R.FIELDS) + ", src_file string, block long, row_idx long")
    return reduce(DataFrame.unionByName, good, none), reduce(DataFrame.unionByName, lines, spark.createDataFrame(bad, REJECTS))


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, doc): one JSON document in each file, its id the file's name."""
    texts = spark.read.text(folder, wholetext=True).select(F.col("value").alias("doc"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
    return texts.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("doc_id"), "doc")
