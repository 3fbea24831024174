"""Tables and files that are written: each writer counts its rows in the write itself and returns what it wrote, as read back."""

from __future__ import annotations

import uuid
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import cas
from ..operators import registry as R

#: Bytes of a mapping file over which a host of repositories may reject it. Fixed value.
LARGE = 100 * 1024 * 1024


@dataclass
class Written:
    """A table as read back, its rows and bytes, and what else was counted on the way."""

    table: DataFrame
    rows: int
    bytes: int
    counts: dict[str, int] = field(default_factory=dict)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a table's data files, from their listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]


def observed(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """df that counts its rows, and those of each condition, while it is written."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()]), seen


def write_registry(registry: DataFrame, path: str) -> Written:
    """The registry sorted by compact number in ranges, so that readers skip row groups."""
    spark = registry.sparkSession
    keyed = registry.withColumn("cas_key", cas.compact(F.col("cas"))).repartitionByRange("cas_key").sortWithinPartitions("cas_key")
    df, seen = observed(keyed, with_dtxsid=F.col("dtxsid").isNotNull())
    df.write.mode("overwrite").parquet(path)
    return Written(spark.read.parquet(path), seen.get["rows"], size_of(spark, path), {"with_dtxsid": seen.get["with_dtxsid"]})


def write_toxvals(toxvals: DataFrame, path: str) -> Written:
    """Toxicity values in ranges of substances, sorted by study type inside them."""
    spark = toxvals.sparkSession
    df, seen = observed(toxvals.repartitionByRange("dtxsid", "study_type").sortWithinPartitions("dtxsid", "study_type"), numeric=F.col("toxval_numeric").isNotNull())
    df.write.mode("overwrite").parquet(path)
    return Written(spark.read.parquet(path), seen.get["rows"], size_of(spark, path), {"numeric": seen.get["numeric"]})


def write_buckets(df: DataFrame, path: str, key: str, buckets: int, *sort: str) -> Written:
    """df in ``buckets`` buckets of the key, sorted by it: tables of as many buckets are joined by the key without a shuffle.

    Choose buckets so that one has some 100 MB to 1 GB at the table's full size. The table has a name of its own in the session's
    catalog, which holds what the buckets are; the files lie at the path."""
    spark, name = df.sparkSession, f"chemloom_{uuid.uuid4().hex}"
    df, seen = observed(df.repartition(buckets, key))
    df.write.bucketBy(buckets, key).sortBy(key, *sort).mode("overwrite").option("path", path).saveAsTable(name)
    return Written(spark.table(name), seen.get["rows"], size_of(spark, path))


def write_mapping(registry: DataFrame, path: str, order: list[str]) -> Written:
    """The CASRN, DTXSID mapping as CSV, the first row of each number; warns if the files have over 100 MB in all."""
    spark = registry.sparkSession
    first = R.keep_first(registry.select(F.col("cas").alias("CASRN"), F.col("dtxsid").alias("DTXSID"), *order), "CASRN", order)
    df, seen = observed(first.select("CASRN", "DTXSID"), with_dtxsid=F.coalesce(F.col("DTXSID"), F.lit("")) != "")
    df.write.mode("overwrite").option("header", True).csv(path)
    done = Written(spark.read.schema("CASRN string, DTXSID string").option("header", True).csv(path), seen.get["rows"], size_of(spark, path), {"with_dtxsid": seen.get["with_dtxsid"]})
    if done.bytes > LARGE:
        warnings.warn(f"the mapping has {done.bytes / 1024 / 1024:.1f} MB; a host may reject it", stacklevel=2)
    return done


def write_report(report: DataFrame, path: str, key: str = "CAS", order: str = "Row", buckets: int = 16, most: int = 1_000_000) -> Written:
    """The flat report as CSV files with headers, in a folder for each hash bucket of the chemical, at most ``most`` rows a file; what is
    read back must equal what was written, in number and in the sum of its rows' hashes, else RuntimeError.

    Every task writes its rows where they are, sorted, into the buckets it has: the report isn't shuffled again, and as many tasks
    write it as made it, not one for each bucket."""
    spark, names = report.sparkSession, report.columns
    digest = F.sum(F.xxhash64(*names).cast("decimal(38,0)")).alias("digest")
    seen = Observation()
    dealt = report.observe(seen, F.count(F.lit(1)).alias("rows"), digest).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    dealt = dealt.sortWithinPartitions("bucket", key, order)
    style = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    dealt.write.mode("overwrite").partitionBy("bucket").options(**style, maxRecordsPerFile=most).csv(path)
    back = spark.read.schema(report.schema).options(**style, nullValue="\x00", emptyValue="", multiLine=True, recursiveFileLookup=True).csv(path)
    found = back.agg(F.count(F.lit(1)).alias("rows"), digest).first()
    if (found["rows"], found["digest"]) != (seen.get["rows"], seen.get["digest"]):
        raise RuntimeError(f"wrote {seen.get['rows']} rows, read back {found['rows']} or others")
    return Written(back, found["rows"], size_of(spark, path))


def write_json_reports(reports: DataFrame, path: str, key: str = "cas", buckets: int = 16, compression: str = "gzip") -> Written:
    """Nested reports (key, report) as lines of JSON texts in folders of hash buckets, one report a line; written by the tasks that
    made them, not by one for each bucket. The texts repeat their names and are far larger than what they are made of: they are
    compressed, "none" leaves them plain. A compressed file is read by one task; there is one for each task and bucket."""
    spark = reports.sparkSession
    df, seen = observed(reports.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    df.select(F.col("report").alias("value"), "bucket").write.mode("overwrite").partitionBy("bucket").option("compression", compression).text(path)
    back = spark.read.option("recursiveFileLookup", True).text(path).withColumnRenamed("value", "report")
    return Written(back, seen.get["rows"], size_of(spark, path))


def write_rejects(df: DataFrame, path: str, column: str = "cas", compat: bool = False) -> Written:
    """Rows whose registry number isn't valid, in a folder for each status; counts has the rows of every status, the valid ones
    too. One scan of df feeds both."""
    spark = df.sparkSession
    judged, seen = observed(df.withColumn("status", cas.status(F.col(column), compat)), **{s: F.col("status") == s for s in cas.STATUSES})
    judged.filter("status <> 'valid'").write.mode("overwrite").partitionBy("status").parquet(path)
    got = seen.get
    back = spark.read.schema(judged.schema).parquet(path)
    return Written(back, got["rows"] - got["valid"], size_of(spark, path), {s: got[s] for s in cas.STATUSES})
