"""What the operators share: reading tables, cutting lineage, words of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes other than these; the pattern is the same on UTF-8 bytes and on characters.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: bytes.translate() tables: A-Z to a-z; the same with everything else that is ASCII and no letter or digit as blanks.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ALNUM = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where a session of one machine names none (tests) a temporary one is set;
    on a cluster that is an error, as machines would not see each other's files."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes df as a table in the shared folder and reads it back: later steps don't recompute it, whatever executor is lost.

    Returns the table and its path, for discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chemloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that cut() wrote and that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, how: str = "inner", hot: int = 256) -> DataFrame:
    """left joined to right, which has each key once and, as ``n``, how many of left's ``total`` rows have it.

    Keys with over 1/``hot`` of all rows, fewer than ``hot`` by their definition, are joined by broadcast where the rows lie;
    the other keys are shuffled, none of them with a large share. ``how`` is inner, left or left_semi; n doesn't come back."""
    often = F.col(n) * hot > total
    large, small = right.filter(often).drop(n), right.filter(~often).drop(n)
    rest = left.join(F.broadcast(large.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(large), keys, "inner" if how == "left" else how).unionByName(rest.join(small, keys, how))


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text; none for a null."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def each_text(batch: pa.RecordBatch, name: str | None = None, step: int = 256) -> Iterator[bytes]:
    """A batch's texts as bytes, none for nulls: its column t, or the named field of its column row. A few rows are held at a time."""
    column = batch.column("t") if name is None else pc.struct_field(batch.column("row"), name).cast(pa.binary())
    for at in range(0, len(column), step):
        for x in column.slice(at, step).to_pylist():
            yield x or b""


def per_batch(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with one output batch for each input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def equal_text_key(name: str = "text") -> list[Column]:
    """96 bits and the length, the same for equal texts; for different texts they agree with a chance below 1e-12 at 1e8 texts."""
    b = text_bytes(name)
    return [F.xxhash64(b).alias("key_a"), F.crc32(b).alias("key_b"), F.octet_length(b).cast("long").alias("key_n")]
