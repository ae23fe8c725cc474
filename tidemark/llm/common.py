"""Shared plumbing: durable intermediate tables, vocabulary shipping, Arrow row iteration."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only for a local master whose session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def spool(df: DataFrame) -> DataFrame:
    """Write df once as compressed Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(schema).parquet(path)


def ship(spark: SparkSession, path: str):
    """Broadcast a vocabulary file's bytes (a public file of under 2 MB), so that executors need not have the path."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def rows(batch: pa.RecordBatch, step: int = 256) -> Iterator[tuple]:
    """Python tuples of a batch, converted a few rows at a time to bound memory."""
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def crc_mod(col: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(mod)


def crc_text(value) -> int:
    return zlib.crc32(str(value).encode())
