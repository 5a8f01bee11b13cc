"""Helpers that the operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java form of the separators between words: the space and the controls 0x09 to 0x0D.
SEPARATORS = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this machine only where none is set and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        named = "file://" + tempfile.mkdtemp(prefix="pairloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialise(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, keeps column pruning, and
    outlives any executor. done: results of this function that nothing needs any longer; their files are deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    release(*done)
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of results of materialise."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def hex_crc_bucket(id_col: str | Column, buckets: int = 5) -> Column:
    """crc32 of the id as text, modulo buckets; the id null counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(buckets)
