"""Structured Streaming over a directory that grows: the checkpoint remembers which files are done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.plans.mining import document_windows


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def ingest_sentences(spark: SparkSession, path: str, out: str, checkpoint: str, schema: str = "doc_id long, text string, lang string"):
    """Starts a query that works off what is there and ends; run again, it takes the new files only. The file sink's
    log makes each file's output appear once, also after a failure."""
    windows = document_windows(read_stream(spark, path, schema))
    return (
        windows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
