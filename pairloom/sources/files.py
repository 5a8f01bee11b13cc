"""File readers and writers. Compression follows the suffix; directories and globs work everywhere a path does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR_SCHEMA = "complex string, simple string"


def read_lines(spark: SparkSession, path: str, n_lines: int | None = None) -> DataFrame:
    """value, one row per line, without the line feed; any n_lines of them if given."""
    df = spark.read.text(path)
    return df if n_lines is None else df.limit(n_lines)


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, value): lines numbered from 0 over the files in the order of their paths.

    Files are read whole lines at a time and in order within a file; a file is one partition here, so that the number
    of a line is its place. Offsets of files come from their counts.
    """
    spark_files = spark.read.text(path, wholetext=True)
    lines = spark_files.select(
        F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("pos", "value")
    )
    from pairloom.operators.datasets import id_offsets

    offsets = id_offsets(lines, "file").select("file", "offset")
    return lines.join(offsets, "file").select((F.col("offset") + F.col("pos")).alias("row_id"), "value")


def write_lines(df: DataFrame, path: str, column: str = "value", compression: str = "none") -> None:
    df.select(F.col(column).alias("value")).write.option("compression", compression).text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """raw_content of JSON lines; other fields are never parsed into columns."""
    return spark.read.schema("raw_content string").json(path)


def split_shards(docs: DataFrame, path: str, docs_per_file: int = 50_000) -> None:
    """Writes files of docs_per_file rows at most."""
    docs.write.option("maxRecordsPerFile", docs_per_file).mode("ignore").parquet(path)


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Sorted paths of the files below path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length").orderBy("path")


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Two fields with a tab between them, for interchange; a tab or line feed within a field becomes a space."""
    flat = [F.translate(F.col(c), "\t\n", "  ") for c in ("complex", "simple")]
    pairs.select(F.concat_ws("\t", *flat).alias("value")).write.text(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR_SCHEMA).option("sep", "\t").option("quote", "").option("escape", "").csv(path)


def write_dataset(df: DataFrame, path: str) -> None:
    """df(dataset, phase, row_id, complex, simple array<string>)."""
    df.write.partitionBy("dataset", "phase").mode("overwrite").parquet(path)


def read_dataset(spark: SparkSession, path: str, dataset: str | None = None, phase: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    for name, value in (("dataset", dataset), ("phase", phase)):
        df = df if value is None else df.where(F.col(name) == value)
    return df


def read_word_ranks(spark: SparkSession, path: str, vocabulary: int = 100_000) -> DataFrame:
    """(word, rank) of a word-vector file: its first line is a header, each other one starts with a word."""
    rows = read_numbered_lines(spark, path).where(F.col("row_id").between(1, vocabulary))
    return rows.select(F.split("value", " ")[0].alias("word"), (F.col("row_id") - 1).cast("int").alias("rank"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score rows of JSON files under .../<language>/<dataset>/<phase>/<exp_name>/<job_id>.json."""
    df = spark.read.schema("sari double, bleu double, fkgl double").json(path)
    parts = r"([^/]+)/([^/]+)/([^/]+)/([^/]+)/([^/]+)\.json$"
    names = ("language", "dataset", "phase", "exp_name", "job_id")
    df = df.withColumn("__f", F.col("_metadata.file_path"))
    return df.select(*[F.regexp_extract("__f", parts, i + 1).alias(n) for i, n in enumerate(names)], "sari", "bleu", "fkgl")
