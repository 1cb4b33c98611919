"""Readers and writers: JSON, JSON lines and TSV corpora in, CSV reports out and in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _first(names: list[str], columns: list[str]) -> Column:
    held = [F.when(F.trim(F.col(f"`{n}`").cast("string")) != "", F.col(f"`{n}`").cast("string")) for n in names if n in columns]
    return F.coalesce(*held) if held else F.lit(None).cast("string")


def documents(raw: DataFrame) -> DataFrame:
    """(doc_id, title, text): the first filled of the known field names; a row without an id is an error."""
    key = _first(["doc_id", "id", "_id", "docno"], raw.columns)
    named = raw.select(key.alias("doc_id"), F.coalesce(_first(["title"], raw.columns), F.lit("")).alias("title"), F.coalesce(_first(["text", "contents", "body"], raw.columns), F.lit("")).alias("text"))
    return named.withColumn("doc_id", F.when(F.col("doc_id").isNull(), F.raise_error(F.lit("document without an id"))).otherwise(F.col("doc_id")))


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return documents(spark.read.option("multiLine", not lines).json(path))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query) of a TSV file; lines of fewer than two fields are left out."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where(F.size(parts) >= 2).select(F.trim(parts[0]).alias("query_id"), F.trim(parts[1]).alias("query"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    return qrels(spark.read.text(path))


def qrels(lines: DataFrame) -> DataFrame:
    """(query_id, iteration, doc_id, relevance) of lines (value) with three fields, or four and more."""
    parts = F.split("value", "\t")
    wide = F.size(parts) >= 4
    rows = lines.where(F.size(parts) >= 3)
    return rows.select(F.trim(parts[0]).alias("query_id"), F.when(wide, F.trim(parts[1])).otherwise("0").alias("iteration"), F.trim(F.when(wide, F.get(parts, F.lit(2))).otherwise(parts[1])).alias("doc_id"), F.trim(F.when(wide, F.get(parts, F.lit(3))).otherwise(parts[2])).cast("int").alias("relevance"))


BOM = "\ufeff"


def write_report(df: DataFrame, path: str) -> None:
    """A CSV report with names in its first line, after a byte order mark, and quotes doubled."""
    named = df.toDF(*(BOM * (i == 0) + c for i, c in enumerate(df.columns)))
    named.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A CSV report as strings; a byte order mark before the first name goes."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return df.toDF(*(c.lstrip(BOM) for c in df.columns))


def spread(df: DataFrame, least: int = 32 << 20) -> DataFrame:
    """Rows of a table of fewer than ``least`` bytes a core, parted over all cores: a file of one row group is read by one task.

    Larger tables have splits enough and are left as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * least else df
