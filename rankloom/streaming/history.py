"""Search history as a stream: valid records are appended to Parquet, each exactly once over restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "user_id string, dataset string, query string, created_at timestamp"


def valid(records: DataFrame) -> DataFrame:
    """Records with trimmed fields; one with a null or blank user, data set or query is left out."""
    for c in ("user_id", "dataset", "query"):
        records = records.withColumn(c, F.trim(c))
    return records.where((F.col("user_id") != "") & (F.col("dataset") != "") & (F.col("query") != ""))


def append_history(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what a stream of records holds by now, then stop; both folders are to be shared ones on a cluster."""
    return valid(records).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def query_counts(records: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, dataset, n): searches of each window, for a stream or a table; a stream drops records later than ``late``."""
    return valid(records).withWatermark("created_at", late).groupBy(F.window("created_at", window).alias("w"), "dataset").agg(F.count("*").alias("n")).select("w.start", "dataset", "n")
