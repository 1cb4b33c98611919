"""The document store as key-partitioned tables: upserts, lookups, counts and referential checks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, the newer row of a key winning; keys are trimmed, rows with a blank key are an error."""
    def clean(df: DataFrame, age: int) -> DataFrame:
        for k in keys:
            text = F.trim(F.col(k).cast("string"))
            df = df.withColumn(k, F.when(text.isNull() | (text == ""), F.raise_error(F.lit(f"blank {k}")).cast(df.schema[k].dataType)).otherwise(text.cast(df.schema[k].dataType)))
        return df.withColumn("_age", F.lit(age))

    # of rows of one key and age the first by content stays, so that reruns agree
    last = Window.partitionBy(*keys).orderBy(F.desc("_age"), F.to_json(F.struct(*old.columns)))
    return clean(old, 0).unionByName(clean(new, 1)).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_age")


def first_of_id(docs: DataFrame, order: str, key: str = "doc_id") -> DataFrame:
    """The first row of each id by the given order."""
    return docs.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def get(table: DataFrame, key: str, value) -> dict | None:
    """One row by its key, or None; the key reaches the scan, so a table sorted or parted by it is read in one place."""
    row = table.where(F.col(key) == F.lit(value)).limit(1).first()
    return row.asDict(recursive=True) if row else None


def fetch(docs: DataFrame, ids: list, key: str = "doc_id") -> DataFrame:
    """Rows in the order of the requested ids, repeats kept, missing ones left out; adds pos."""
    wanted = docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"pos int, {key} {dict(docs.dtypes)[key]}")
    return wanted.join(docs, key).orderBy("pos")


def counts(docs: DataFrame, by: str) -> DataFrame:
    return docs.groupBy(by).agg(F.count("*").alias("n"))


def dangling(qrels: DataFrame, docs: DataFrame, key: str = "doc_id", most: int = 100) -> DataFrame:
    """Distinct keys of judgements that the store lacks, the first so many."""
    return qrels.select(key).distinct().join(docs.select(key), key, "left_anti").orderBy(key).limit(most)


def judged_subset(qrels: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct judgements whose query and document are both kept."""
    return qrels.join(queries.select("query_id"), "query_id", "left_semi").join(docs.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["query_id", "doc_id", "relevance"])


def signature(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.agg(F.count("*").alias("n"), F.min(key).alias("least"), F.max(key).alias("greatest"))


def without_dataset(tables: dict[str, DataFrame], dataset: str) -> dict[str, DataFrame]:
    """All tables of the store after a data set's removal; in tables parted by dataset_key its partitions aren't read."""
    return {name: t.where(F.col("dataset_key") != dataset) for name, t in tables.items()}


def relevance_sample(queries: DataFrame, qrels: DataFrame, docs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(queries, documents): queries are taken in order, each if the union of relevant documents stays within ``limit``.

    A query's new documents are those that no taken query has, so the scan hangs on its own past. It runs in one task over
    judged pairs only, sorted by query, and keeps at most ``limit`` ids; fillers by doc_id complete the documents.
    """
    kinds = dict(queries.dtypes)["query_id"], dict(docs.dtypes)["doc_id"]
    pairs = qrels.where("relevance > 0").join(queries.select("query_id"), "query_id", "left_semi").select(F.col("query_id").cast(kinds[0]).alias("query_id"), F.col("doc_id").cast(kinds[1]).alias("doc_id")).distinct()
    lists = pairs.groupBy("query_id").agg(F.collect_set("doc_id").alias("docs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: set = set()
        for batch in batches:
            for q, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = [d for d in sorted(own) if d not in taken]
                if len(taken) + len(new) <= limit:
                    taken.update(new)
                    yield pa.RecordBatch.from_arrays([pa.array([q], batch.schema.field(0).type), pa.array([new], batch.schema.field(1).type)], ["query_id", "docs"])

    # a query with more documents than the limit can't be taken: it needn't go to the task
    small = lists.where(F.size("docs") <= limit)
    chosen = small.repartition(1).sortWithinPartitions("query_id").mapInArrow(run, f"query_id {kinds[0]}, docs array<{kinds[1]}>")
    held = chosen.select(F.explode("docs").alias("doc_id"))
    relevant = docs.join(held, "doc_id", "left_semi")
    room = limit - held.count()
    filler = docs.join(held, "doc_id", "left_anti").orderBy("doc_id").limit(room)
    return queries.join(chosen, "query_id", "left_semi"), relevant.unionByName(filler)
