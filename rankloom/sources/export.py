"""Corpora from raw records: documents, queries and judgements in one form, exported, ingested and read in batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from rankloom.functions.text import Profile, clean_text, repaired, tokens

# Names under which raw records hold their fields.
ID = ("doc_id", "docid", "id", "_id", "docno")
TITLE = ("title", "headline", "subject")
CLINICAL = ("condition", "summary", "detailed_description", "eligibility")
TEXT = ("text", "body", "contents", "content", "answer", "passage", "argument")
QUERY_ID, QUERY_PARTS, QUERY_TEXT = ("query_id", "qid", "id"), ("disease", "gene", "demographic", "other"), ("text", "query", "title", "description")
RELEVANCE = ("relevance", "rel", "score")


def _held(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
    return [F.col(f"`{n}`").cast("string") for n in names if n in df.columns]


def _first(df: DataFrame, names: tuple[str, ...], what: str | None = None) -> Column:
    """The first of the fields that is not null; an error if ``what`` is named and there is none."""
    held = F.coalesce(*_held(df, names), F.lit(None).cast("string"))
    return F.coalesce(held, F.raise_error(F.lit(f"record without {what}")).cast("string")) if what else held


def _joined(parts: list[Column]) -> Column:
    """Cleaned parts that are not empty, joined by a space."""
    return F.array_join(F.filter(F.array(*(clean_text(p) for p in parts)), lambda x: x != ""), " ") if parts else F.lit("")


def documents(raw: DataFrame) -> DataFrame:
    """(doc_id, title, text): clinical records join their parts; others have the first text field, or all other text joined."""
    key, title = clean_text(_first(raw, ID, "a document id")), clean_text(F.coalesce(_first(raw, TITLE), F.lit("")))
    if any(c in raw.columns for c in CLINICAL):
        text = _joined(_held(raw, CLINICAL))
    else:
        others = []
        for f in raw.schema.fields:
            if f.name not in (*ID, *TITLE, *TEXT):
                if isinstance(f.dataType, StringType):
                    others.append(F.col(f"`{f.name}`"))
                elif isinstance(f.dataType, ArrayType):
                    cleaned = F.transform(F.col(f"`{f.name}`"), lambda x: clean_text(x.cast("string")))
                    others.append(F.array_join(F.filter(cleaned, lambda x: x != ""), " "))
        first = _first(raw, TEXT)
        text = F.when(first.isNotNull(), clean_text(first)).otherwise(_joined(others))
    return raw.select(key.alias("doc_id"), title.alias("title"), text.alias("text"))


def queries(raw: DataFrame) -> DataFrame:
    """(query_id, query): records with a disease join their parts, others have their first text field; none is an error."""
    key = clean_text(_first(raw, QUERY_ID, "a query id"))
    text = _joined(_held(raw, QUERY_PARTS)) if "disease" in raw.columns else clean_text(_first(raw, QUERY_TEXT, "a query text"))
    return raw.select(key.alias("query_id"), F.when(text == "", F.raise_error(F.lit("record without a query text")).cast("string")).otherwise(text).alias("query"))


def judgements(raw: DataFrame) -> DataFrame:
    """(query_id, doc_id, relevance): whole numbers, 0 where none is given."""
    relevance = F.coalesce(_first(raw, RELEVANCE).try_cast("double").cast("int"), F.lit(0))
    return raw.select(clean_text(_first(raw, QUERY_ID[:2], "a query id")).alias("query_id"), clean_text(_first(raw, ID[:2], "a document id")).alias("doc_id"), relevance.alias("relevance"))


def exported(rows: DataFrame, key: str, order: str, limit: int | None = None) -> DataFrame:
    """The first row of each id by ``order``, and of these the first ``limit``."""
    first = Window.partitionBy(key).orderBy(order)
    kept = rows.where(F.trim(F.col(key).cast("string")) != "").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return kept.orderBy(order).limit(limit) if limit is not None else kept


def processed(query_rows: DataFrame, profile: Profile) -> DataFrame:
    """Queries with ``processed_query``, their terms joined, as they are stored at ingest."""
    return query_rows.withColumn("processed_query", F.array_join(tokens(repaired(F.col("query")), profile), " "))


def ingest(df: DataFrame, path: str, dataset: str) -> None:
    """Store a table's rows as the partition of one data set, in place of what was there; other data sets stay.

    A partition is replaced as a whole when all of it is written, so an import that breaks off is just started again.
    """
    rows = df.withColumn("dataset_key", F.lit(dataset))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_key").parquet(path)


def batches(docs: DataFrame, key: str = "doc_id", size: int = 1000) -> Iterator[pa.Table]:
    """A corpus in the order of its ids, in tables of at most ``size`` rows; one partition at a time is on the driver."""
    names, held = docs.columns, []
    for row in docs.orderBy(key).toLocalIterator(prefetchPartitions=False):
        held.append(row)
        if len(held) == size:
            yield pa.table({c: [r[c] for r in held] for c in names})
            held = []
    if held:
        yield pa.table({c: [r[c] for r in held] for c in names})
