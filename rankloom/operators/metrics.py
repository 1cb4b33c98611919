"""Ranked-retrieval metrics of rankings against judgements (query_id, doc_id, relevance), all queries in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_results(ranking: DataFrame) -> DataFrame:
    """First occurrence of each document, blank ones dropped, ranks counted anew."""
    first = Window.partitionBy("query_id", "doc_id").orderBy("rank")
    again = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    kept = ranking.where(F.trim(F.col("doc_id").cast("string")) != "").withColumn("n", F.row_number().over(first)).where("n = 1")
    return kept.drop("n").withColumn("rank", F.row_number().over(again))


def per_query(ranking: DataFrame, qrels: DataFrame, k: int = 10, depth: int = 1000, ndcg_k: int | None = None) -> DataFrame:
    """(query_id, precision, recall, ap, ndcg) for each judged query; a query without results has zeros.

    Precision divides by k, recall and average precision by all relevant documents; gains are 2^relevance - 1.
    """
    cut = ndcg_k or k
    judged = qrels.groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"))
    gain = lambda rel, rank: (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1.0)
    ideal_order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id")
    ideal = judged.withColumn("i", F.row_number().over(ideal_order)).groupBy("query_id").agg(F.sum((F.col("relevance") > 0).cast("long")).alias("relevant"), F.sum(F.when(F.col("i") <= cut, gain(F.col("relevance"), F.col("i"))).otherwise(0.0)).alias("idcg"))
    ran = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = ranking.where(F.col("rank") <= depth).select("query_id", "doc_id", "rank").join(judged, ["query_id", "doc_id"], "left").withColumn("hit", (F.coalesce("relevance", F.lit(0)) > 0).cast("long")).withColumn("seen", F.sum("hit").over(ran))
    sums = hits.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias("top"),
        F.sum("hit").alias("all"),
        F.sum(F.col("hit") * F.col("seen") / F.col("rank")).alias("ap_sum"),
        F.sum(F.when(F.col("rank") <= cut, gain(F.coalesce("relevance", F.lit(0)), F.col("rank"))).otherwise(0.0)).alias("dcg"),
    )
    joined = ideal.join(sums, "query_id", "left")
    share = lambda a, b: F.round(F.when(b > 0, F.coalesce(a, F.lit(0.0)) / b).otherwise(0.0), 6)
    return joined.select(
        "query_id",
        F.round(F.coalesce(F.col("top"), F.lit(0)) / F.lit(float(k)), 6).alias("precision"),
        share(F.col("all").cast("double"), F.col("relevant")).alias("recall"),
        share(F.col("ap_sum"), F.col("relevant")).alias("ap"),
        share(F.col("dcg"), F.col("idcg")).alias("ndcg"),
    )


def summary(scores: DataFrame) -> DataFrame:
    """One row: means over all judged queries, and their number."""
    return scores.agg(F.count("*").alias("queries"), F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


def missing_queries(qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """Judged queries that have no text: a guard before an evaluation."""
    return qrels.select("query_id").distinct().join(queries, "query_id", "left_anti")


def guarded(queries: DataFrame, qrels: DataFrame, only: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries and judgements of the queries to evaluate; an error if ids are blank or repeated, or if asked or judged ones are unknown."""
    name = F.trim(F.col("query_id").cast("string"))
    row = queries.agg(F.count_if(F.coalesce(name, F.lit("")) == "").alias("blank"), (F.count("query_id") - F.countDistinct("query_id")).alias("repeated")).first()
    if row["blank"] or row["repeated"]:
        raise ValueError(f"{row['blank']} blank and {row['repeated']} repeated query ids")
    lost = [r[0] for r in missing_queries(qrels, queries).limit(5).collect()]
    if lost:
        raise ValueError(f"judged queries without a text: {lost}")
    if only is None:
        return queries.join(qrels, "query_id", "left_semi"), qrels
    wanted = queries.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(only)], f"query_id {dict(queries.dtypes)['query_id']}")
    unknown = [r[0] for r in wanted.join(queries.join(qrels, "query_id", "left_semi"), "query_id", "left_anti").limit(5).collect()]
    if unknown:
        raise ValueError(f"asked queries without a text or judgements: {unknown}")
    return queries.join(wanted, "query_id", "left_semi"), qrels.join(wanted, "query_id", "left_semi")
