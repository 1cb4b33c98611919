"""Learning to rank: candidates of several models as one feature row, a boosted-tree regressor, and its ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import Profile, repaired, terms, tokens
from rankloom.operators import metrics

MODELS = ("bm25", "tfidf", "embedding", "biomedical_embedding")
# The short name of the last model in feature names, and the features that explain a result.
SHORT = {m: m.removesuffix("_embedding") for m in MODELS}
IMPORTANT = ("bm25_score", "bm25_rank", "tfidf_score", "embedding_score", "query_term_overlap_ratio", "title_query_overlap_ratio", "rrf_sum")
IMPORTANT_MEDICAL = ("biomedical_score", "biomedical_rank")


def features(rankings: dict[str, DataFrame], queries: DataFrame, docs: DataFrame, profile: Profile, rrf_k: int = 60) -> DataFrame:
    """(query_id, doc_id, 27 features) of every document that any of the rankings holds; what is missing is 0.

    Scores, ranks, presence and reciprocal ranks by model and their sum; tokens of query, title, text and both; distinct
    query tokens in both and in the title, and their share; whether title or text holds the query word for word.
    docs: (doc_id, text) and, if there is one, title. Each candidate's text is cut once, however many queries ask for it.
    """
    parts = [rankings[m].select("query_id", "doc_id", F.lit(SHORT[m]).alias("model"), "score", F.col("rank").cast("double").alias("rank")) for m in MODELS if m in rankings]
    names = list(SHORT.values())
    wide = reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(
        *(F.coalesce(F.max(F.when(F.col("model") == m, F.col(c))), F.lit(0.0)).alias(f"{m}_{c}") for m in names for c in ("score", "rank"))
    )
    wide = wide.withColumns({f"in_{m}": (F.col(f"{m}_rank") > 0).cast("double") for m in names})
    wide = wide.withColumns({f"reciprocal_rank_{m}": F.when(F.col(f"{m}_rank") > 0, 1.0 / (rrf_k + F.col(f"{m}_rank"))).otherwise(0.0) for m in names})
    wide = wide.withColumn("rrf_sum", reduce(lambda a, b: a + b, [F.col(f"reciprocal_rank_{m}") for m in names]))
    flat = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    title = F.col("title") if "title" in docs.columns else F.lit("")
    # candidates are as many as the rankings are deep, so their ids go to the texts
    held = docs.join(F.broadcast(wide.select("doc_id").distinct()), "doc_id", "left_semi")
    texts = held.select("doc_id", terms(title, profile).alias("tt"), terms(F.col("text"), profile).alias("dt"), flat(title).alias("flat_title"), flat(F.col("text")).alias("flat_text"))
    asked = queries.select("query_id", tokens(repaired(F.col("query")), profile).alias("qt"), flat(F.col("query")).alias("flat_query"))
    both = wide.join(asked, "query_id").join(texts, "doc_id", "left")
    size = lambda c: F.greatest(F.size(c), F.lit(0)).cast("double")
    empty = F.expr("cast(array() as array<string>)")
    distinct, tt, dt = F.array_distinct("qt"), F.coalesce("tt", empty), F.coalesce("dt", empty)
    overlap, in_title = size(F.array_intersect("qt", F.concat(tt, dt))), size(F.array_intersect("qt", tt))
    share = lambda n: F.when(F.size(distinct) > 0, n / F.size(distinct)).otherwise(0.0)
    exact = lambda c: F.coalesce((F.col("flat_query") != "") & F.contains(c, F.col("flat_query")), F.lit(False)).cast("double")
    return both.select(
        *wide.columns,
        size(F.col("qt")).alias("query_token_count"),
        size(tt).alias("title_token_count"),
        size(dt).alias("snippet_token_count"),
        (size(tt) + size(dt)).alias("document_length"),
        overlap.alias("query_term_overlap_count"),
        share(overlap).alias("query_term_overlap_ratio"),
        in_title.alias("title_query_overlap_count"),
        share(in_title).alias("title_query_overlap_ratio"),
        exact(F.col("flat_title")).alias("exact_query_in_title"),
        exact(F.col("flat_text")).alias("exact_query_in_snippet"),
    )


def labelled(rows: DataFrame, qrels: DataFrame) -> DataFrame:
    return rows.join(qrels.select("query_id", "doc_id", F.col("relevance").cast("double").alias("label")), ["query_id", "doc_id"], "left").fillna(0.0, ["label"])


def split(queries: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """(query_id, validation): the first ``share`` of queries by a seeded hash, one at least and all but one at most.

    The bound comes from the hashes of that many first queries, so no window runs over all of them.
    """
    hashed = queries.select("query_id").distinct().withColumn("at", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("query_id").cast("string")), 256))
    total = hashed.count()
    held = max(1, min(total - 1, round(share * total)))
    last = hashed.orderBy("at", "query_id").limit(held).agg(F.max(F.struct("at", "query_id")).alias("m")).first()["m"]
    return hashed.select("query_id", (F.struct("at", "query_id") <= F.struct(F.lit(last["at"]).alias("at"), F.lit(last["query_id"]).alias("query_id"))).alias("validation"))


def feature_columns(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("query_id", "doc_id", "label", "validation")]


def train(rows: DataFrame, seed: int = 42, trees: int = 100) -> GBTRegressionModel:
    table = VectorAssembler(inputCols=feature_columns(rows), outputCol="features").transform(rows)
    return GBTRegressor(maxIter=trees, stepSize=0.1, maxDepth=3, seed=seed).fit(table)


def rerank(model: GBTRegressionModel, rows: DataFrame, k: int = 10) -> DataFrame:
    table = VectorAssembler(inputCols=feature_columns(rows), outputCol="features").transform(rows)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("rrf_sum"), "doc_id")
    return model.transform(table).withColumn("score", F.round("prediction", 8)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def validation(model: GBTRegressionModel, rows: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row (queries, map, ndcg, ...) of the model's ranking of held-out rows; each query's candidates all count."""
    held = qrels.join(rows.select("query_id").distinct(), "query_id", "left_semi")
    return metrics.summary(metrics.per_query(rerank(model, rows, 10_000), held, k, 10_000))


def explained(ranking: DataFrame, rows: DataFrame, medical: bool = False) -> DataFrame:
    """The ranking with ``model_details``: the features that matter most, to 6 places, by name."""
    names = [*IMPORTANT, *(IMPORTANT_MEDICAL if medical else ())]
    chosen = rows.select("query_id", "doc_id", F.struct(*(F.round(F.coalesce(F.col(c), F.lit(0.0)), 6).alias(c) for c in names)).alias("model_details"))
    return ranking.join(chosen, ["query_id", "doc_id"], "left")


def metadata(rows: DataFrame, dataset: str, models: tuple[str, ...], candidate_count: int, seed: int, scores: dict) -> dict:
    """What is kept beside a trained model, the ids of its held-out queries among it; rows as ``labelled``, with ``validation``."""
    counts = {r["validation"]: r for r in rows.groupBy("validation").agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("rows")).collect()}
    number = lambda held, c: counts[held][c] if held in counts else 0
    held = [r[0] for r in rows.where("validation").select("query_id").distinct().orderBy("query_id").collect()]  # evaluation queries, a stated set
    return {
        "dataset": dataset, "model_type": "GBTRegressor", "candidate_models": list(models), "include_biomedical": "biomedical_embedding" in models,
        "candidate_count": candidate_count, "train_query_count": number(False, "queries"), "validation_query_count": number(True, "queries"),
        "training_rows": number(False, "rows"), "validation_rows": number(True, "rows"), "validation_metrics": scores, "random_seed": seed, "held_out_query_ids": held,
    }
