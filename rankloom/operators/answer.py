"""Extractive answers with citations from a ranking's best documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import content_words, sentence_key, sentences


def contexts(ranking: DataFrame, docs: DataFrame, most: int = 5, size: int = 4000) -> DataFrame:
    """(query_id, doc_id, rank, context): the best documents' first characters. The ranking, few rows a query, goes to the texts."""
    best = ranking.where(F.col("rank") <= most).select("query_id", "doc_id", "rank")
    return docs.select("doc_id", F.substring("text", 1, size).alias("context")).join(F.broadcast(best), "doc_id").select("query_id", "doc_id", "rank", "context")


def scored_sentences(queries: DataFrame, context: DataFrame) -> DataFrame:
    """(query_id, rank, pos, sentence, overlap, score) of sentences that share content words with the query."""
    asked = queries.select("query_id", content_words(F.col("query")).alias("words"))
    rows = context.select("query_id", "rank", F.posexplode(sentences(F.col("context"))).alias("pos", "sentence")).join(asked, "query_id")
    overlap = F.size(F.array_intersect(content_words(F.col("sentence")), F.col("words")))
    score = 2.0 * F.col("overlap") + F.col("overlap") / F.greatest(F.size("words"), F.lit(1)) + 1.0 / F.greatest("rank", F.lit(1))
    return rows.withColumn("overlap", overlap).where("overlap > 0").select("query_id", "rank", "pos", "sentence", "overlap", F.round(score, 6).alias("score"))


def selected(scored: DataFrame, most: int = 4) -> DataFrame:
    """The best sentences, equal ones once, with their place."""
    order = [F.desc("score"), F.col("rank"), F.col("pos"), F.lower("sentence")]
    once = Window.partitionBy("query_id", "key").orderBy(*order)
    best = Window.partitionBy("query_id").orderBy(*order)
    kept = scored.withColumn("key", sentence_key(F.col("sentence"))).withColumn("n", F.row_number().over(once)).where("n = 1").drop("n", "key")
    return kept.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= most)


def answers(queries: DataFrame, picked: DataFrame) -> DataFrame:
    """(query_id, answer, confidence, n_sources, n_sentences): sentences in source order, each with its source in brackets."""
    rows = picked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "pos", "sentence"))).alias("s"), F.countDistinct("rank").alias("n_sources"), F.count("*").alias("n_sentences"), F.sum("overlap").alias("overlap"))
    joined = queries.select("query_id").join(rows, "query_id", "left")
    text = F.array_join(F.transform("s", lambda x: F.concat(x["sentence"], F.lit(" ["), x["rank"].cast("string"), F.lit("]"))), " ")
    level = F.when(F.col("s").isNull(), "insufficient").when((F.col("n_sources") >= 2) & (F.col("n_sentences") >= 2) & (F.col("overlap") >= 4), "high").when(F.col("overlap") >= 2, "medium").otherwise("low")
    return joined.select("query_id", F.coalesce(text, F.lit("")).alias("answer"), level.alias("confidence"), F.coalesce("n_sources", F.lit(0)).cast("long").alias("n_sources"), F.coalesce("n_sentences", F.lit(0)).cast("long").alias("n_sentences"))


def prompts(queries: DataFrame, context: DataFrame, size: int = 1800) -> DataFrame:
    """(query_id, prompt) for a language model: numbered context blocks, then the question."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring("context", 1, size))
    blocks = context.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("blocks"))
    return queries.join(blocks, "query_id", "left").select("query_id", F.concat(F.lit("Answer from the numbered sources only and cite them.\n\n"), F.coalesce("blocks", F.lit("")), F.lit("\n\nQuestion: "), F.col("query")).alias("prompt"))


def sources(ranking: DataFrame, docs: DataFrame, most: int = 5, size: int = 500) -> DataFrame:
    """(query_id, sources): for each query its best documents as a list of (source, doc_id, title, snippet, rank, score), by rank."""
    title = F.col("title") if "title" in docs.columns else F.lit("")
    best = ranking.where(F.col("rank") <= most).select("query_id", "doc_id", "rank", "score")
    found = docs.join(F.broadcast(best.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", title.alias("title"), F.substring("text", 1, size).alias("snippet"))
    held = best.join(found, "doc_id", "left")
    rows = held.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "title", "snippet", "score"))).alias("s"))
    return rows.select("query_id", F.transform("s", lambda x, i: F.struct((i + 1).alias("source"), x["doc_id"].alias("doc_id"), x["title"].alias("title"), x["snippet"].alias("snippet"), x["rank"].alias("rank"), x["score"].alias("score"))).alias("sources"))


def generated(asked: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """(query_id, answer) by a callable that the caller supplies; it runs on the executors, a call a row, as each is a request of its own."""
    return asked.select("query_id", F.udf(model, "string")("prompt").alias("answer"))


def generated_where_sufficient(made: DataFrame, asked: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """``answers`` with the model's text in place of theirs; where these are insufficient the model isn't called."""
    new = generated(asked.join(made.where("confidence <> 'insufficient'"), "query_id", "left_semi"), model).withColumnRenamed("answer", "new")
    return made.join(new, "query_id", "left").withColumn("answer", F.coalesce("new", "answer")).drop("new")
