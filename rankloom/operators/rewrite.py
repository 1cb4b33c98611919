"""Query rewriting: spelling correction, personalisation from history, pseudo-relevance feedback; and the model chooser."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from rankloom.functions.text import Profile, is_arabic, surface_words, tokens


def surface_vocabulary(docs: DataFrame, least: int = 20, most: int = 80_000, text: str = "text") -> DataFrame:
    """(term, freq) of the commonest surface words."""
    words = docs.select(F.explode_outer(surface_words(F.col(text))).alias("term")).where(F.col("term").isNotNull())
    counts = words.groupBy("term").agg(F.count("*").alias("freq"))
    return counts.where(F.col("freq") >= least).orderBy(F.desc("freq"), "term").limit(most)


def preserved(word: Column) -> Column:
    """Words that are never corrected: short, not alphabetic, in capitals, or abbreviations of mixed case."""
    capitals = F.length(F.regexp_replace(word, "[^A-Z]", ""))
    return (F.length(word) < 4) | ~word.rlike("^[A-Za-z]+$") | (word == F.upper(word)) | ((capitals >= 2) & (F.length(word) <= 10))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of matching blocks. No builtin equals it, so the few pairs that pass the edit distance are compared row by row."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def pieces(word: Column) -> Column:
    """Three pieces of a word, each with its number: two edits leave at least one of them as it is, within two places of where it was."""
    third = (F.length(word) / 3).cast("int")
    cut = lambda at, n: word.substr(at + 1, n)
    row = lambda n, at, size: F.struct(F.lit(n).alias("n"), cut(at, size).alias("piece"))
    return F.array(row(0, F.lit(0), third), row(1, third, third), row(2, third * 2, F.length(word) - third * 2))


def correction_candidates(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, term, freq, distance): same first letter, lengths within 2, edit distance 1 (up to five letters) or 2.

    A word within two edits holds one of its three pieces unchanged, at most two places off; words and terms meet on
    that piece, their length and first letter, so the keys are many and no letter's terms gather in one task. A term is
    listed under every run of letters that could be such a piece: three lengths at three places, shifted by up to two.
    """
    w = words.select(F.lower("word").alias("word")).distinct().join(vocab.select(F.col("term").alias("word")), "word", "left_anti")
    asked = w.select("word", F.explode(pieces(F.col("word"))).alias("p")).select("word", F.length("word").alias("size"), F.substring("word", 1, 1).alias("head"), "p.n", "p.piece")
    sizes = F.sequence(F.greatest(F.length("term") - 2, F.lit(1)), F.length("term") + 2)
    wide = vocab.select("term", "freq", F.explode(sizes).alias("size")).select("term", "freq", "size", F.substring("term", 1, 1).alias("head"), (F.col("size") / 3).cast("int").alias("third"))
    row = lambda n, at, size: F.struct(F.lit(n).alias("n"), at.alias("at"), size.alias("long"))
    at = F.array(row(0, F.lit(0), F.col("third")), row(1, F.col("third"), F.col("third")), row(2, F.col("third") * 2, F.col("size") - F.col("third") * 2))
    held = wide.select("term", "freq", "size", "head", F.explode(at).alias("p")).select("term", "freq", "size", "head", "p.n", "p.long", F.explode(F.sequence(F.col("p.at") - 2, F.col("p.at") + 2)).alias("start")).where("start >= 0")
    keyed = held.withColumn("piece", F.col("term").substr(F.col("start") + 1, F.col("long"))).where(F.length("piece") == F.col("long")).select("term", "freq", "size", "head", "n", "piece").distinct()
    near = asked.join(keyed, ["size", "head", "n", "piece"]).select("word", "term", "freq").distinct()
    return near.withColumn("distance", F.levenshtein("word", "term")).where(F.col("distance") <= F.when(F.length("word") <= 5, 1).otherwise(2))


def corrections(words: DataFrame, vocab: DataFrame, least: float = 0.82) -> DataFrame:
    """(word, corrected): a scan over candidates in term order; a clearly more similar one wins, then a clearly more frequent one."""
    scored = correction_candidates(words, vocab).withColumn("sim", similarity("word", "term")).where(F.col("sim") >= least)
    rows = scored.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("term", "sim", F.log1p("freq").alias("lf")))).alias("c"))
    better = "(x.sim > b.sim + 0.03D or (x.sim >= b.sim - 0.03D and x.lf > b.lf + 0.2D))"
    return rows.select("word", F.expr(f"aggregate(slice(c, 2, size(c)), c[0], (b, x) -> if({better}, x, b)).term").alias("corrected"))


def correct_queries(queries: DataFrame, vocab: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, query): words replaced from left to right, at most so many."""
    pieces = queries.select("query_id", F.posexplode(F.split("query", r"(?<=[A-Za-z])(?=[^A-Za-z])|(?<=[^A-Za-z])(?=[A-Za-z])")).alias("pos", "word"))
    fixes = corrections(pieces.where(~preserved(F.col("word"))).select("word"), vocab).withColumnRenamed("word", "low")
    joined = pieces.withColumn("low", F.when(~preserved(F.col("word")), F.lower("word"))).join(fixes, "low", "left")
    run = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    counted = joined.withColumn("nth", F.sum(F.col("corrected").isNotNull().cast("int")).over(run))
    new = F.when(F.col("corrected").isNotNull() & (F.col("nth") <= most), F.col("corrected")).otherwise(F.col("word"))
    rows = counted.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", new.alias("w")))).alias("ws"))
    return rows.select("query_id", F.array_join(F.transform("ws", lambda x: x["w"]), "").alias("query"))


def recent_queries(history: DataFrame, most: int = 20) -> DataFrame:
    """The newest queries of each user and data set: (user_id, dataset, id, query, created_at, nth)."""
    last = Window.partitionBy("user_id", "dataset").orderBy(F.desc("created_at"), F.desc("id"))
    kept = history.where((F.trim("user_id") != "") & (F.trim("dataset") != "") & (F.trim("query") != ""))
    return kept.withColumn("nth", F.row_number().over(last)).where(F.col("nth") <= most)


def personal_terms(queries: DataFrame, history: DataFrame, profile: Profile, most: int = 3) -> DataFrame:
    """(query_id, term, n, rank): terms of past queries that the query lacks, by past queries holding them, newest first.

    queries: (query_id, user_id, query); history: (user_id, nth, query), nth 1 for the newest.
    """
    past = history.select("user_id", "nth", F.posexplode(F.array_distinct(tokens(F.col("query"), profile))).alias("pos", "term"))
    asked = queries.select("query_id", "user_id", tokens(F.col("query"), profile).alias("own"))
    counts = asked.join(past, "user_id").where((F.length("term") > 2) & ~F.expr("array_contains(own, term)")).groupBy("query_id", "term").agg(F.count("*").alias("n"), F.min(F.struct("nth", "pos")).alias("at"))
    best = Window.partitionBy("query_id").orderBy(F.desc("n"), "at", "term")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("query_id", "term", "n", "rank")


def feedback_terms(queries: DataFrame, ranking: DataFrame, docs: DataFrame, profile: Profile, feedback_docs: int = 3, most: int = 5) -> DataFrame:
    """(query_id, term, n, rank): terms of the snippets of the best documents, by documents holding them, then term."""
    asked = queries.select("query_id", tokens(F.col("query"), profile).alias("own"))
    held = docs.select("doc_id", F.substring("text", 1, 250).alias("snippet")).join(F.broadcast(ranking.where(F.col("rank") <= feedback_docs)), "doc_id")
    words = held.select("query_id", "doc_id", F.explode(F.array_distinct(tokens(F.col("snippet"), profile))).alias("term")).join(asked, "query_id")
    counts = words.where((F.length("term") > 2) & ~F.expr("array_contains(own, term)")).groupBy("query_id", "term").agg(F.count("*").alias("n"))
    best = Window.partitionBy("query_id").orderBy(F.desc("n"), "term")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def appended(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, query): each query with its terms, by rank, at the end."""
    lists = terms.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("more"))
    return queries.join(lists, "query_id", "left").select("query_id", F.concat_ws(" ", "query", "more").alias("query"))


def chosen_model(dataset: Column, query: Column) -> Column:
    """The rule of the strategy agent, on the query as it was asked."""
    words = F.size(F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != ""))
    known = dataset.isin("sample_dataset", "clinical_trials", "quora")
    return F.when(~known, "bm25").when(is_arabic(query), "embedding").when(dataset == "clinical_trials", "bm25").when((dataset == "quora") & (words <= 3), "hybrid_serial").when(dataset == "quora", "embedding").otherwise("bm25")


def strategy(dataset: str, query: str) -> str:
    """``chosen_model`` for one query on the driver."""
    if dataset not in ("sample_dataset", "clinical_trials", "quora"):
        return "bm25"
    if re.search("[\u0600-\u06ff]", query):
        return "embedding"
    return {"quora": "hybrid_serial" if len(query.split()) <= 3 else "embedding"}.get(dataset, "bm25")


def misspelled(query: Column) -> Column:
    """A copy with up to two of its words of five letters or more damaged: long ones lose a letter, others have two swapped."""
    def damage(w: Column) -> Column:
        at = F.greatest(F.lit(2), F.floor(F.length(w) / 2).cast("int"))
        cut = F.concat(w.substr(F.lit(1), at), w.substr(at + 2, F.length(w)))
        swap = F.concat(w.substr(1, 1), w.substr(3, 1), w.substr(2, 1), w.substr(F.lit(4), F.length(w)))
        return F.when(F.length(w) >= 7, cut).otherwise(swap)

    pieces = F.split(query, " ")
    long = F.transform(pieces, lambda w, i: F.when(w.rlike(r"\A[A-Za-z]{5,}\z"), i))
    chosen = F.slice(F.filter(long, lambda i: i.isNotNull()), 1, 2)
    return F.array_join(F.transform(pieces, lambda w, i: F.when(F.array_contains(chosen, i), damage(w)).otherwise(w)), " ")
