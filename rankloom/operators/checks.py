"""Checks of stored indexes: manifests, and tables (problem, n) whose rows are what is wrong; no rows mean all is well."""

from __future__ import annotations

from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import NEGATIONS, Profile
from rankloom.operators.index import Index, shard_at


def snapshot(profile: Profile) -> dict:
    """The preprocessing of an index, to be kept with it and compared when it is used."""
    own = asdict(profile)
    return {"stem": own["stem"], "least": own["least"], "stop_words": sorted(own["stop_words"]), "negations": sorted(NEGATIONS), "unicode": "NFKC"}


def manifest(index: Index, profile: Profile, dataset: str, model: str = "bm25", **parameters) -> dict:
    """What an index is: data set, model, counts, parameters, preprocessing."""
    return {"dataset": dataset, "model": model, "documents": index.total, "average_length": round(index.average, 6), "parameters": parameters, "preprocessing": snapshot(profile)}


def manifest_problems(found: dict, wanted: dict, prefix: str = "") -> list[str]:
    """Names of the fields, nested ones with dots, in which two manifests differ."""
    out = []
    for k in sorted({*found, *wanted}):
        a, b = found.get(k), wanted.get(k)
        out += manifest_problems(a, b, f"{prefix}{k}.") if isinstance(a, dict) and isinstance(b, dict) else [f"{prefix}{k}"] * (a != b)
    return out


def _problems(one: DataFrame) -> DataFrame:
    """(problem, n) of the columns of one row that are not 0."""
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("problem"), F.col(f"`{c}`").cast("long").alias("n")) for c in one.columns))).alias("x")).select("x.*").where("n <> 0")


def index_problems(index: Index, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Postings with counts below 1, of unknown documents or twice; lengths and frequencies that don't equal their sums; documents missed."""
    post = index.postings
    rows = post.agg(F.count_if(F.col("tf") <= 0).alias("counts below one"), F.count_if(F.col("term").isNull() | F.col(key).isNull()).alias("null keys"))
    twice = post.groupBy("term", key).count().where("count > 1").agg(F.count("*").alias("repeated postings"))
    unknown = post.select(key).distinct().join(docs.select(key), key, "left_anti").agg(F.count("*").alias("postings of unknown documents"))
    missed = docs.select(key).distinct().join(index.lengths.select(key), key, "left_anti").agg(F.count("*").alias("documents without a length"))
    sums = post.groupBy(key).agg(F.sum("tf").alias("sum"))
    wrong = index.lengths.join(sums, key, "left").where(F.col("dl") != F.coalesce("sum", F.lit(0))).agg(F.count("*").alias("wrong lengths"))
    df = post.groupBy("term").agg(F.count("*").alias("held")).join(index.terms, "term", "full").where(~F.col("held").eqNullSafe(F.col("df"))).agg(F.count("*").alias("wrong frequencies"))
    return _problems(reduce(DataFrame.crossJoin, (twice, unknown, missed, wrong, df), rows))  # one row each


def shard_problems(index: Index, shards: int, counts: dict[int, int] | None = None) -> DataFrame:
    """Shards that are missing or whose number of documents is not the one of the manifest (``counts``), and the total's error."""
    own = index.lengths.groupBy(shard_at(F.col("spot"), shards).alias("shard_id")).agg(F.count("*").alias("n")) if "spot" in index.lengths.columns else index.shard_sizes(shards).select("shard_id", "n")
    spark = own.sparkSession
    wanted = spark.createDataFrame([(i, None if counts is None else counts.get(i, 0)) for i in range(shards)], "shard_id int, wanted long")  # 1024 rows at most
    both = wanted.join(own, "shard_id", "full")
    bad = both.where(F.col("wanted").isNotNull() & (F.coalesce("n", F.lit(0)) != F.col("wanted")) | F.col("wanted").isNull() & F.lit(counts is not None))
    each = bad.select(F.concat(F.lit("shard "), F.col("shard_id").cast("string")).alias("problem"), (F.coalesce("n", F.lit(0)) - F.coalesce("wanted", F.lit(0))).alias("n"))
    total = both.agg((F.coalesce(F.sum("n"), F.lit(0)) - F.lit(index.total)).alias("documents over all shards"))
    return each.unionByName(_problems(total))


def tfidf_problems(index: Index, parameters: tuple = (2, 0.98, 100_000)) -> DataFrame:
    """Kept terms outside the bounds of the vocabulary, too many of them, unit vectors that have no length, and documents whose vector is empty though they hold kept terms."""
    idf, norms = index.tfidf_idf(*parameters), index.norms(*parameters)
    terms = idf.agg(F.count_if(F.col("df") < parameters[0]).alias("terms below the least frequency"), F.greatest(F.count("*") - F.lit(parameters[2] or 2**62), F.lit(0)).alias("terms too many"), F.count_if(F.col("idf") < 1.0).alias("weights below one"))
    lengths = norms.agg(F.count_if(~(F.col("norm") > 0)).alias("vectors without length"))
    lost = index.postings.join(idf.select("term"), "term", "left_semi").select("doc_id").distinct().join(norms.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("documents without a vector"))
    return _problems(terms.crossJoin(lengths).crossJoin(lost))  # one row each


def ingest_problems(docs: DataFrame, queries: DataFrame, qrels: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Stored counts that differ from the manifest's, and judgements of unknown queries or documents."""
    sizes = {"documents": docs, "queries": queries, "qrels": qrels}
    parts = [sizes[k].agg((F.count("*") - F.lit(counts[k])).alias(f"{k} more than stated")) for k in sizes if k in counts]
    lost = [qrels.select(c).distinct().join(t.select(c), c, "left_anti").agg(F.count("*").alias(f"judged {c} unknown")) for c, t in (("query_id", queries), ("doc_id", docs))]
    return _problems(reduce(DataFrame.crossJoin, [*parts, *lost]))  # one row each


def signature_problems(stored: dict, docs: DataFrame, key: str = "doc_id") -> list[str]:
    """Names of the corpus facts (number, least and greatest id) that have changed since an index was made."""
    now = docs.agg(F.count("*").alias("n"), F.min(key).alias("least"), F.max(key).alias("greatest")).first().asDict()
    return [k for k, v in now.items() if stored.get(k) != v]
