"""Rankings (query_id, doc_id, score, rank): lexical, dense, sharded and fused.

Scores are rounded before they are ranked, and ties go to the smaller doc_id, so a ranking does not depend on the order
in which a sum was taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import Profile, repaired, stem_terms, tokens
from rankloom.operators.index import Index, of_terms, shard_at, unit_vectors, weights


def query_terms(queries: DataFrame, profile: Profile) -> DataFrame:
    """(query_id, term, qf) of queries (query_id, query)."""
    counts = queries.select("query_id", F.explode(tokens(repaired(F.col("query")), profile)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    return stem_terms(counts).groupBy("query_id", "term").agg(F.sum("qf").alias("qf")) if profile.stem else counts


def top_k(scored: DataFrame, k: int, places: int = 6, positive: bool = True, within: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best of each query by rounded score, then doc_id; adds rank from 1."""
    rounded = scored.withColumn("score", F.round("score", places))
    best = Window.partitionBy(*within).orderBy(F.desc("score"), "doc_id")
    return (rounded.where("score > 0") if positive else rounded).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


#: Asked terms of all queries that are sent to every task; beyond so many, postings and queries are joined by shuffle.
ASKED = 1 << 21
#: Scores that are held at once, texts times queries; results that are gathered before they are cut to the best.
CELLS, GATHERED = 1 << 18, 1 << 19
#: Results that a task may hold for all queries of one scan; more queries are asked in blocks, a scan each.
HELD = 1 << 21


def half_up(x: np.ndarray, places: int) -> np.ndarray:
    """Spark's ``round``: the shortest decimal form of a number, rounded half up; only numbers near a half need that form."""
    size = 10.0**places
    scaled = np.abs(x) * size
    whole = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):
        whole[i] = float((Decimal(repr(abs(float(x[i])))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)).scaleb(places))
    return np.copysign(whole / size, x)


class Best:
    """The k best results of each of so many groups by rounded score, then id: what ``top_k`` would keep, in bounded memory."""

    def __init__(self, groups: int, k: int, places: int = 6, positive: bool = True):
        self.k, self.places, self.positive = k, places, positive
        self.most = max(GATHERED, 2 * k * groups)
        self.floor = np.full(groups, 10.0**-places if positive else -np.inf)
        self.held: list[tuple] = []
        self.size = 0

    def add(self, group: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """``score`` as computed; results that can't be among the best are left out at once."""
        near = np.flatnonzero(score >= self.floor[group] - 10.0**-self.places)
        group, score = group[near], half_up(score[near], self.places)
        kept = score >= self.floor[group]
        self.held.append((group[kept], ids[near[kept]], score[kept]))
        self.size += int(kept.sum())
        if self.size > self.most:
            self.cut()

    def cut(self) -> tuple:
        if not self.held:
            return np.zeros(0, np.int64), None, np.zeros(0)
        group, ids, score = (np.concatenate(x) for x in zip(*self.held))
        at = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
        order = np.lexsort((at, -score, group))
        group = group[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        nth = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
        last = nth == self.k - 1
        self.floor[group[last]] = score[order[last]]
        keep = nth < self.k
        self.held = [(group[keep], ids[order[keep]], score[order[keep]])]
        self.size = int(keep.sum())
        return self.held[0]

    def batches(self, names: pa.Array, kind: pa.DataType, shards: int = 0) -> Iterator[pa.RecordBatch]:
        """(query_id, doc_id, score) and the shard, where groups are queries within shards."""
        group, ids, score = self.cut()
        for i in range(0, len(group), 1 << 16):
            g, d, x = (v[i : i + (1 << 16)] for v in (group, ids, score))
            columns = [names.take(pa.array(g % len(names))), pa.array(d, kind), pa.array(x)]
            named = ["query_id", "doc_id", "score"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array((g // len(names)).astype(np.int32))] * bool(shards), named + ["shard_id"] * bool(shards))


@dataclass
class Model:
    """How a text's counts become weights: BM25 by the mean length of each shard (one, if there are no shards), or TF-IDF."""

    average: np.ndarray | None = None
    k1: float = 1.5
    b: float = 0.75
    sublinear: bool = True
    #: terms and weights of a whole vocabulary that is small enough to be sent: the lengths of vectors come from it
    kept: tuple | None = None


def scanned(rows: DataFrame, asked: pa.Table, model: Model, k: int, shards: int = 0, places: int = 6) -> DataFrame:
    """(query_id, doc_id, score): the k best of each query, of each task's texts, with positive scores; to be cut by ``top_k``.

    rows as ``index.counted`` gives them, with ``norm`` for TF-IDF over a vocabulary that isn't sent, and shard_id if there are
    shards. asked: (query_id, term, w), and shard_id. Each text's row holds all that its scores need, so that a task ranks its
    texts alone, and what is shuffled are k rows a query and task.
    """
    names = pc.unique(asked["query_id"])
    block = max(1, HELD // (k * max(shards, 1)))
    if len(names) > block:
        parts = (asked.filter(pc.is_in(asked["query_id"], value_set=names.slice(i, block))) for i in range(0, len(names), block))
        return reduce(DataFrame.unionByName, [scanned(rows, x, model, k, shards, places) for x in parts])
    known = model.kept[0] if model.kept else pc.unique(asked["term"])
    query, term = (pc.index_in(asked[c], value_set=v).combine_chunks().to_numpy(zero_copy_only=False) for c, v in (("query_id", names), ("term", known)))
    if shards:
        term = term + asked["shard_id"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) * len(known)
    order = np.lexsort((query, term))
    held = np.searchsorted(term[order], np.arange(max(shards, 1) * len(known) + 1))
    kinds = dict(rows.dtypes)["doc_id"], rows.sparkSession.createDataFrame(asked.slice(0, 0)).schema["query_id"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast((names, known, held, query[order].astype(np.int64), asked["w"].combine_chunks().to_numpy(zero_copy_only=False)[order], model))
    total = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, held, query, weight, model = sent.value
        best, kind = Best(max(shards, 1) * total, k, places), None
        step = max(16, min(512, CELLS // max(total, 1)))
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            kind = at["doc_id"].type
            ids, dl = at["doc_id"].to_numpy(zero_copy_only=False), at["dl"].to_numpy(zero_copy_only=False)
            shard = at["shard_id"].to_numpy(zero_copy_only=False).astype(np.int64) if shards else np.zeros(len(ids), np.int64)
            ends = np.r_[0, np.cumsum(pc.list_value_length(at["tfs"]).to_numpy(zero_copy_only=False))]
            codes = pc.index_in(pc.split_pattern(at["terms"], " ").flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            tfs = at["tfs"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            for lo in range(0, len(ids), step):
                hi = min(lo + step, len(ids))
                own = np.flatnonzero(codes[ends[lo] : ends[hi]] >= 0) + ends[lo]
                row = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))[own - ends[lo]]
                code, tf = codes[own], tfs[own]
                if model.average is None:
                    value = 1.0 + np.log(tf) if model.sublinear else tf
                    if model.kept:
                        norm = np.sqrt(np.bincount(row, (value * model.kept[1][code]) ** 2, hi - lo))
                    else:
                        norm = at["norm"].to_numpy(zero_copy_only=False)[lo:hi]
                else:
                    mean = model.average[shard[lo:hi]]
                    value = tf * (model.k1 + 1) / (tf + model.k1 * (1 - model.b + model.b * (dl[lo:hi] / mean)[row]))
                code = code + shard[lo:hi][row] * len(known)
                first, many = held[code], held[code + 1] - held[code]
                place = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
                cell = np.repeat(row, many) * total + query[place]
                score = np.bincount(cell, np.repeat(value, many) * weight[place], (hi - lo) * total).reshape(hi - lo, total)
                if model.average is None:
                    score = score / np.where(norm > 0, norm, 1.0)[:, None]
                i, j = np.nonzero(score > 0)
                best.add(shard[lo:hi][i] * total + j, ids[lo + i], score[i, j])
        if kind is not None:
            yield from best.batches(names, kind, shards)

    need = ["doc_id", "dl", "terms", "tfs", *(["shard_id"] if shards else []), *(["norm"] if model.average is None and not model.kept else [])]
    return rows.where(F.size("tfs") > 0).select(*need).mapInArrow(run, f"query_id {kinds[1]}, doc_id {kinds[0]}, score double" + ", shard_id int" * bool(shards))


def asked_terms(terms: DataFrame, idf: DataFrame) -> pa.Table | None:
    """(query_id, term, qf, idf, ...) of the asked terms on the driver; None for more than ASKED, which are joined by shuffle."""
    few = terms.limit(ASKED + 1).toArrow()
    if few.num_rows > ASKED:
        return None
    held = terms.sparkSession.createDataFrame(few, terms.schema)
    return idf.join(F.broadcast(held), "term").toArrow()


def weighed(asked: pa.Table, w: np.ndarray) -> pa.Table:
    """asked with the column w in place of its counts."""
    return asked.select([c for c in ("query_id", "term", "shard_id") if c in asked.column_names]).append_column("w", pa.array(np.asarray(w, np.float64)))


def number(asked: pa.Table, column: str) -> np.ndarray:
    return asked[column].combine_chunks().to_numpy(zero_copy_only=False).astype(np.float64)


def queries_of(asked: pa.Table, like: DataFrame) -> DataFrame:
    """The distinct queries of an asked table, in the type of the given one."""
    return like.sparkSession.createDataFrame(asked.select(["query_id"]).group_by("query_id").aggregate([]), like.select("query_id").schema)


def bm25_scores(terms: DataFrame, post: DataFrame, idf: DataFrame, average: float, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score): sum of qf x idf x tf (k1 + 1) / (tf + k1 (1 - b + b dl / average))."""
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 above 0 and b from 0 to 1")
    # the query set is small next to the postings; Spark broadcasts it where its measured size allows
    matched = post.join(terms.join(idf, "term"), "term")
    tf = F.col("tf").cast("double")
    part = F.col("qf") * F.col("idf") * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("dl") / (average or 1.0)))
    return matched.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def bm25(queries: DataFrame, index: Index, profile: Profile, k: int = 10, k1: float = 1.5, b: float = 0.75, max_df: float | None = 0.98, pad: bool = False, named: int = 0) -> DataFrame:
    """``named``: up to so many asked terms are named in the scan of the stored ranges of postings, for services of few queries."""
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 above 0 and b from 0 to 1")
    idf = index.bm25_idf(max_df)
    terms = query_terms(queries, profile)
    asked = None if named else asked_terms(terms, idf)
    if asked is None:
        post = of_terms(index.ranges, terms, named) if named else index.postings
        scored, active = bm25_scores(terms, post, idf, index.average, k1, b), terms.join(idf, "term").select("query_id").distinct()
    else:
        model = Model(np.array([index.average or 1.0]), k1, b)
        scored, active = scanned(index.rows, weighed(asked, number(asked, "qf") * number(asked, "idf")), model, k), queries_of(asked, terms)
    ranked = top_k(scored, k).select("query_id", "doc_id", "score", "rank")
    return zero_padded(ranked, active, index.lengths.select("doc_id"), k) if pad else ranked


def bm25_all(queries: DataFrame, index: Index, profile: Profile, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 without pruning, over all documents: those that share no term have score 0 and come before negative scores."""
    idf = index.bm25_idf(None)
    if (idf.agg(F.min("idf")).first()[0] or 0) < 0:
        scored = bm25_scores(query_terms(queries, profile), index.postings, idf, index.average, k1, b)
        return all_ranked(scored, queries.select("query_id").distinct(), index.lengths.select("doc_id"), k, True)
    # no score is negative, so all others come after the positive ones, by doc_id
    return zero_padded(bm25(queries, index, profile, k, k1, b, None), queries.select("query_id").distinct(), index.lengths.select("doc_id"), k)


def all_ranked(scored: DataFrame, queries: DataFrame, docs: DataFrame, k: int, negative: bool = False) -> DataFrame:
    """The k best of all documents by score, then doc_id, where documents that were not scored have 0.

    Of these the first by doc_id are enough: of the first 2k and as many as have negative scores, either k have positive
    scores and come before them, or k were not scored. Negative scores are rare, as they need a mean idf below 0.
    """
    best = top_k(scored, k, positive=False).select("query_id", "doc_id", "score")
    below = scored.where("score < 0").groupBy("query_id").count().agg(F.max("count")).first()[0] if negative else 0
    first = docs.orderBy("doc_id").limit(2 * k + (below or 0))
    # scores of the first documents, low ones too, so that none of them is taken for unscored
    held = scored.join(F.broadcast(first), "doc_id", "left_semi").select("query_id", "doc_id")
    spare = queries.crossJoin(F.broadcast(first)).join(held, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", F.lit(0.0).alias("score"))
    return top_k(best.unionByName(spare), k, positive=False).select("query_id", "doc_id", "score", "rank")


def zero_padded(ranked: DataFrame, active: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Fill rankings of active queries up to k with documents of score 0 by doc_id; k + k candidates a query suffice."""
    filler = docs.orderBy("doc_id").limit(2 * k)
    spare = active.crossJoin(F.broadcast(filler)).select("query_id", "doc_id", F.lit(0.0).alias("score"), F.lit(1).alias("own"))
    # a ranked document comes before its own filler, so that the ranking is read once
    both = ranked.select("query_id", "doc_id", "score", F.lit(0).alias("own")).unionByName(spare)
    once = both.groupBy("query_id", "doc_id").agg(F.min_by("score", "own").alias("score"), F.min("own").alias("own"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "own", "doc_id")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def tfidf_scores(queries: DataFrame, index: Index, profile: Profile, parameters: tuple, sublinear: bool = True, named: int = 0) -> tuple[DataFrame, DataFrame]:
    """(query_id, doc_id, score), cosines of TF-IDF vectors, and the queries that hold a kept term; all by joins."""
    idf = index.tfidf_idf(*parameters)
    asked = unit_vectors(query_terms(queries, profile).withColumnRenamed("qf", "tf"), idf, "query_id", sublinear).withColumnRenamed("w", "wq")
    post = of_terms(index.ranges, asked, named) if named else index.postings
    # only postings of asked terms are weighed; a text's length divides its finished sum
    sums = weights(post, idf, "doc_id", sublinear).join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("wq") * F.col("w")).alias("sum"))
    return sums.join(index.norms(*parameters, sublinear), "doc_id").select("query_id", "doc_id", (F.col("sum") / F.col("norm")).alias("score")), asked.select("query_id").distinct()


def tfidf(queries: DataFrame, index: Index, profile: Profile, k: int = 10, min_df: int = 2, max_df: float | None = 0.98, max_features: int | None = 100_000, sublinear: bool = True, pad: bool = False, named: int = 0) -> DataFrame:
    idf, terms = index.tfidf_idf(min_df, max_df, max_features), query_terms(queries, profile)
    asked = None if named else asked_terms(terms, idf)
    if asked is None:
        scored, active = tfidf_scores(queries, index, profile, (min_df, max_df, max_features), sublinear, named)
    else:
        scored, active = cosines(asked, index, (min_df, max_df, max_features), k, sublinear), queries_of(asked, terms)
    ranked = top_k(scored, k).select("query_id", "doc_id", "score", "rank")
    return zero_padded(ranked, active, index.lengths.select("doc_id"), k) if pad else ranked


def cosines(asked: pa.Table, index: Index, parameters: tuple, k: int, sublinear: bool) -> DataFrame:
    """``scanned`` under TF-IDF. Lengths of vectors come from a vocabulary of up to ASKED terms at once, of more from the stored norms."""
    query = pc.index_in(asked["query_id"], value_set=pc.unique(asked["query_id"])).combine_chunks().to_numpy(zero_copy_only=False) if asked.num_rows else np.zeros(0, np.int64)
    qf, idf = number(asked, "qf"), number(asked, "idf")
    own = (1.0 + np.log(qf) if sublinear else qf) * idf
    norm = np.sqrt(np.bincount(query, own * own)) if len(query) else np.zeros(1)
    wanted = weighed(asked, own / norm[query] * idf if len(query) else own)
    if parameters[2] and parameters[2] <= ASKED:
        held = index.tfidf_idf(*parameters).select("term", "idf").toArrow()
        return scanned(index.rows, wanted, Model(sublinear=sublinear, kept=(held["term"].combine_chunks(), number(held, "idf"))), k)
    return scanned(index.rows.join(index.norms(*parameters, sublinear), "doc_id"), wanted, Model(sublinear=sublinear), k)


def tfidf_all(queries: DataFrame, index: Index, profile: Profile, k: int = 10, sublinear: bool = True) -> DataFrame:
    """TF-IDF over the whole vocabulary and all documents, with or without damped counts."""
    best = tfidf(queries, index, profile, k, 1, None, None, sublinear)
    # no score is negative, so all others come after the positive ones, by doc_id
    return zero_padded(best, queries.select("query_id").distinct(), index.lengths.select("doc_id"), k)


def distributed_bm25(queries: DataFrame, index: Index, profile: Profile, shards: int = 4, k: int = 10, shard_top_k: int | None = None, rrf_k: int = 60, k1: float = 1.5, b: float = 0.75, max_df: float = 0.98, named: int = 0) -> DataFrame:
    """BM25 with each shard's own statistics, merged by reciprocal ranks; all shards in one plan."""
    deep = shard_top_k or max(10 * k, 100)
    sizes = F.broadcast(index.shard_sizes(shards).select("shard_id", "average"))  # a row for each shard, 1024 at most
    terms = query_terms(queries, profile)
    idf = index.shard_idf(shards, max_df)
    asked = None if named else asked_terms(terms, idf)
    if asked is None:
        post = (of_terms(index.ranges, terms, named) if named else index.postings).withColumn("shard_id", shard_at(F.col("spot"), shards))
        tf = F.col("tf").cast("double")
        part = F.col("qf") * F.col("idf") * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("average")))
        scored = post.join(terms.join(idf, "term").join(sizes, "shard_id"), ["shard_id", "term"]).groupBy("query_id", "shard_id", "doc_id").agg(F.sum(part).alias("score"))
    else:
        means = np.ones(shards)
        for r in index.shard_sizes(shards).collect():
            means[r["shard_id"]] = r["average"] or 1.0
        rows = index.rows.withColumn("shard_id", shard_at(F.col("spot"), shards))
        scored = scanned(rows, weighed(asked, number(asked, "qf") * number(asked, "idf")), Model(means, k1, b), deep, shards)
    local = top_k(scored, deep, within=("query_id", "shard_id")).withColumnsRenamed({"rank": "local_rank", "score": "local_score"})
    fused = local.withColumn("score", F.round(1.0 / (rrf_k + F.col("local_rank")), 8))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "local_rank", "shard_id", "doc_id")
    return fused.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank", "shard_id", "local_rank", "local_score")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def shard_details(ranking: DataFrame, index: Index, shards: int) -> DataFrame:
    """(shard_id, documents, average_length, results, best_local_rank) of a distributed ranking; shards without results are there too."""
    held = ranking.groupBy("shard_id").agg(F.count("*").alias("results"), F.min("local_rank").alias("best_local_rank"))
    return index.shard_sizes(shards).join(held, "shard_id", "left").select("shard_id", F.col("n").alias("documents"), F.round("average", 6).alias("average_length"), F.coalesce("results", F.lit(0)).alias("results"), "best_local_rank")


#: Bytes of query vectors that go to every task; a larger set is dealt in blocks of so many queries.
QUERY_BYTES, QUERY_BLOCK = 64 << 20, 8192


def dense(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """Exact inner products of queries (query_id, qv), a stated set, against all vectors (doc_id, dv); none is padded.

    A batch of vectors meets all queries (or a block of them) in one matrix product and gives its k best a query, and a
    task keeps the best of its batches, so what is shuffled are k rows a query and task. Queries or vectors that are null or differ in length from the query take no part.
    """
    asked = queries.where("query_id is not null and qv is not null").select("query_id", F.col("qv").cast("array<double>").alias("qv"))
    held = vectors.where("doc_id is not null and dv is not null").select("doc_id", F.col("dv").cast("array<double>").alias("dv"))
    kinds = dict(asked.dtypes)["query_id"], dict(held.dtypes)["doc_id"]
    schema = f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"
    total, width = asked.agg(F.count("*"), F.max(F.size("qv"))).first()
    if not total:
        return held.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
    sent = None
    if total * width * 8 <= QUERY_BYTES:
        sent = held.sparkSession.sparkContext.broadcast(asked.toArrow())

    def best(table: pa.Table, asks: pa.Table, floor: np.ndarray | None = None) -> Iterator[tuple]:
        """(places of queries, ids of documents, scores) of all that may be among the k best; ``floor`` is what a query's k-th best has."""
        for size in set(pc.list_value_length(asks["qv"]).unique().to_pylist()):
            some = np.flatnonzero(pc.equal(pc.list_value_length(asks["qv"]), size).to_numpy(zero_copy_only=False)) if size else ()
            d = table.filter(pc.equal(pc.list_value_length(table["dv"]), size))
            if len(some) and d.num_rows:
                left, right = (t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size) for t, c in ((asks.take(pa.array(some)), "qv"), (d, "dv")))
                scores = left @ right.T
                # scores are rounded later: all that may reach the k-th place stay
                low = np.partition(scores, -k, axis=1)[:, -k] - 2e-6 if scores.shape[1] > k else np.full(len(scores), -np.inf)
                if floor is not None:
                    low = np.maximum(low, floor[some] - 2e-6)
                i, j = np.nonzero(scores >= low[:, None])
                yield some[i], d["doc_id"].combine_chunks().to_numpy(zero_copy_only=False)[j], scores[i, j]

    def listed(table: pa.Table, asks: pa.Table) -> Iterator[pa.RecordBatch]:
        for i, d, x in best(table, asks):
            yield pa.RecordBatch.from_arrays([asks["query_id"].take(pa.array(i)).combine_chunks(), pa.array(d, table["doc_id"].type), pa.array(x)], ["query_id", "doc_id", "score"])

    if sent is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, kind = Best(total, k, positive=False) if total * k <= HELD else None, None
            for batch in batches:
                kind = batch.schema.field("doc_id").type
                for at in range(0, batch.num_rows, 2048):
                    part = pa.Table.from_batches([batch.slice(at, 2048)])
                    if held is None:
                        yield from listed(part, sent.value)
                    else:
                        for found in best(part, sent.value, held.floor):
                            held.add(*found)
            if held is not None and kind is not None:
                yield from held.batches(sent.value["query_id"].combine_chunks(), kind)

        scored = held.mapInArrow(run, schema)
    else:
        blocks = -(-total // QUERY_BLOCK)
        parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left = held.withColumns({"p": F.pmod(F.xxhash64("doc_id"), F.lit(parts)), "b": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
        right = asked.withColumns({"b": F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"), "p": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))}).withColumn("p", F.col("p").cast("long"))
        scored = left.groupBy("p", "b").cogroup(right.groupBy("p", "b")).applyInArrow(lambda d, q: pa.Table.from_batches(list(listed(d, q)), schema=pa.schema([("query_id", q.schema.field("query_id").type), ("doc_id", d.schema.field("doc_id").type), ("score", pa.float64())])), schema)
    return top_k(scored, k, positive=False).select("query_id", "doc_id", "score", "rank")


def hybrid_serial(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """Rerank a lexical ranking by inner product; documents without a vector drop out."""
    held = candidates.select("query_id", "doc_id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score")).join(vectors, "doc_id").join(queries.select("query_id", "qv"), "query_id")
    return top_k(held.withColumn("score", dot(F.col("qv"), F.col("dv"))), k, positive=False).select("query_id", "doc_id", "score", "rank", "bm25_rank", "bm25_score")


def hybrid_parallel(rankings: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = 10, rrf_k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion; ties by the order of the models, then rank, then doc_id. Weight 0 leaves a model out."""
    weights = weights or {}
    used = [(i, m, weights.get(m, 1.0)) for i, m in enumerate(rankings) if weights.get(m, 1.0) > 0]
    parts = [rankings[m].select("query_id", "doc_id", "rank", F.lit(i).alias("at"), F.lit(float(w)).alias("w"), F.lit(m).alias("model")) for i, m, w in used]
    merged = reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(F.sum(F.col("w") / (rrf_k + F.col("rank"))).alias("score"), F.min(F.struct("at", "rank")).alias("first"), F.count("*").alias("n_models"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "first.at", "first.rank", "doc_id")
    return merged.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank", "n_models")


def enrich(ranking: DataFrame, docs: DataFrame, size: int = 500, raw: bool = False, strict: bool = False) -> DataFrame:
    """Join titles and texts to a finished ranking: ranks and scores stay, each row gets a snippet, and the text if ``raw``.

    Documents that are missing give nulls, or an error if ``strict``.
    """
    title = [F.col("title")] if "title" in docs.columns else []
    text = F.col("text")
    held = docs.select("doc_id", *title, F.substring(text, 1, size).alias("snippet"), *([text.alias("raw_text")] if raw else []), F.lit(True).alias("_held"))
    # the texts of the ranking are found where they lie; a ranking is small next to them
    found = held.join(F.broadcast(ranking.select("doc_id").distinct()), "doc_id", "left_semi")
    joined = ranking.join(found, "doc_id", "left")
    if strict:
        joined = joined.withColumn("doc_id", F.when(F.col("_held").isNull(), F.raise_error(F.concat(F.lit("no document "), F.col("doc_id").cast("string"))).cast(ranking.schema["doc_id"].dataType)).otherwise(F.col("doc_id")))
    return joined.drop("_held")
