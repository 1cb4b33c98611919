"""From a search request to its results: the query is rewritten, a model chosen, documents ranked and enriched, an answer made.

Everything up to the returned tables is one lazy plan over a one-row table of queries; the same functions answer many
queries at once. Only the choice of the model needs a value on the driver, and that comes from the request itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import profile_of
from rankloom.operators import answer, ltr, rank, rewrite
from rankloom.operators.index import Index
from rankloom.plans.request import SearchRequest
from rankloom.streaming.history import valid

#: Shards of the distributed model, where the request names none.
SHARDS = 4
#: Asked terms up to this number are named in the scan of the ranges of postings, where a service has stored them (``Index.ranges``).
NAMED = 64
#: Past queries that personalisation looks at.
RECENT = 20


@dataclass
class Corpus:
    """What the models of one data set need; parts that a model lacks make that model an error.

    docs: (doc_id, title, text); vectors: (doc_id, dv); encode: texts (query_id, query) to (query_id, qv); words: (term, freq) of
    the spelling vocabulary; history: (user_id, dataset, id, query, created_at); model: for "ltr"; generate: prompt to answer.
    """

    dataset: str
    docs: DataFrame
    index: Index
    vectors: DataFrame | None = None
    encode: Callable[[DataFrame], DataFrame] | None = None
    medical: DataFrame | None = None
    encode_medical: Callable[[DataFrame], DataFrame] | None = None
    words: DataFrame | None = None
    history: DataFrame | None = None
    model: GBTRegressionModel | None = None
    generate: Callable[[str], str] | None = None

    def need(self, *names: str) -> list:
        for n in names:
            if getattr(self, n) is None:
                raise ValueError(f"{self.dataset} has no {n}")
        return [getattr(self, n) for n in names]


@dataclass
class Response:
    """query: (query_id, query) that was searched; results: the enriched ranking; answers and sources: of "rag" only."""

    request: SearchRequest
    model: str
    query: DataFrame
    results: DataFrame
    answers: DataFrame | None = None
    sources: DataFrame | None = None
    steps: dict[str, DataFrame] = field(default_factory=dict)


def rewritten(corpus: Corpus, request: SearchRequest, queries: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(query_id, query) after spelling correction, personal terms and feedback terms, in this order, and the query after each step."""
    profile, steps, now = profile_of(corpus.dataset), {"original": queries}, queries
    if request.use_spelling_correction:
        now = steps["corrected"] = rewrite.correct_queries(now, *corpus.need("words"))
    if request.use_personalization and request.user:
        (past,) = corpus.need("history")
        own = rewrite.recent_queries(past.where((F.col("user_id") == request.user) & (F.col("dataset") == corpus.dataset)), RECENT)
        terms = rewrite.personal_terms(now.withColumn("user_id", F.lit(request.user)), own, profile, request.max_personalization_terms)
        now = steps["personalised"] = rewrite.appended(now, terms)
    if request.use_query_refinement:
        first = rank.bm25(now, corpus.index, profile, request.feedback_docs, request.bm25_k1, request.bm25_b, named=NAMED * corpus.index.served)
        now = steps["refined"] = rewrite.appended(now, rewrite.feedback_terms(now, first, corpus.docs, profile, request.feedback_docs, request.expansion_terms))
    return now, steps


def ranked(corpus: Corpus, request: SearchRequest, queries: DataFrame, model: str, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank, ...) of queries (query_id, query) under one of the models."""
    profile, index = profile_of(corpus.dataset), corpus.index
    named = NAMED * index.served
    if model == "tfidf":
        return rank.tfidf(queries, index, profile, k, pad=True, named=named)
    if model == "bm25":
        return rank.bm25(queries, index, profile, k, request.bm25_k1, request.bm25_b, pad=True, named=named)
    if model == "distributed_bm25":
        return rank.distributed_bm25(queries, index, profile, request.num_shards or SHARDS, k, request.shard_top_k, request.rrf_k, request.bm25_k1, request.bm25_b, named=named)
    if model == "embedding":
        vectors, encode = corpus.need("vectors", "encode")
        return rank.dense(encode(queries), vectors, k)
    if model == "biomedical_embedding":
        vectors, encode = corpus.need("medical", "encode_medical")
        return rank.dense(encode(queries), vectors, k)
    if model == "hybrid_serial":
        vectors, encode = corpus.need("vectors", "encode")
        return rank.hybrid_serial(ranked(corpus, request, queries, "bm25", request.candidate_count), encode(queries), vectors, k)
    if model == "hybrid_parallel":
        weights = {"tfidf": request.tfidf_weight, "bm25": request.bm25_weight, "embedding": request.embedding_weight, "biomedical_embedding": request.biomedical_weight}
        parts = {m: ranked(corpus, request, queries, m, request.candidate_count) for m, w in weights.items() if w > 0}
        return rank.hybrid_parallel(parts, weights, k, request.rrf_k)
    if model == "ltr":
        (learned,) = corpus.need("model")
        parts = {m: ranked(corpus, request, queries, m, request.candidate_count) for m in request.ltr_candidate_models}
        return ltr.rerank(learned, ltr.features(parts, queries, corpus.docs, profile, request.rrf_k), k)
    raise ValueError(f"no ranking by {model}")


def search(corpus: Corpus, request: SearchRequest) -> Response:
    """The response to one request; nothing is computed before its tables are read."""
    if request.dataset != corpus.dataset:
        raise ValueError(f"the corpus is {corpus.dataset}, not {request.dataset}")
    spark = corpus.docs.sparkSession
    asked = spark.createDataFrame([("0", request.query)], "query_id string, query string")
    query, steps = rewritten(corpus, request, asked)
    model = rewrite.strategy(request.dataset, request.query) if request.model == "agent" else request.model
    if model != "rag":
        results = ranked(corpus, request, query, model, request.top_k)
        return Response(request, model, query, enriched(corpus, request, results), steps=steps)
    results = ranked(corpus, request, query, request.rag_retriever_model, max(request.top_k, request.rag_context_docs))
    context = answer.contexts(results, corpus.docs, request.rag_context_docs)
    picked = answer.selected(answer.scored_sentences(query, context), request.rag_answer_sentences)
    made = answer.answers(query, picked)
    if request.rag_generation_mode != "extractive_offline":
        (generate,) = corpus.need("generate")
        made = answer.generated_where_sufficient(made, answer.prompts(query, context), generate)
    sources = answer.sources(results, corpus.docs, request.rag_context_docs) if request.include_sources else None
    return Response(request, model, query, enriched(corpus, request, results.where(F.col("rank") <= request.top_k)), made, sources, steps)


def enriched(corpus: Corpus, request: SearchRequest, results: DataFrame) -> DataFrame:
    return rank.enrich(results, corpus.docs, request.snippet_length, request.include_raw_text).withColumn("model", F.lit(request.model))


def record(history: DataFrame, request: SearchRequest, created_at: str) -> DataFrame:
    """The history with the query as it was asked; a request without a user adds nothing."""
    row = history.sparkSession.createDataFrame([(request.user, request.dataset, request.query, created_at)], "user_id string, dataset string, query string, created_at string")
    return history.select("user_id", "dataset", "query", "created_at").unionByName(valid(row.withColumn("created_at", F.to_timestamp("created_at"))))


def with_model(request: SearchRequest, model: str) -> SearchRequest:
    return replace(request, model=model)
