import math

import pytest

from rankloom.functions.text import Profile
from rankloom.operators import index, metrics, rank
from rankloom.operators.answer import answers, scored_sentences, selected
from rankloom.plans.request import SearchRequest
from rankloom.sources import store

PLAIN = Profile(stem=False, least=1, stop_words=("the",))
DOCS = [(1, "machine learning learns"), (2, "deep machine"), (3, "the cooking pot"), (4, ""), (5, None)]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    return docs, index.Index.of(index.token_table(docs, PLAIN), PLAIN)


def test_bm25_against_the_formula(spark, corpus):
    queries = spark.createDataFrame([(1, "machine machine learning")], "query_id long, query string")
    got = {r["doc_id"]: r["score"] for r in rank.bm25(queries, corpus[1], PLAIN).collect()}
    counts = {1: {"machine": 1, "learning": 1, "learns": 1}, 2: {"deep": 1, "machine": 1}, 3: {"cooking": 1, "pot": 1}}
    n, average = 5, 7 / 5
    df = {t: sum(t in c for c in counts.values()) for c in counts.values() for t in c}
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in raw.items()}
    want = {}
    for d, c in counts.items():
        dl = sum(c.values())
        score = sum(qf * idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * dl / average)) for t, qf in (("machine", 2), ("learning", 1)) if t in c)
        if round(score, 6) > 0:
            want[d] = round(score, 6)
    assert got == pytest.approx(want)


def test_padding_fills_to_k(spark, corpus):
    queries = spark.createDataFrame([(1, "pot"), (2, "unseen")], "query_id long, query string")
    rows = rank.bm25(queries, corpus[1], PLAIN, 3, pad=True).orderBy("rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in rows] == [(1, 3), (1, 1), (1, 2)]


def test_metrics(spark):
    ranking = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 5, 1)], "query_id long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 10, 1), (1, 12, 1), (2, 9, 0), (3, 1, 2)], "query_id long, doc_id long, relevance int")
    rows = {r["query_id"]: r for r in metrics.per_query(ranking, qrels, 2).collect()}
    assert rows[1]["precision"] == 0.5 and rows[1]["recall"] == 1.0
    assert rows[1]["ap"] == pytest.approx((1 + 2 / 3) / 2, abs=1e-6)
    assert (rows[2]["ap"], rows[2]["ndcg"], rows[3]["recall"]) == (0.0, 0.0, 0.0)
    assert metrics.summary(metrics.per_query(ranking, qrels, 2)).first()["queries"] == 3


def test_fusion_ties_follow_model_order(spark):
    a = spark.createDataFrame([(1, 7, 1)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 3, 1)], "query_id long, doc_id long, rank int")
    assert [r["doc_id"] for r in rank.hybrid_parallel({"tfidf": a, "bm25": b}).orderBy("rank").collect()] == [7, 3]
    assert [r["doc_id"] for r in rank.hybrid_parallel({"tfidf": a, "bm25": b}, {"tfidf": 0.0}).collect()] == [3]


def test_shards_are_stable(spark):
    row = spark.createDataFrame([("DOC001",)], "i string").select(index.shard_of(__import__("pyspark.sql.functions", fromlist=["col"]).col("i"), 4)).first()
    assert row[0] == 3


def test_answers_cite_sources(spark):
    queries = spark.createDataFrame([(1, "insulin dose"), (2, "zebra")], "query_id long, query string")
    context = spark.createDataFrame([(1, 1, "Insulin dose matters. Cats sleep."), (1, 2, "The insulin dose is low.")], "query_id long, rank int, context string")
    rows = {r["query_id"]: r for r in answers(queries, selected(scored_sentences(queries, context))).collect()}
    assert rows[1]["answer"] == "Insulin dose matters. [1] The insulin dose is low. [2]" and rows[1]["confidence"] == "high"
    assert rows[2]["confidence"] == "insufficient" and rows[2]["answer"] == ""


def test_relevance_sample(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id long, query string")
    qrels = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (2, 3, 1), (2, 4, 1), (3, 1, 1)], "query_id long, doc_id long, relevance int")
    docs = spark.createDataFrame([(i,) for i in range(1, 9)], "doc_id long")
    q, d = store.relevance_sample(queries, qrels, docs, 3)
    assert {r[0] for r in q.collect()} == {1, 3} and {r[0] for r in d.collect()} == {1, 2, 3}


def test_request_rules():
    assert SearchRequest(" x ").query == "x"
    for bad in ({"query": " "}, {"query": "x", "top_k": 0}, {"query": "x", "model": "hybrid_serial", "top_k": 20, "candidate_count": 10}, {"query": "x", "include_raw_text": True, "top_k": 60}, {"query": "x", "biomedical_weight": 1.0}):
        with pytest.raises(ValueError):
            SearchRequest(**bad)
