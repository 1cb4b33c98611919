"""Rankings by rows of texts against joins of postings, and what of them is shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import answer, index, rank, vectors
from rankloom.plans import queries

PROFILE = T.PROFILES["clinical_trials"]


@pytest.fixture(scope="module")
def own(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 30)) if i % 5 else ["w1", "w2", "w2"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(q, " ".join(rng.choice(words, 6))) for q in range(9)] + [(20, "unseen"), (21, "w1 w2")], "query_id long, query string")
    return index.Index.of_texts(docs, PROFILE, queries.keep), asked


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_making_rows_shuffles_nothing(spark):
    docs = spark.createDataFrame([(1, "two three three")], "doc_id long, text string")
    rows = index.counted_texts(docs, PROFILE)
    assert "Exchange" not in plan(rows) and [tuple(r)[1:2] + tuple(r)[3:] for r in rows.collect()] == [(3, "two three", [1, 2])]
    assert [tuple(r) for r in index.spread_postings(rows).orderBy("term").select("term", "doc_id", "tf", "dl").collect()] == [("three", 1, 2, 3), ("two", 1, 1, 3)]


@pytest.mark.parametrize("k", [3])
def test_scans_of_rows_are_joins_of_postings(own, monkeypatch, k):
    made, asked = own
    ask = {
        "bm25": lambda: rank.bm25(asked, made, PROFILE, k, pad=True),
        "bm25_all": lambda: rank.bm25_all(asked, made, PROFILE, k),
        "tfidf": lambda: rank.tfidf(asked, made, PROFILE, k),
        "tfidf_all": lambda: rank.tfidf_all(asked, made, PROFILE, k, sublinear=False),
        "distributed": lambda: rank.distributed_bm25(asked, made, PROFILE, 3, k),
    }
    shown = lambda df: sorted(map(tuple, df.collect()))
    assert plan(ask["bm25"]()).count("MapInArrow") == 1  # padding reads a ranking once
    monkeypatch.setattr(rank, "GATHERED", 50)
    monkeypatch.setattr(rank, "HELD", 4 * k)
    scans = {m: shown(f()) for m, f in ask.items()}
    monkeypatch.setattr(rank, "ASKED", 0)
    for m, f in ask.items():
        assert shown(f()) == scans[m], m


def test_half_up_is_round(spark):
    x = [0.1234565, 0.1234575, 1.0000005, 2.5e-7, 5e-7, 0.3333335, -0.1234565, 123.4567895, 0.0, 7e-7]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert rank.half_up(np.array(x), 6).tolist() == want


def test_cut_is_tokens(spark):
    texts = ["HER2-positive 64-year-old took 5 mg/kg/day", "She can’t stop, he won't <b>go</b> http://x.y/z now", "DON'T n't_x a_b", None, "", "  ", "ｆｕｌｌ １２ &amp; Straße ΣΑΣ", "a.b./c +d é² ½ x\x0bwww.a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i")
    for profile in (PROFILE, T.Profile()):
        rows = df.select(T.tokens(T.repaired(F.col("x")), profile), T.terms(F.col("x"), profile)).collect()
        assert [r[1] for r in rows] == [r[0] for r in rows]


def test_texts_stay_where_they_are(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    ranking = spark.createDataFrame([(1, 3, 0.5, 1), (1, 99, 0.4, 2)], "query_id long, doc_id long, score double, rank int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        made = answer.contexts(ranking, docs)
        assert "Exchange hashpartitioning" not in plan(made) and [r["context"] for r in made.collect()] == ["text 3"]
        found = rank.enrich(ranking, docs).orderBy("rank").collect()
        assert [r["snippet"] for r in found] == ["text 3", None]
        assert [(s["doc_id"], s["snippet"]) for s in answer.sources(ranking, docs).first()["sources"]] == [(3, "text 3"), (99, None)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_codes_give_few_rows_and_no_vectors(spark):
    rng = np.random.default_rng(3)
    table = queries.keep(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(600, 8)))], "doc_id long, dv array<double>"), "x")
    own = vectors.IvfPq.fit(table, lists=6, parts=4, bits=4)
    asked = table.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("dv").alias("qv"))
    rough = own._rough(own.code(table).coalesce(1), asked.toArrow(), 5, 6, ("bigint", "bigint"))
    assert rough.columns == ["query_id", "doc_id", "score"] and rough.count() == 5 * 30


def test_whole_vocabulary_is_checked(spark, tmp_path):
    text = " ".join(f"t{i}" for i in range(100_500))
    spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in queries.tfidf_check(spark, str(tmp_path)).collect()] == [("terms below the least frequency", 100_500)]


def test_encoded_numbers_round_as_doubles(spark, tmp_path):
    """7 of 160 is 0.04375; in single precision it is a little less."""
    text = "a" * 7 + "e" * 159 + "b" * 16 + "c" * 3 + "d" * 2 + "f"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.encoded_documents(spark, str(tmp_path)).first()["a"] == 0.0438
