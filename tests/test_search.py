"""Search from a request, dense indexes, checks, suites and stores on small fixtures, against brute force where there is a rule to follow."""

import difflib
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions.text import PROFILES, Profile
from rankloom.operators import answer, checks, cluster, index, ltr, metrics, rank, report, rewrite, vectors
from rankloom.plans import suite, views
from rankloom.plans.kept import corpus_index, keep
from rankloom.plans.request import SearchRequest
from rankloom.plans.search import Corpus, record, search
from rankloom.sources import export, files, store

WORDS = (
    "heart lung blood cancer trial cell gene drug dose pain skin bone brain liver renal viral fever cough nerve tumor acute chronic human mouse virus serum plasma "
    "tissue growth enzyme protein receptor insulin glucose sodium vessel muscle spinal breast kidney asthma stroke sepsis lesion biopsy scan dosage oral topical vaccine"
).split()


@pytest.fixture(scope="module")
def corpus(spark):
    def letters(texts):  # inside, as workers can't import this module
        return np.array([[x.lower().count(c) + 0.01 for c in "abcdefghijklmnop"] for x in texts], np.float32).reshape(len(texts), 16)

    rng = random.Random(4)
    rows = [(i, rng.choice(WORDS), " ".join(rng.choices(WORDS, k=rng.randint(3, 40))) + ".") for i in range(120)]
    docs = keep(spark.createDataFrame(rows, "doc_id long, title string, text string"), "docs")
    own = index.Index.of(index.token_table(docs, PROFILES["clinical_trials"]), PROFILES["clinical_trials"], keep)
    held = keep(vectors.encoded(docs, letters).withColumnRenamed("embedding", "dv"), "vectors")
    encode = lambda q: vectors.encoded(q, letters, "query_id", "query").withColumnRenamed("embedding", "qv")
    past = spark.createDataFrame([("u", "clinical_trials", i, q, i) for i, q in enumerate(["renal fever", "renal dose", "renal heart"])], "user_id string, dataset string, id long, query string, created_at long")
    words = rewrite.surface_vocabulary(docs, 1)
    return Corpus("clinical_trials", docs, own, held, encode, held, encode, words, past)


@pytest.mark.parametrize("model", ["tfidf", "bm25", "distributed_bm25", "embedding", "biomedical_embedding", "hybrid_serial", "hybrid_parallel", "agent", "rag"])
def test_each_model_answers_a_request(corpus, model):
    made = search(corpus, SearchRequest("heart tumor", "clinical_trials", model, top_k=5, candidate_count=50))
    rows = made.results.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5] and all(r["snippet"] and r["title"] for r in rows)
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    if model == "rag":
        assert made.answers.first()["confidence"] in ("high", "medium") and len(made.sources.first()["sources"]) == 5


def test_query_is_rewritten_step_by_step(corpus):
    asked = SearchRequest("haert tumor", "clinical_trials", "bm25", user_id="u", use_spelling_correction=True, use_personalization=True, use_query_refinement=True)
    made = search(corpus, asked)
    steps = {k: v.first()["query"] for k, v in made.steps.items()}
    assert steps["personalised"] == steps["corrected"] + " renal heart dose" or steps["personalised"].startswith(steps["corrected"] + " renal")
    assert steps["refined"].startswith(steps["personalised"] + " ") and made.query.first()["query"] == steps["refined"]
    assert record(corpus.history.withColumn("created_at", F.lit(None).cast("timestamp")), asked, "2024-01-01").count() == 4


def test_language_model_is_asked_only_where_sentences_were_found(corpus):
    corpus.generate = lambda prompt: f"made of {prompt.count('[')}"
    asked = dict(dataset="clinical_trials", model="rag", rag_generation_mode="local_llm", rag_retriever_model="bm25")
    assert search(corpus, SearchRequest("heart", **asked)).answers.first()["answer"].startswith("made of")
    assert search(corpus, SearchRequest("zebra", **asked)).answers.first()["answer"] == ""


def test_missing_parts_are_errors(corpus, spark):
    with pytest.raises(ValueError, match="no model"):
        search(corpus, SearchRequest("heart", "clinical_trials", "ltr"))
    with pytest.raises(ValueError):
        search(corpus, SearchRequest("heart", "quora"))
    ranking = spark.createDataFrame([("0", 999, 1.0, 1)], "query_id string, doc_id long, score double, rank int")
    with pytest.raises(Exception, match="no document 999"):
        rank.enrich(ranking, corpus.docs, strict=True).collect()


@pytest.mark.parametrize("fields", [{"top_k": 0}, {"top_k": "x"}, {"model": "none"}, {"dataset": "none"}, {"candidate_count": 5, "model": "hybrid_serial"}, {"include_raw_text": True, "top_k": 51}, {"biomedical_weight": 1}, {"ltr_candidate_models": "bm25,none"}, {"rag_llm_temperature": 3}, {"use_query_refinement": "maybe"}, {"surprise": 1}, {"query": " "}, {"top_k": True}, {"top_k": 1.5}])
def test_bad_requests(fields):
    with pytest.raises(ValueError):
        SearchRequest.parse({"query": "x"} | fields)


def test_good_requests():
    own = SearchRequest.parse({"query": " x ", "top_k": "20", "include_sources": "no", "bm25_b": "0.5", "ltr_candidate_models": "bm25, tfidf,bm25", "snippet_length": ""})
    assert (own.query, own.top_k, own.include_sources, own.bm25_b, own.ltr_candidate_models, own.snippet_length) == ("x", 20, False, 0.5, ("bm25", "tfidf"), 500)
    assert len(SearchRequest.__dataclass_fields__) == 37


def test_named_terms_reach_the_scan(corpus, capsys):
    queries = corpus.docs.sparkSession.createDataFrame([("0", "heart tumor")], "query_id string, query string")
    few = rank.bm25(queries, corpus.index, PROFILES["clinical_trials"], 5, named=8)
    few.explain("formatted")
    assert "PushedFilters: [In(term, [heart,tumor])" in capsys.readouterr().out.replace("IsNotNull(term), ", "")
    assert few.collect() == rank.bm25(queries, corpus.index, PROFILES["clinical_trials"], 5).collect()


def test_dense_in_blocks_is_dense(corpus, monkeypatch, spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8))
    x[7] = x[3]
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [1.0])], "doc_id long, dv array<double>")
    asked = table.where("doc_id % 10 = 3 and size(dv) = 8").select(F.col("doc_id").alias("query_id"), F.col("dv").alias("qv"))
    want = {(q, i + 1): d for q in range(3, 300, 10) for i, d in enumerate(sorted(range(300), key=lambda j: (-round(float(x[q] @ x[j]), 6), j))[:4])}
    for small in (False, True):
        if small:
            monkeypatch.setattr(rank, "QUERY_BYTES", 0)
            monkeypatch.setattr(rank, "QUERY_BLOCK", 7)
        assert {(r["query_id"], r["rank"]): r["doc_id"] for r in rank.dense(asked, table, 4).collect()} == want
    assert rank.dense(asked.limit(0), table).count() == 0


def test_ivfpq_recall(spark):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(20, 16))
    x = middle[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = keep(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, dv array<double>"), "x")
    own = vectors.IvfPq.fit(table, lists=20, parts=4, bits=6)
    asked = table.where("doc_id % 60 = 0").select(F.col("doc_id").alias("query_id"), F.col("dv").alias("qv"))
    found = own.search(keep(own.code(table), "coded"), asked, 10, probes=6, refine=20).collect()
    best = {q: set(np.argsort(-(x @ x[q]))[:10].tolist()) for q in range(0, 3000, 60)}
    assert len(found) == 500 and sum(r["doc_id"] in best[r["query_id"]] for r in found) >= 450


def test_dense_problems(spark):
    docs = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    bad = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, None), (3, [3.0, 4.0]), (9, [1.0])], "doc_id long, embedding array<double>")
    assert {tuple(r) for r in vectors.dense_problems(bad, docs).collect()} == {("repeated ids", 1), ("null vectors", 1), ("other lengths", 1), ("norms not one", 1), ("without a vector", 1), ("without a document", 1)}
    with pytest.raises(ValueError):
        vectors.biomedical("quora", bad, "a", "a")
    with pytest.raises(ValueError):
        vectors.biomedical("clinical_trials", bad, "a", "b")


def test_embedding_text(spark):
    rows = [("Title", "body  of\ttext"), ("Title", "Title and body"), (None, " x "), ("t", None), ("", "y" * 600)]
    made = spark.createDataFrame(rows, "t string, x string").select(vectors.embedding_text(F.col("t"), F.col("x"), "quora").alias("e"))
    assert [r["e"] for r in made.collect()] == ["Title. body of text", "Title and body", "x", "t", "y" * 512]


def test_sound_index_has_no_problems(corpus):
    assert checks.index_problems(corpus.index, corpus.docs).collect() == []
    assert checks.shard_problems(corpus.index, 4).collect() == []
    assert checks.tfidf_problems(corpus.index).collect() == []
    assert checks.signature_problems(store.signature(corpus.docs).first().asDict(), corpus.docs) == []
    assert checks.signature_problems(store.signature(corpus.docs).first().asDict(), corpus.docs.where("doc_id > 3")) == ["n", "least"]


def test_shards_are_sha256(corpus):
    for shards in (1, 4, 7, 1024):
        for r in corpus.docs.select("doc_id", index.shard_of(F.col("doc_id"), shards).alias("s")).collect():
            assert r["s"] == int.from_bytes(hashlib.sha256(str(r["doc_id"]).encode()).digest()[:8], "big") % shards


def test_index_is_made_anew_when_documents_change(spark, tmp_path):
    folder = str(tmp_path / "c")
    write = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    write([(1, "one two"), (2, "three")])
    first = corpus_index(spark, folder)
    assert corpus_index(spark, folder) is first and first.total == 2
    write([(1, "one two"), (2, "three"), (3, "four")])
    assert corpus_index(spark, folder).total == 3


def test_unranked_documents_come_before_negative_scores(spark):
    scored = spark.createDataFrame([(1, d, -1.0 - d) for d in range(15)] + [(1, 40, 2.0)], "query_id long, doc_id long, score double")
    docs = spark.createDataFrame([(d,) for d in range(50)], "doc_id long")
    got = rank.all_ranked(scored, scored.select("query_id").distinct(), docs, 10, True).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [40, *range(15, 24)]


def test_corrections_by_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(3, 9)))
    vocab = {word(): rng.randint(1, 1000) for _ in range(300)}
    asked = sorted({w for w in (word() for _ in range(200)) if len(w) >= 4 and w not in vocab})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    near = {(w, t) for w in asked for t in vocab if w[0] == t[0] and abs(len(w) - len(t)) <= 2 and distance(w, t) <= (1 if len(w) <= 5 else 2)}
    table = spark.createDataFrame(sorted(vocab.items()), "term string, freq long")
    words = spark.createDataFrame([(w,) for w in asked], "word string")
    assert {(r["word"], r["term"]) for r in rewrite.correction_candidates(words, table).collect()} == near
    want = {}
    for w in asked:
        best = None
        for t in sorted(t for x, t in near if x == w):
            sim, lf = difflib.SequenceMatcher(None, w, t).ratio(), float(np.log1p(vocab[t]))
            if sim >= 0.82 and (best is None or sim > best[1] + 0.03 or (sim >= best[1] - 0.03 and lf > best[2] + 0.2)):
                best = (t, sim, lf)
        if best:
            want[w] = best[0]
    assert {r["word"]: r["corrected"] for r in rewrite.corrections(words, table).collect()} == want and want


def test_relevance_sample_by_brute_force(spark):
    rng = random.Random(9)
    qrels = [(q, rng.randrange(60), rng.choice([0, 1, 2])) for q in range(30) for _ in range(rng.randint(1, 8))]
    queries = spark.createDataFrame([(q, "x") for q in range(28)], "query_id long, query string")
    docs = spark.createDataFrame([(d, "y") for d in range(60)], "doc_id long, text string")
    for limit in (5, 20, 40):
        taken, kept = set(), []
        for q in range(28):
            own = {d for x, d, r in qrels if x == q and r > 0}
            if own and len(taken | own) <= limit:
                taken |= own
                kept.append(q)
        a, b = store.relevance_sample(queries, spark.createDataFrame(qrels, "query_id long, doc_id long, relevance int"), docs, limit)
        assert sorted(r["query_id"] for r in a.collect()) == kept
        want = taken | set([d for d in range(60) if d not in taken][: limit - len(taken)])
        assert {r["doc_id"] for r in b.collect()} == want


def test_store(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert store.get(docs, "doc_id", 2) == {"doc_id": 2, "text": "b"} and store.get(docs, "doc_id", 3) is None
    twice = spark.createDataFrame([(1, "z"), (1, "y")], "doc_id long, text string")
    assert [tuple(r) for r in store.upsert(docs, twice, ["doc_id"]).orderBy("doc_id").collect()] == [(1, "y"), (2, "b")]
    path = str(tmp_path / "t")
    export.ingest(docs, path, "x")
    export.ingest(docs.limit(1), path, "y")
    export.ingest(docs.withColumn("text", F.lit("new")), path, "x")
    held = spark.read.parquet(path)
    assert sorted((r["dataset_key"], r["text"]) for r in held.collect()) == [("x", "new"), ("x", "new"), ("y", "a")]
    assert store.without_dataset({"documents": held}, "x")["documents"].count() == 1
    parts = list(export.batches(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10)), size=3))
    assert [p.num_rows for p in parts] == [3, 1] and parts[0]["doc_id"].to_pylist() == [1, 2, 11]


def test_readers_and_export(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"id": "1", "title": "T", "contents": "x"}, {"docno": "2", "body": "y"}]')
    (tmp_path / "d.jsonl").write_text('{"_id": "1", "text": "x"}\n{"_id": "2", "text": "y"}\n')
    (tmp_path / "q.tsv").write_text("1\tone\nbad\n2\ttwo\tmore\n")
    (tmp_path / "r.tsv").write_text("1\td1\t2\n1\t0\td2\t1\nbad\n")
    assert sorted(r["doc_id"] for r in files.read_json(spark, str(tmp_path / "d.json")).collect()) == ["1", "2"]
    assert sorted(r["text"] for r in files.read_json(spark, str(tmp_path / "d.jsonl"), lines=True).collect()) == ["x", "y"]
    assert sorted(tuple(r) for r in files.read_queries(spark, str(tmp_path / "q.tsv")).collect()) == [("1", "one"), ("2", "two")]
    assert sorted(tuple(r) for r in files.read_qrels(spark, str(tmp_path / "r.tsv")).collect()) == [("1", "0", "d1", 2), ("1", "0", "d2", 1)]
    clinical = spark.createDataFrame([(" 7 ", "c", "", None, "e")], "docno string, condition string, summary string, detailed_description string, eligibility string")
    assert tuple(export.documents(clinical).first()) == ("7", "", "c e")
    other = spark.createDataFrame([("8", "h", "a b", ["x", " ", "y"], 5)], "docid string, headline string, one string, many array<string>, n int")
    assert tuple(export.documents(other).first()) == ("8", "h", "a b x y")
    assert tuple(export.judgements(spark.createDataFrame([("1", "d", "2")], "qid string, docid string, rel string")).first()) == ("1", "d", 2)
    with pytest.raises(Exception, match="without a query text"):
        export.queries(spark.createDataFrame([("1", "", "")], "qid string, disease string, gene string")).collect()
    report_path = str(tmp_path / "csv")
    files.write_report(spark.createDataFrame([("a", 1.5)], "name string, map double").coalesce(1), report_path)
    assert [tuple(r) for r in files.read_report(spark, report_path).collect()] == [("a", "1.5")] and files.read_report(spark, report_path).columns == ["name", "map"]
    part = next((tmp_path / "csv").glob("part*.csv")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbfname,map")


def test_top_terms_of_a_json_list(spark):
    rows = spark.createDataFrame([('[{"term": "a", "weight": 2}, {"term": " ", "weight": 1}, {"term": "b"}]',), ("[not json",), (None,), ("a:b:1.5 c:-1",)], "t string")
    got = [[tuple(x) for x in r["x"]] for r in rows.select(report.top_terms(F.col("t")).alias("x")).collect()]
    assert got == [[("a", 2.0), ("b", 0.0)], [("[not", 1.0), ("json", 0.5)], [], [("a:b", 1.5), ("c:-1", 0.0)]]


def test_suite_rows(corpus, spark):
    queries = spark.createDataFrame([(str(i), w) for i, w in enumerate(WORDS[:6])], "query_id string, query string")
    qrels = corpus.docs.crossJoin(queries).where(F.expr("contains(text, query)")).select("query_id", "doc_id", F.lit(1).alias("relevance"))
    calls = []

    def run(*a):
        calls.append(a[3])
        return suite.measured(*a)

    wanted = [c for c in suite.cases(["clinical_trials", "lost"]) if c.model in ("bm25", "distributed_bm25")]
    rows = suite.evaluate(spark, {"clinical_trials": (corpus, queries, qrels)}, [*wanted, suite.Case("clinical_trials", "ltr", "learning_to_rank", "extra_features", "ltr")], suite.Settings(depth=100), run=run).collect()
    own = [r for r in rows if r["dataset"] == "clinical_trials"]
    assert {r["status"] for r in own if r["model"] != "ltr"} == {"completed"} and all(r["map"] > 0.9 and r["queries"] == 6 and r["qps"] > 0 for r in own if r["model"] == "bm25" and not r["misspelled_queries"] and not r["use_query_refinement"])
    assert [(r["status"], r["warning"]) for r in own if r["model"] == "ltr"] == [("skipped", suite.NO_HELD_OUT)]
    assert all(r["status"] == "failed" and "no data" in r["error"] for r in rows if r["dataset"] == "lost")
    assert len(calls) < len(own)  # equal cases are measured once
    assert suite.held_out(wanted[0], {"held_out_query_ids": ["3", "3", " "]}).only == ("3",)
    changes = suite.compared(spark.createDataFrame(rows, suite.ROW)).where("feature_group = 'spelling_correction' and metric = 'map'").first()
    assert changes["dataset"] == "clinical_trials" and changes["before"] is not None
    timed = suite.single_against_batch(corpus, queries, SearchRequest("x", "clinical_trials", "bm25"), 2)
    assert timed["same_counts"] and timed["queries"] == 2


def test_command_line(corpus, spark, tmp_path):
    base = tmp_path / "sample_dataset"
    base.mkdir()
    corpus.docs.write.parquet(str(base / "documents.parquet"))
    (base / "queries.tsv").write_text("1\theart\n2\ttumor\n")
    (base / "qrels.tsv").write_text("1\t3\t1\n2\t5\t1\n")
    rows = suite.main([str(tmp_path), "--datasets", "sample_dataset", "--models", "bm25", "tfidf", "embedding", "--depth", "50", "--out", str(tmp_path / "out")]).collect()
    assert [(r["model"], r["status"]) for r in rows] == [("bm25", "completed"), ("tfidf", "completed"), ("embedding", "failed")]
    assert files.read_report(spark, str(tmp_path / "out")).count() == 3
    with pytest.raises(SystemExit):
        suite.main([str(tmp_path), "--datasets", "x", "--depth", "5"])


def test_guards(spark):
    make = lambda ids: spark.createDataFrame([(i, "q") for i in ids], "query_id string, query string")
    qrels = spark.createDataFrame([("1", 1, 1), ("2", 1, 1)], "query_id string, doc_id long, relevance int")
    for ids in (["1", "2", "2"], ["1", "2", " "], ["1"]):
        with pytest.raises(ValueError):
            metrics.guarded(make(ids), qrels)
    with pytest.raises(ValueError):
        metrics.guarded(make(["1", "2", "3"]), qrels, ["3"])
    assert metrics.guarded(make(["1", "2", "3"]), qrels, ["2"])[0].collect()[0]["query_id"] == "2"


def test_ltr_learns_and_explains(corpus, spark):
    queries = spark.createDataFrame([(str(i), f"{a} {b}") for i, (a, b) in enumerate(itertools.islice(itertools.combinations(WORDS, 2), 12))], "query_id string, query string")
    qrels = corpus.docs.crossJoin(queries).where(F.expr("contains(text, split(query, ' ')[0]) and contains(text, split(query, ' ')[1])")).select("query_id", "doc_id", F.lit(1).alias("relevance"))
    profile = PROFILES["clinical_trials"]
    rankings = {"bm25": rank.bm25(queries, corpus.index, profile, 60), "tfidf": rank.tfidf(queries, corpus.index, profile, 60)}
    rows = ltr.features(rankings, queries, corpus.docs, profile)
    assert len(ltr.feature_columns(rows)) == 27
    parts = keep(ltr.labelled(rows, qrels).join(ltr.split(queries), "query_id"), "parts")
    model = ltr.train(parts.where("not validation").drop("validation"), trees=5)
    held = parts.where("validation").drop("validation")
    scores = ltr.validation(model, held, qrels).first()
    assert scores["queries"] == 2 and scores["map"] > 0.8
    facts = ltr.metadata(parts, "clinical_trials", ("bm25", "tfidf"), 60, 42, scores.asDict())
    assert facts["validation_query_count"] == 2 == len(facts["held_out_query_ids"]) and facts["train_query_count"] == 10
    corpus.model = model
    made = search(corpus, SearchRequest("heart lung", "clinical_trials", "ltr", top_k=3, ltr_candidate_models="bm25,tfidf"))
    assert made.results.count() == 3
    details = ltr.explained(ltr.rerank(model, held, 3), held).first()["model_details"].asDict()
    assert set(details) == set(ltr.IMPORTANT)
    corpus.model = None


def test_cluster_sample_and_members(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 4)) + 8, rng.normal(size=(60, 4)) - 8])
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, embedding array<double>")
    middle = cluster.centres(table, 2, sample=40)
    assert sorted(map(tuple, middle.collect())) == sorted(map(tuple, cluster.centres(table.repartition(7), 2, sample=40).collect()))
    own = cluster.assigned(table, middle)
    first = own.where("doc_id = 0").first()["cluster_id"]
    assert {r["doc_id"] for r in cluster.members_of(own, first).collect()} == set(range(60))


def test_answer_sources_without_title(corpus, spark):
    ranking = spark.createDataFrame([("q", 1, 0.5, 1), ("q", 2, 0.4, 2)], "query_id string, doc_id long, score double, rank int")
    got = answer.sources(ranking, corpus.docs.drop("title"), 5).first()["sources"]
    assert [(s["source"], s["doc_id"], s["title"]) for s in got] == [(1, 1, ""), (2, 2, "")]


@pytest.mark.parametrize("stem", [False, True])
def test_core_edges(spark, stem):
    """Nulls, empty texts, ties and an empty table through index and rankings."""
    profile = Profile(stem=stem, least=1, stop_words=())
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "same words"), (4, "same words"), (5, "words " * 5000)], "doc_id long, text string").withColumns({"term": F.lit("x"), "tf": F.lit(1), "dl": F.lit(2)})
    own = index.Index.of(index.token_table(docs, profile), profile)
    queries = spark.createDataFrame([(1, "same words"), (2, ""), (3, None)], "query_id long, query string")
    got = [(r["query_id"], r["doc_id"]) for r in rank.bm25(queries, own, profile, 5, max_df=None).orderBy("query_id", "rank").collect()]
    assert got[:2] == [(1, 3), (1, 4)] and {q for q, _ in got} == {1}
    assert rank.tfidf(queries, own, profile, 5, min_df=1, max_df=None).where("rank = 1").first()["doc_id"] == 3
    none = index.Index.of(index.token_table(docs.limit(0), profile), profile)
    assert rank.bm25(queries, none, profile, pad=True).collect() == [] and rank.tfidf(queries, none, profile).collect() == [] and rank.bm25_all(queries, none, profile).collect() == []


def test_views(corpus, spark, tmp_path):
    import json

    assert [d["dataset"] for d in views.datasets() if "biomedical_embedding" in d["models"]] == ["clinical_trials"]
    with pytest.raises(ValueError):
        views.known("x")
    assert views.document(corpus, 3)["doc_id"] == 3 and views.document(corpus, 999) is None
    shown = views.results(search(corpus, SearchRequest("heart tumor", "clinical_trials", "rag", rag_retriever_model="bm25")))
    assert shown["count"] == 10 and len(shown["sources"]) == 5 and shown["confidence"] and shown["searched"] == "heart tumor"
    (tmp_path / "a.csv").write_text('﻿cluster_id,size,share,label\n1,20,0.5,"a ""quoted"", b"\n2,,x.y,\n', encoding="utf-8")
    rows = views.clusters(spark, str(tmp_path / "a.csv"))
    assert [json.loads(r["value"]) for r in views.as_json(rows).collect()] == [{"cluster_id": 1, "size": 20, "share": 0.5, "label": 'a "quoted", b'}, {"cluster_id": 2, "size": "", "share": "x.y", "label": ""}]
    (tmp_path / "t.csv").write_text("cluster_id,top_terms\n1,a:2 b:1\n")
    assert [tuple(x) for x in views.topics(spark, str(tmp_path / "t.csv")).first()["top_terms"]] == [("a", 2.0), ("b", 1.0)]
    (tmp_path / "full_bm25.csv").write_text("dataset,model,MAP\nquora,bm25,0.5\n")
    rows, sections, errors = views.evaluation(spark, str(tmp_path), {"model_comparison": ["full_bm25.csv", "lost.csv"], "runtime_comparison": "../x.csv"})
    assert [(r["scenario"], r["comparison_phase"], r["map"]) for r in rows.collect()] == [("bm25_baseline", "before", 0.5)]
    assert [e["source"] for e in errors] == ["lost.csv", "../x.csv"] and sections.where("n > 0").count() == 1
    assert [r["query"] for r in views.history(corpus.history, "u", "clinical_trials", 2).orderBy("nth").collect()] == ["renal heart", "renal dose"]
