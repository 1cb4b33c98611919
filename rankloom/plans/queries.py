"""Named queries over the given tables, one or more for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import answer, checks, cluster, index, ltr, metrics, rank, report, rewrite
from rankloom.operators import vectors as dense_index
from rankloom.plans.kept import corpus_index, keep
from rankloom.plans import search, suite
from rankloom.plans.request import SearchRequest
from rankloom.sources import export, store

PROFILE = T.PROFILES["clinical_trials"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the same steps in SQL

_STOP = "[" + ", ".join(f"'{w}'" for w in PROFILE.stop_words) + "]"
_ALL_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def norm_sql(c: str) -> str:
    x = f"translate(coalesce({c}, ''), '’‘–—−', '''''---')"
    for old, new in ((r"(?i)\bwon''t\b", "will not"), (r"(?i)\bcan''t\b", "can not"), (r"(?i)n''t\b", " not")):
        x = f"regexp_replace({x}, '{old}', '{new}', 'g')"
    x = f"regexp_replace(regexp_replace(lower({x}), '{T.URL}', ' ', 'g'), '{T.TAG}', ' ', 'g')"
    return f"trim(regexp_replace(translate({x}, '_', ' '), '\\s+', ' ', 'g'))"


def tokens_sql(c: str) -> str:
    return f"list_filter(regexp_extract_all({norm_sql(c)}, '{T.TOKEN}'), lambda t: length(regexp_replace(t, '[./:+\\-]', '', 'g')) >= {PROFILE.least} AND NOT list_contains({_STOP}, t))"


_CORPUS = f"""
toks AS MATERIALIZED (SELECT doc_id, {tokens_sql('text')} AS terms FROM documents),
dl AS MATERIALIZED (SELECT doc_id, CAST(len(terms) AS BIGINT) AS dl FROM toks),
stat AS MATERIALIZED (SELECT count(*) AS n, avg(dl) AS average FROM dl),
post AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM toks) GROUP BY ALL)"""
_IDF = """
vocab AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY term HAVING count(*) <= greatest(1, floor(0.98 * (SELECT n FROM stat)))),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM vocab, stat),
mean AS MATERIALIZED (SELECT avg(raw) AS mean FROM raw),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw, mean)"""
_TERMS = "terms AS MATERIALIZED (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({tokens}) AS term FROM {asked}) GROUP BY ALL)"
_ASKED = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
_BASE = f"{_CORPUS},{_IDF},\n{_ASKED},\n{_TERMS.format(tokens=tokens_sql('query'), asked='asked')}"
_SCORED = """
scored AS (SELECT query_id, p.doc_id, round(sum(qf * idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / average))), 6) AS score
  FROM terms t JOIN idf USING (term) JOIN post p USING (term) JOIN dl ON dl.doc_id = p.doc_id, stat GROUP BY ALL),
bm25 AS MATERIALIZED (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored WHERE score > 0)
"""
_BM25 = f"{_BASE},{_SCORED}"
_TFIDF = """,
tv AS MATERIALIZED (SELECT term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), stat
  WHERE df >= 2 AND df <= greatest(2, floor(0.98 * n)) ORDER BY df DESC, term LIMIT 100000),
dw AS MATERIALIZED (SELECT doc_id, term, (1.0 + ln(tf)) * idf AS w FROM post JOIN tv USING (term)),
du AS MATERIALIZED (SELECT doc_id, term, w / norm AS w FROM dw JOIN (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY doc_id) USING (doc_id)),
qw AS MATERIALIZED (SELECT query_id, term, (1.0 + ln(qf)) * idf AS w FROM terms JOIN tv USING (term)),
qu AS MATERIALIZED (SELECT query_id, term, w / norm AS w FROM qw JOIN (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY query_id) USING (query_id)),
tfidf AS MATERIALIZED (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank
  FROM (SELECT query_id, doc_id, round(sum(qu.w * du.w), 6) AS score FROM qu JOIN du USING (term) GROUP BY ALL) WHERE score > 0)
"""
_QRELS = "qrels AS (SELECT item_id AS query_id, doc_id, CAST(doc_id % 3 AS INT) AS relevance FROM benchmark JOIN documents ON doc_id % 40 = item_id % 40)"


def padded_sql(ranking: str, active: str, k: int = 1000) -> str:
    """CTEs that give ``padded``: the ranking, filled up with the first documents at score 0."""
    return f"""active AS (SELECT DISTINCT query_id FROM {active}),
fill AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT {2 * k}),
spare AS (SELECT a.query_id, f.doc_id, 0.0::DOUBLE AS score, 1 AS own FROM active a, fill f WHERE NOT EXISTS (SELECT 1 FROM {ranking} b WHERE b.query_id = a.query_id AND b.doc_id = f.doc_id AND b.rank <= {k})),
both_ AS (SELECT query_id, doc_id, score, 0 AS own FROM {ranking} WHERE rank <= {k} UNION ALL SELECT * FROM spare),
padded AS (SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, own, doc_id) AS INT) AS rank FROM both_) WHERE rank <= {k})"""


def asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def titled(spark, sf_dir):
    """Documents with their first six words as a title, as the tables hold none."""
    return table(spark, sf_dir, "documents").withColumn("title", F.array_join(F.slice(F.split("text", " "), 1, 6), " "))


_TITLED = "titled AS (SELECT *, array_to_string(string_split(text, ' ')[1:6], ' ') AS title FROM documents)"


def judged(spark, sf_dir):
    """Judgements made up by a rule, so that the metrics have something to count."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    return items.join(docs, docs["doc_id"] % 40 == items["item_id"] % 40).select(F.col("item_id").alias("query_id"), "doc_id", (F.col("doc_id") % 3).cast("int").alias("relevance"))


def bm25(spark, sf_dir, k=10, pad=False):
    return rank.bm25(asked(spark, sf_dir), corpus_index(spark, sf_dir), PROFILE, k, pad=pad)


def tfidf(spark, sf_dir, k=10, pad=False):
    return rank.tfidf(asked(spark, sf_dir), corpus_index(spark, sf_dir), PROFILE, k, pad=pad)


# --- lexical retrieval


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM bm25 WHERE rank <= 10")
def bm25_search(spark, sf_dir):
    return bm25(spark, sf_dir)


@query(f"WITH {_CORPUS} SELECT doc_id, CAST(len(terms) AS BIGINT) AS n_terms, CAST(len(list_distinct(terms)) AS BIGINT) AS n_distinct, md5(array_to_string(terms, ' ')) AS terms_md5 FROM toks")
def text_tokens(spark, sf_dir):
    rows = index.token_table(table(spark, sf_dir, "documents"), PROFILE)
    return rows.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.size(F.array_distinct("terms")).cast("long").alias("n_distinct"), F.md5(F.array_join("terms", " ")).alias("terms_md5"))


@query(f"SELECT page_id, md5({norm_sql('html')}) AS plain_md5 FROM pages")
def html_normalised(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.normalise(F.col("html"))).alias("plain_md5"))


@query(f"WITH {_CORPUS} SELECT term, doc_id, tf FROM post")
def index_postings(spark, sf_dir):
    return corpus_index(spark, sf_dir).postings.select("term", "doc_id", "tf")


@query(f"WITH {_CORPUS} SELECT doc_id, dl FROM dl")
def index_lengths(spark, sf_dir):
    return corpus_index(spark, sf_dir).lengths


@query(f"WITH {_CORPUS},{_IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_vocabulary(spark, sf_dir):
    return corpus_index(spark, sf_dir).bm25_idf().withColumn("idf", F.round("idf", 6))


@query(f"WITH {_CORPUS} SELECT n AS n_docs, (SELECT count(DISTINCT term) FROM post) AS n_terms, (SELECT count(*) FROM post) AS n_postings, round(average, 6) AS average_length FROM stat")
def index_summary(spark, sf_dir):
    return corpus_index(spark, sf_dir).summary()


@query(f"WITH {_BM25}, {padded_sql('bm25', 'terms JOIN idf USING (term)')} SELECT query_id, doc_id, score, rank FROM padded")
def bm25_padded(spark, sf_dir):
    return bm25(spark, sf_dir, 1000, pad=True)


_ALL = "SELECT query_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM (SELECT a.query_id, d.doc_id, coalesce(s.score, 0.0::DOUBLE) AS score FROM asked a CROSS JOIN documents d LEFT JOIN scored s ON s.query_id = a.query_id AND s.doc_id = d.doc_id)) WHERE rank <= 1000"
_WHOLE = _IDF.replace(" HAVING count(*) <= greatest(1, floor(0.98 * (SELECT n FROM stat)))", "")


@query(f"WITH {_CORPUS},{_WHOLE},{_ASKED},{_TERMS.format(tokens=tokens_sql('query'), asked='asked')},{_SCORED} {_ALL}")
def legacy_bm25_search(spark, sf_dir):
    """No pruning of terms, and all documents are ranked."""
    return rank.bm25_all(asked(spark, sf_dir), corpus_index(spark, sf_dir), PROFILE, 1000)


@query(f"WITH {_BM25}{_TFIDF} SELECT query_id, doc_id, score, rank FROM tfidf WHERE rank <= 10")
def tfidf_search(spark, sf_dir):
    return tfidf(spark, sf_dir)


@query(f"WITH {_BM25}{_TFIDF}, {padded_sql('tfidf', 'qu')} SELECT query_id, doc_id, score, rank FROM padded")
def tfidf_padded(spark, sf_dir):
    return tfidf(spark, sf_dir, 1000, pad=True)


_WHOLE_TFIDF = _TFIDF.replace("WHERE df >= 2 AND df <= greatest(2, floor(0.98 * n)) ORDER BY df DESC, term LIMIT 100000", "").replace("tfidf AS MATERIALIZED", "ranked_ AS").replace("(1.0 + ln(tf))", "tf").replace("(1.0 + ln(qf))", "qf")


@query(f"WITH {_BASE}{_WHOLE_TFIDF}, scored AS (SELECT query_id, doc_id, score FROM ranked_) {_ALL}")
def legacy_tfidf_search(spark, sf_dir):
    """The whole vocabulary, plain counts, and all documents are ranked."""
    return rank.tfidf_all(asked(spark, sf_dir), corpus_index(spark, sf_dir), PROFILE, 1000, sublinear=False)


_SHARD = "CAST((concat('0x', substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16))::UHUGEINT) % 4 AS INT)"


@query(f"SELECT {_SHARD} AS shard_id, count(*) AS n FROM documents GROUP BY 1")
def shard_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(index.shard_of(F.col("doc_id"), 4).alias("shard_id")).agg(F.count("*").alias("n"))


_SHARDS = f"""WITH {_BASE},
sdl AS (SELECT doc_id, dl, {_SHARD} AS shard_id FROM dl), size AS (SELECT shard_id, count(*) AS n, avg(dl) AS average FROM sdl GROUP BY 1),
sp AS (SELECT term, post.doc_id, tf, dl, shard_id FROM post JOIN sdl USING (doc_id)),
sdf AS (SELECT shard_id, term, count(*) AS df FROM sp GROUP BY ALL),
sraw AS (SELECT shard_id, term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM sdf JOIN size USING (shard_id) WHERE df <= greatest(1, floor(0.98 * n))),
sidf AS (SELECT shard_id, term, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM sraw JOIN (SELECT shard_id, avg(raw) AS m FROM sraw GROUP BY 1) USING (shard_id)),
loc AS (SELECT query_id, shard_id, doc_id, round(sum(qf * idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / average))), 6) AS local_score
  FROM terms JOIN sidf USING (term) JOIN sp USING (shard_id, term) JOIN size USING (shard_id) GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, shard_id ORDER BY local_score DESC, doc_id) AS INT) AS local_rank FROM loc WHERE local_score > 0),
fused AS (SELECT *, round(1.0 / (60 + local_rank), 8) AS score FROM ranked WHERE local_rank <= 100)"""
_FUSED = "SELECT query_id, doc_id, CAST(score AS DOUBLE) AS score, rank, shard_id, local_rank, local_score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, local_rank, shard_id, doc_id) AS INT) AS rank FROM fused) WHERE rank <= 10"


@query(f"{_SHARDS} {_FUSED}")
def distributed_bm25_search(spark, sf_dir):
    return rank.distributed_bm25(asked(spark, sf_dir), corpus_index(spark, sf_dir), PROFILE)


@query(f"{_SHARDS}, top AS (SELECT * FROM ({_FUSED})), held AS (SELECT shard_id, count(*) AS results, min(local_rank) AS best_local_rank FROM top GROUP BY 1) SELECT s.shard_id, n AS documents, round(average, 6) AS average_length, coalesce(results, 0) AS results, best_local_rank FROM size s LEFT JOIN held h ON h.shard_id = s.shard_id")
def shard_details(spark, sf_dir):
    return rank.shard_details(distributed_bm25_search(spark, sf_dir), corpus_index(spark, sf_dir), 4)


@query(f"""WITH {_BASE}{_TFIDF}, sterms AS (SELECT DISTINCT term FROM (SELECT shard_id, term, count(*) AS df FROM post JOIN (SELECT doc_id, {_SHARD} AS shard_id FROM documents) USING (doc_id) GROUP BY ALL) JOIN (SELECT {_SHARD} AS shard_id, count(*) AS n FROM documents GROUP BY 1) USING (shard_id) WHERE df <= greatest(1, floor(0.98 * n)))
SELECT 'bm25' AS model, (SELECT n FROM stat) AS documents, (SELECT count(DISTINCT term) FROM post) AS terms, NULL::INT AS width UNION ALL SELECT 'tfidf', (SELECT n FROM stat), (SELECT count(*) FROM tv), NULL
UNION ALL SELECT 'distributed_bm25', (SELECT n FROM stat), (SELECT count(*) FROM sterms), NULL UNION ALL SELECT 'embedding', (SELECT count(*) FROM embeddings), NULL, (SELECT CAST(max(len(embedding)) AS INT) FROM embeddings)""")
def index_information(spark, sf_dir):
    return corpus_index(spark, sf_dir).information(vectors(spark, sf_dir))


@query(f"WITH {_BM25} SELECT query_id, b.doc_id, score, rank, array_to_string(string_split(text, ' ')[1:6], ' ') AS title, substr(text, 1, 500) AS snippet, md5(text) AS text_md5 FROM bm25 b JOIN documents d ON d.doc_id = b.doc_id WHERE rank <= 10")
def enriched_results(spark, sf_dir):
    return rank.enrich(bm25(spark, sf_dir), titled(spark, sf_dir), raw=True, strict=True).withColumn("text_md5", F.md5("raw_text")).drop("raw_text")


# --- dense retrieval and fusion

_DOT = "list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def vector_queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dv"))


@query(f"""SELECT query_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM
(SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round({_DOT}, 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0)) WHERE rank <= 10""")
def dense_search(spark, sf_dir):
    return rank.dense(vector_queries(spark, sf_dir), vectors(spark, sf_dir))


@query(f"""SELECT query_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM
(SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round({_DOT}, 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 25 = 0)) WHERE rank <= 10""")
def biomedical_search(spark, sf_dir):
    """Vectors of the model for medical texts, which only one data set has; here the same table stands for them."""
    held = dense_index.biomedical("clinical_trials", vectors(spark, sf_dir), "medical", "medical")
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return rank.dense(queries, held)


@query("""SELECT doc_id, md5(substr(trim(regexp_replace(CASE WHEN t <> '' AND x <> '' THEN CASE WHEN starts_with(x, t) THEN x ELSE t || '. ' || x END ELSE t || x END, '\\s+', ' ', 'g')), 1, 2000)) AS encoded_md5
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN trim(source) ELSE trim(array_to_string(string_split(text, ' ')[1:6], ' ')) END AS t, trim(text) AS x FROM documents)""")
def embedding_texts(spark, sf_dir):
    docs = titled(spark, sf_dir)
    title = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.col("title"))
    return docs.select("doc_id", F.md5(dense_index.embedding_text(title, F.col("text"), "clinical_trials")).alias("encoded_md5"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(texts: list[str]) -> np.ndarray:
    """A stand-in for a trained encoder: how often a text holds each letter."""
    low = [x.lower() for x in texts]
    return np.array([[x.count(c) for c in LETTERS] for x in low], np.float32).reshape(len(texts), len(LETTERS))


_COUNTS = "[" + ", ".join(f"(length(x) - length(replace(x, '{c}', '')))::DOUBLE" for c in LETTERS) + "]"


@query(f"""SELECT doc_id, CAST(len(v) AS INT) AS width, round(v[1] / n, 4) AS a, round(v[5] / n, 4) AS e, round(v[20] / n, 4) AS t FROM
(SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS n FROM (SELECT doc_id, {_COUNTS} AS v FROM (SELECT doc_id, lower(text) AS x FROM documents)))""")
def encoded_documents(spark, sf_dir):
    made = dense_index.encoded(table(spark, sf_dir, "documents"), letter_counts, kind="double")
    part = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double"), 4)
    return made.select("doc_id", F.size("embedding").alias("width"), part(0).alias("a"), part(4).alias("e"), part(19).alias("t"))


@query("SELECT vec_id FROM embeddings ORDER BY md5('13|' || vec_id), vec_id LIMIT 100")
def dense_train_sample(spark, sf_dir):
    return dense_index.train_sample(table(spark, sf_dir, "embeddings").select("vec_id"), 100, key="vec_id")


@query("""SELECT * FROM (SELECT 'null vectors' AS problem, count(*) AS n FROM embeddings WHERE vec_id % 7 = 0
UNION ALL SELECT 'without a vector', count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT 'without a document', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'norms not one', count(*) FROM embeddings WHERE vec_id % 7 <> 0 AND abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 0.001) WHERE n > 0""")
def dense_index_check(spark, sf_dir):
    """Every seventh vector is taken away."""
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("embedding"))
    return dense_index.dense_problems(held, table(spark, sf_dir, "documents"))


@query()
def ivfpq_search(spark, sf_dir):
    held = vectors(spark, sf_dir)
    index_ = dense_index.IvfPq.fit(held, lists=16)
    return index_.search(keep(index_.code(held), "coded"), vector_queries(spark, sf_dir), probes=8, refine=10)


def own_vectors(spark, sf_dir):
    """A query's vector is the one of its own number."""
    return table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


@query(f"""WITH {_BM25}, {padded_sql('bm25', 'terms JOIN idf USING (term)')}, held AS (SELECT b.query_id, b.doc_id, b.rank AS bm25_rank, b.score AS bm25_score, round({_DOT}, 6) AS score FROM padded b
JOIN embeddings d ON d.vec_id = b.doc_id JOIN embeddings q ON q.vec_id = b.query_id)
SELECT query_id, doc_id, score, rank, bm25_rank, bm25_score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM held) WHERE rank <= 10""")
def hybrid_serial_search(spark, sf_dir):
    return rank.hybrid_serial(bm25(spark, sf_dir, 1000, pad=True), own_vectors(spark, sf_dir), vectors(spark, sf_dir))


_DENSE = f"""dense AS MATERIALIZED (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM
(SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round({_DOT}, 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id IN (SELECT item_id FROM benchmark)))"""


@query(f"""WITH {_BM25}{_TFIDF}, {_DENSE}, u AS (SELECT query_id, doc_id, rank, 0 AS place FROM tfidf WHERE rank <= 1000 UNION ALL SELECT query_id, doc_id, rank, 1 FROM bm25 WHERE rank <= 1000 UNION ALL SELECT query_id, doc_id, rank, 2 FROM dense WHERE rank <= 1000),
f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(place * 1000000 + rank) AS fst, count(*) AS n_models FROM u GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, rank, n_models FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, fst, doc_id) AS INT) AS rank FROM f) WHERE rank <= 10""")
def hybrid_parallel_search(spark, sf_dir):
    return rank.hybrid_parallel(three_models(spark, sf_dir))


def three_models(spark, sf_dir, k=1000):
    return {"tfidf": tfidf(spark, sf_dir, k), "bm25": bm25(spark, sf_dir, k), "embedding": rank.dense(own_vectors(spark, sf_dir), vectors(spark, sf_dir), k)}


# --- evaluation

_METRICS = f"""WITH {_BM25}, {_QRELS},
ideal AS (SELECT query_id, CAST(sum(CASE WHEN relevance > 0 THEN 1 ELSE 0 END) AS BIGINT) AS relevant, sum(CASE WHEN i <= 10 THEN (pow(2.0, relevance) - 1) / log2(i + 1.0) ELSE 0 END) AS idcg
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS i FROM qrels) GROUP BY 1),
hits AS (SELECT b.query_id, b.rank, coalesce(q.relevance, 0) AS rel, CASE WHEN coalesce(q.relevance, 0) > 0 THEN 1 ELSE 0 END AS hit FROM bm25 b LEFT JOIN qrels q ON q.query_id = b.query_id AND q.doc_id = b.doc_id WHERE b.rank <= 1000),
ran AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM hits),
sums AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN hit ELSE 0 END) AS top, sum(hit) AS allhits, sum(hit * seen / rank::DOUBLE) AS ap_sum, sum(CASE WHEN rank <= 10 THEN (pow(2.0, rel) - 1) / log2(rank + 1.0) ELSE 0 END) AS dcg FROM ran GROUP BY 1),
per AS (SELECT i.query_id, round(coalesce(top, 0) / 10.0::DOUBLE, 6) AS precision, round(CASE WHEN relevant > 0 THEN coalesce(allhits, 0)::DOUBLE / relevant ELSE 0 END, 6) AS recall,
  round(CASE WHEN relevant > 0 THEN coalesce(ap_sum, 0) / relevant ELSE 0 END, 6) AS ap, round(CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END, 6) AS ndcg FROM ideal i LEFT JOIN sums s ON s.query_id = i.query_id)"""


@query(f"{_METRICS} SELECT query_id, precision, recall, ap, ndcg FROM per")
def query_metrics(spark, sf_dir):
    return metrics.per_query(bm25(spark, sf_dir, 1000), judged(spark, sf_dir))


@query(f"{_METRICS} SELECT count(*) AS queries, round(avg(ap), 6) AS map, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM per")
def evaluation_summary(spark, sf_dir):
    return metrics.summary(query_metrics(spark, sf_dir))


@query(f"WITH {_BM25} SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS INT) AS rank FROM bm25 WHERE rank <= 100 AND doc_id % 5 <> 0")
def distinct_results(spark, sf_dir):
    """A ranking in which every second document comes again and every fifth has no name."""
    rows = bm25(spark, sf_dir, 100).select("query_id", F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("doc_id").cast("string")).alias("doc_id"), "rank")
    again = rows.where("rank % 2 = 0").withColumn("rank", F.col("rank") + 1000)
    return metrics.distinct_results(rows.unionByName(again)).select("query_id", F.col("doc_id").cast("long").alias("doc_id"), "rank")


@query("SELECT DISTINCT item_id + 20 AS query_id FROM benchmark WHERE item_id + 20 NOT IN (SELECT item_id FROM benchmark)")
def missing_queries(spark, sf_dir):
    shifted = judged(spark, sf_dir).withColumn("query_id", F.col("query_id") + 20)
    return metrics.missing_queries(shifted, asked(spark, sf_dir)).select("query_id")


def own_corpus(spark, sf_dir):
    encode = lambda queries: own_vectors(spark, sf_dir).join(queries.select(F.col("query_id").cast("long").alias("query_id")).distinct(), "query_id", "left_semi")
    docs = titled(spark, sf_dir).select("doc_id", "title", "text")
    return search.Corpus("clinical_trials", docs, corpus_index(spark, sf_dir), vectors(spark, sf_dir), encode, words=rewrite.surface_vocabulary(docs))


@query()
def suite_report(spark, sf_dir):
    """All sections but those that need a trained model; times are left out, as they differ between runs."""
    own = own_corpus(spark, sf_dir)
    # several cases ask for the words and judgements
    data = {"clinical_trials": (replace(own, words=keep(own.words, "words")), asked(spark, sf_dir), keep(judged(spark, sf_dir), "judged"))}
    return suite.evaluate(spark, data, suite.cases(["clinical_trials"])).drop("wall_seconds", "ms_per_query", "qps", "error")


# --- rewriting


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')"
_SURFACE = f"vocab AS (SELECT term, count(*) AS freq FROM (SELECT unnest({_WORDS}) AS term FROM documents) WHERE length(term) >= 3 GROUP BY 1 HAVING count(*) >= 20 ORDER BY freq DESC, term LIMIT 80000)"


@query(f"WITH {_SURFACE} SELECT term, freq FROM vocab")
def spelling_vocabulary(spark, sf_dir):
    return rewrite.surface_vocabulary(table(spark, sf_dir, "documents"))


@query(f"""WITH {_SURFACE}, w AS (SELECT DISTINCT word FROM (SELECT unnest({_WORDS}) AS word FROM benchmark) WHERE length(word) >= 4 AND word NOT IN (SELECT term FROM vocab))
SELECT word, term, freq, distance FROM (SELECT word, term, freq, CAST(levenshtein(word, term) AS INT) AS distance FROM w JOIN vocab ON word[1] = term[1] AND length(term) BETWEEN length(word) - 2 AND length(word) + 2)
WHERE distance <= CASE WHEN length(word) <= 5 THEN 1 ELSE 2 END""")
def spelling_candidates(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.surface_words(F.col("text"))).alias("word")).where(F.length("word") >= 4)
    return rewrite.correction_candidates(words, rewrite.surface_vocabulary(table(spark, sf_dir, "documents")))


@query()
def spelling_corrections(spark, sf_dir):
    broken = asked(spark, sf_dir).select("query_id", rewrite.misspelled(F.lower("query")).alias("query"))
    return rewrite.correct_queries(broken, rewrite.surface_vocabulary(table(spark, sf_dir, "documents")))


_HISTORY = "h AS (SELECT CAST(conv_id AS VARCHAR) AS user_id, turn AS id, text AS query, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM conversations WHERE role = 'user' AND trim(text) <> '')"


def history(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rewrite.recent_queries(rows.select(F.col("conv_id").cast("string").alias("user_id"), F.lit("conversations").alias("dataset"), F.col("turn").alias("id"), F.col("text").alias("query"), F.col("turn").alias("created_at")))


@query(f"WITH {_HISTORY} SELECT user_id, CAST(id AS BIGINT) AS id, CAST(nth AS INT) AS nth FROM h WHERE nth <= 20")
def recent_history(spark, sf_dir):
    return history(spark, sf_dir).select("user_id", F.col("id").cast("long").alias("id"), "nth")


@query(f"""WITH {_HISTORY}, past AS (SELECT user_id, nth, list_distinct_ordered.term AS term, list_distinct_ordered.pos AS pos FROM
 (SELECT user_id, nth, unnest(list_transform(range(1, len(ts) + 1), lambda i: {{'pos': i, 'term': ts[i]}})) AS list_distinct_ordered FROM (SELECT user_id, nth, {tokens_sql('query')} AS ts FROM h WHERE nth BETWEEN 2 AND 20))),
once AS (SELECT user_id, nth, term, min(pos) AS pos FROM past GROUP BY ALL),
cur AS (SELECT user_id, {tokens_sql('query')} AS own FROM h WHERE nth = 1),
cnt AS (SELECT user_id, term, count(*) AS n, min(nth * 1000000 + pos) AS place FROM once JOIN cur USING (user_id) WHERE length(term) > 2 AND NOT list_contains(own, term) GROUP BY ALL)
SELECT user_id AS query_id, term, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, place, term) AS INT) AS rank FROM cnt) WHERE rank <= 3""")
def personal_expansion(spark, sf_dir):
    """The newest query of each user, expanded from the ones before it."""
    rows = history(spark, sf_dir)
    now = rows.where("nth = 1").select(F.col("user_id").alias("query_id"), "user_id", "query")
    return rewrite.personal_terms(now, rows.where("nth > 1"), PROFILE)


@query(f"""WITH {_BM25}, held AS (SELECT b.query_id, b.doc_id, list_distinct({tokens_sql("substr(d.text, 1, 250)")}) AS ts FROM bm25 b JOIN documents d ON d.doc_id = b.doc_id WHERE rank <= 3),
own AS (SELECT query_id, {tokens_sql('query')} AS own FROM asked),
cnt AS (SELECT query_id, term, count(*) AS n FROM (SELECT query_id, unnest(ts) AS term FROM held) JOIN own USING (query_id) WHERE length(term) > 2 AND NOT list_contains(own, term) GROUP BY ALL)
SELECT query_id, term, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term) AS INT) AS rank FROM cnt) WHERE rank <= 5""")
def feedback_expansion(spark, sf_dir):
    return rewrite.feedback_terms(asked(spark, sf_dir), bm25(spark, sf_dir, 3), table(spark, sf_dir, "documents"), PROFILE)


@query("""SELECT doc_id, dataset, CASE WHEN dataset = 'other' THEN 'bm25' WHEN regexp_matches(q, '[\\x{0600}-\\x{06FF}]') THEN 'embedding' WHEN dataset = 'clinical_trials' THEN 'bm25'
WHEN dataset = 'quora' AND len(list_filter(regexp_split_to_array(trim(q), '\\s+'), lambda w: w <> '')) <= 3 THEN 'hybrid_serial' WHEN dataset = 'quora' THEN 'embedding' ELSE 'bm25' END AS model
FROM (SELECT doc_id, ['sample_dataset', 'clinical_trials', 'quora', 'other'][doc_id % 4 + 1] AS dataset, text AS q FROM documents)""")
def strategy_choice(spark, sf_dir):
    names = F.array(*(F.lit(x) for x in ("sample_dataset", "clinical_trials", "quora", "other")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.get(names, (F.col("doc_id") % 4).cast("int")).alias("dataset"), F.col("text").alias("q"))
    return rows.select("doc_id", "dataset", rewrite.chosen_model(F.col("dataset"), F.col("q")).alias("model"))


@query(f"WITH {_HISTORY}, cur AS (SELECT user_id, query FROM h WHERE nth = 1), {{personal}} SELECT c.user_id AS query_id, md5(concat_ws(' ', query, more)) AS query_md5 FROM cur c LEFT JOIN more m ON m.user_id = c.user_id".replace("{personal}", f"""past AS (SELECT user_id, nth, x.term AS term, x.pos AS pos FROM
 (SELECT user_id, nth, unnest(list_transform(range(1, len(ts) + 1), lambda i: {{'pos': i, 'term': ts[i]}})) AS x FROM (SELECT user_id, nth, {tokens_sql('query')} AS ts FROM h WHERE nth BETWEEN 2 AND 20))),
once AS (SELECT user_id, nth, term, min(pos) AS pos FROM past GROUP BY ALL), own AS (SELECT user_id, {tokens_sql('query')} AS own FROM cur),
cnt AS (SELECT user_id, term, count(*) AS n, min(nth * 1000000 + pos) AS place FROM once JOIN own USING (user_id) WHERE length(term) > 2 AND NOT list_contains(own, term) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, place, term) AS rank FROM cnt), more AS (SELECT user_id, string_agg(term, ' ' ORDER BY rank) AS more FROM best WHERE rank <= 3 GROUP BY 1)"""))
def personalised_queries(spark, sf_dir):
    rows = history(spark, sf_dir)
    now = rows.where("nth = 1").select(F.col("user_id").alias("query_id"), "user_id", "query")
    made = rewrite.appended(now, rewrite.personal_terms(now, rows.where("nth > 1"), PROFILE))
    return made.select("query_id", F.md5("query").alias("query_md5"))


_FEEDBACK = f"""held AS (SELECT b.query_id, b.doc_id, list_distinct({tokens_sql("substr(d.text, 1, 250)")}) AS ts FROM bm25 b JOIN documents d ON d.doc_id = b.doc_id WHERE rank <= 3),
own AS (SELECT query_id, {tokens_sql('query')} AS own FROM asked),
cnt AS (SELECT query_id, term, count(*) AS n FROM (SELECT query_id, unnest(ts) AS term FROM held) JOIN own USING (query_id) WHERE length(term) > 2 AND NOT list_contains(own, term) GROUP BY ALL),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term) AS INT) AS rank FROM cnt),
more AS (SELECT query_id, string_agg(term, ' ' ORDER BY rank) AS more FROM best WHERE rank <= 5 GROUP BY 1),
asked2 AS MATERIALIZED (SELECT a.query_id, concat_ws(' ', query, more) AS query FROM asked a LEFT JOIN more USING (query_id))"""


@query(f"""WITH {_BM25}, {_FEEDBACK}, {_TERMS.replace('terms AS', 'terms2 AS').format(tokens=tokens_sql('query'), asked='asked2')},
{_SCORED.replace('scored', 'scored2').replace('bm25 AS', 'bm25b AS').replace('FROM terms t', 'FROM terms2 t')} SELECT query_id, doc_id, score, rank FROM bm25b WHERE rank <= 10""")
def refined_search(spark, sf_dir):
    """BM25 once more with the feedback terms at the end of each query."""
    own = asked(spark, sf_dir)
    terms = rewrite.feedback_terms(own, bm25(spark, sf_dir, 3), table(spark, sf_dir, "documents"), PROFILE)
    return rank.bm25(rewrite.appended(own, terms), corpus_index(spark, sf_dir), PROFILE)


_FIRST = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark))"
_ONE = f"{_CORPUS},{_IDF},\n{_FIRST},\n{_TERMS.format(tokens=tokens_sql('query'), asked='asked')},{_SCORED}"


def first_request(spark, sf_dir, **fields):
    """A request is one text; here the first benchmark text."""
    text = table(spark, sf_dir, "benchmark").orderBy("item_id").select("text").first()["text"]
    return search.search(own_corpus(spark, sf_dir), SearchRequest.parse({"query": text, "dataset": "clinical_trials"} | fields))


@query(f"WITH {_ONE}, {padded_sql('bm25', 'terms JOIN idf USING (term)', 20)}, {_TITLED} SELECT p.doc_id, score, rank, title, substr(text, 1, 300) AS snippet, md5(text) AS text_md5, 'bm25' AS model FROM padded p JOIN titled d ON d.doc_id = p.doc_id")
def request_search(spark, sf_dir):
    made = first_request(spark, sf_dir, model=" BM25 ", top_k="20", snippet_length=300, include_raw_text="true")
    return made.results.withColumn("text_md5", F.md5("raw_text")).drop("raw_text", "query_id")


@query(f"WITH {_ONE}, {_FEEDBACK}, {_TERMS.replace('terms AS', 'terms2 AS').format(tokens=tokens_sql('query'), asked='asked2')}, {_SCORED.replace('scored', 'scored2').replace('bm25 AS', 'bm25b AS').replace('FROM terms t', 'FROM terms2 t')} SELECT doc_id, score, rank, 'agent' AS model FROM bm25b WHERE rank <= 10")
def request_agent_search(spark, sf_dir):
    """The agent chooses BM25 for this data set; the query is refined first."""
    made = first_request(spark, sf_dir, model="agent", use_query_refinement=True)
    return made.results.select("doc_id", "score", "rank", "model")


# --- answers

_CONTENT = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains({s}, w)))"
_ANSWER = f"""WITH {_BM25}, ctx AS (SELECT query_id, rank, trim(regexp_replace(substr(text, 1, 4000), '\\s+', ' ', 'g')) AS flat FROM bm25 b JOIN documents d ON d.doc_id = b.doc_id WHERE rank <= 5),
sp AS (SELECT query_id, rank, list_filter(string_split(regexp_replace(flat, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS ss FROM ctx),
se AS (SELECT query_id, rank, unnest(range(0, len(ss))) AS pos, unnest(ss) AS sentence FROM sp),
qw AS (SELECT query_id, {_CONTENT.format(c='query', s=_ALL_STOP)} AS words FROM asked),
ov AS (SELECT query_id, rank, pos, sentence, len(list_intersect({_CONTENT.format(c='sentence', s=_ALL_STOP)}, words)) AS overlap, len(words) AS nw FROM se JOIN qw USING (query_id)),
sc AS (SELECT query_id, rank, CAST(pos AS INT) AS pos, sentence, CAST(overlap AS INT) AS overlap, round(2.0::DOUBLE * overlap + overlap::DOUBLE / greatest(nw, 1) + 1.0::DOUBLE / greatest(rank, 1), 6) AS score FROM ov WHERE overlap > 0)"""


@query(f"{_ANSWER} SELECT query_id, rank, pos, overlap, score, md5(sentence) AS sentence_md5 FROM sc")
def answer_sentences(spark, sf_dir):
    return scored(spark, sf_dir).select("query_id", "rank", "pos", "overlap", "score", F.md5("sentence").alias("sentence_md5"))


def scored(spark, sf_dir):
    context = answer.contexts(bm25(spark, sf_dir, 5), table(spark, sf_dir, "documents"))
    return answer.scored_sentences(asked(spark, sf_dir), context)


@query(f"""{_ANSWER}, kd AS (SELECT *, row_number() OVER (PARTITION BY query_id, trim(regexp_replace(lower(sentence), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) ORDER BY score DESC, rank, pos, lower(sentence)) AS o FROM sc),
pk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, pos, lower(sentence)) AS nth FROM kd WHERE o = 1),
ag AS (SELECT query_id, string_agg(sentence || ' [' || rank || ']', ' ' ORDER BY rank, pos) AS answer, count(DISTINCT rank) AS n_sources, count(*) AS n_sentences, sum(overlap) AS overlap FROM pk WHERE nth <= 4 GROUP BY 1)
SELECT a.query_id, md5(coalesce(answer, '')) AS answer_md5, CASE WHEN answer IS NULL THEN 'insufficient' WHEN n_sources >= 2 AND n_sentences >= 2 AND overlap >= 4 THEN 'high' WHEN overlap >= 2 THEN 'medium' ELSE 'low' END AS confidence,
coalesce(n_sources, 0) AS n_sources, coalesce(n_sentences, 0) AS n_sentences FROM asked a LEFT JOIN ag ON ag.query_id = a.query_id""")
def extractive_answers(spark, sf_dir):
    made = answer.answers(asked(spark, sf_dir), answer.selected(scored(spark, sf_dir)))
    return made.select("query_id", F.md5("answer").alias("answer_md5"), "confidence", "n_sources", "n_sentences")


@query(f"""WITH {_BM25}, {_TITLED} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS source, b.doc_id, title, md5(substr(text, 1, 500)) AS snippet_md5, rank, score
FROM bm25 b JOIN titled d ON d.doc_id = b.doc_id WHERE rank <= 5""")
def answer_sources(spark, sf_dir):
    made = answer.sources(bm25(spark, sf_dir, 5), titled(spark, sf_dir)).select("query_id", F.explode("sources").alias("s"))
    return made.select("query_id", "s.source", "s.doc_id", "s.title", F.md5("s.snippet").alias("snippet_md5"), "s.rank", "s.score")


@query(f"""WITH {_BM25}, b AS (SELECT query_id, string_agg('[' || rank || '] ' || substr(text, 1, 1800), chr(10) || chr(10) ORDER BY rank) AS blocks FROM bm25 b JOIN documents d ON d.doc_id = b.doc_id WHERE rank <= 5 GROUP BY 1)
SELECT a.query_id, md5('Answer from the numbered sources only and cite them.' || chr(10) || chr(10) || coalesce(blocks, '') || chr(10) || chr(10) || 'Question: ' || query) AS prompt_md5 FROM asked a LEFT JOIN b USING (query_id)""")
def answer_prompts(spark, sf_dir):
    made = answer.prompts(asked(spark, sf_dir), answer.contexts(bm25(spark, sf_dir, 5), table(spark, sf_dir, "documents")))
    return made.select("query_id", F.md5("prompt").alias("prompt_md5"))


# --- clusters and topics

def label_centres(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label"), F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return rows.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre")).withColumnRenamed("label", "cluster_id")


def members(spark, sf_dir):
    """Clusters by the given label, which makes their texts the same in any engine."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster_id"))


_ASSIGNED = """m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2),
middle AS MATERIALIZED (SELECT label AS cluster_id, list(m ORDER BY i) AS centre FROM m GROUP BY 1),
far AS (SELECT vec_id AS doc_id, cluster_id, round(list_sum(list_transform(list_zip(embedding, centre), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))), 9) AS distance FROM embeddings, middle),
assigned AS MATERIALIZED (SELECT doc_id, cluster_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, cluster_id) AS o FROM far) WHERE o = 1)"""


@query(f"WITH {_ASSIGNED} SELECT doc_id, cluster_id, distance FROM assigned")
def cluster_assignments(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return cluster.assigned(own, label_centres(spark, sf_dir))


_SUMMARY = "summary AS (SELECT cluster_id, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM assigned), 4) AS percentage, list(doc_id ORDER BY distance, doc_id)[1] AS representative FROM assigned GROUP BY 1)"


@query(f"WITH {_ASSIGNED}, {_SUMMARY} SELECT cluster_id, n, percentage, representative FROM summary")
def cluster_summaries(spark, sf_dir):
    return cluster.cluster_summary(cluster_assignments(spark, sf_dir))


_USEFUL = "length(term) >= 3 AND length(regexp_replace(term, '[^0-9]', '', 'g')) * 2 < length(term) AND term NOT IN (" + ", ".join(f"'{w}'" for w in cluster.CLINICAL_STOP) + ")"
_TOPICS = f"""WITH part AS (SELECT vec_id AS doc_id, label AS cluster_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 500),
w AS (SELECT cluster_id, unnest(list_distinct({tokens_sql('text')})) AS term FROM part JOIN documents USING (doc_id)),
n AS (SELECT cluster_id, term, count(*) AS n FROM w WHERE {_USEFUL} GROUP BY ALL),
topics AS (SELECT cluster_id, term, n, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, term) AS INT) AS rank FROM n QUALIFY rank <= 10)"""


@query(f"{_TOPICS} SELECT cluster_id, term, n, rank FROM topics")
def topic_words(spark, sf_dir):
    return cluster.topic_terms(members(spark, sf_dir), table(spark, sf_dir, "documents"), PROFILE)


@query(f"{_TOPICS} SELECT cluster_id, string_agg(term, ', ' ORDER BY rank) AS label FROM topics WHERE rank <= 5 GROUP BY 1")
def topic_names(spark, sf_dir):
    return cluster.topic_labels(topic_words(spark, sf_dir))


@query(f"{_TOPICS} SELECT round(count(DISTINCT term)::DOUBLE / count(*), 6) AS diversity FROM topics")
def topic_diversity(spark, sf_dir):
    return cluster.topic_diversity(topic_words(spark, sf_dir))


@query()
def kmeans_clusters(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return cluster.cluster_summary(cluster.assigned(own, cluster.centres(own, 10)))


@query(f"""{_TOPICS}, {_ASSIGNED}, {_SUMMARY}, labels_ AS (SELECT cluster_id, string_agg(term, ', ' ORDER BY rank) FILTER (rank <= 5) AS label, string_agg(term, ', ' ORDER BY rank) AS terms FROM topics GROUP BY 1),
ex AS (SELECT cluster_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY distance, doc_id) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY distance, doc_id) AS o FROM assigned) WHERE o <= 3 AND cluster_id % 3 <> 0 GROUP BY 1)
SELECT s.cluster_id, coalesce(label, '') AS label, n AS size, percentage, coalesce(terms, '') AS top_terms, coalesce(examples, CAST(representative AS VARCHAR)) AS examples FROM summary s LEFT JOIN labels_ USING (cluster_id) LEFT JOIN ex USING (cluster_id)""")
def cluster_topic_report(spark, sf_dir):
    """Every third cluster has no examples, and falls back on its representative."""
    own = keep(cluster_assignments(spark, sf_dir), "assigned")
    summaries = cluster.cluster_summary(own)
    topics = cluster.topic_report(summaries, topic_words(spark, sf_dir), own.where("cluster_id % 3 <> 0"))
    return report.cluster_topics(summaries, topics)


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN a || ':3.5, ' || b || ' ' || c || ':0.5' WHEN 1 THEN a || '|' || b || ';' || c WHEN 2 THEN '["' || a || '", "' || b || '"]' ELSE ' ' END AS text, a, b, c
 FROM (SELECT doc_id, 'lang_' || lang AS a, 'source_' || source AS b, 'x' || doc_id AS c FROM documents))
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN a || '=3.5 ' || b || '=0.0 ' || c || '=0.5' WHEN 1 THEN a || '=1.0 ' || b || '=0.6667 ' || c || '=0.3333' WHEN 2 THEN a || '=1.0 ' || b || '=0.5' ELSE '' END AS terms FROM t""")
def top_terms(spark, sf_dir):
    """Texts of topic terms in each of the forms that a report may hold."""
    a, b, c = F.concat(F.lit("lang_"), "lang"), F.concat(F.lit("source_"), "source"), F.concat(F.lit("x"), F.col("doc_id").cast("string"))
    kind = F.col("doc_id") % 4
    text = F.when(kind == 0, F.concat(a, F.lit(":3.5, "), b, F.lit(" "), c, F.lit(":0.5"))).when(kind == 1, F.concat(a, F.lit("|"), b, F.lit(";"), c)).when(kind == 2, F.concat(F.lit('["'), a, F.lit('", "'), b, F.lit('"]'))).otherwise(" ")
    made = table(spark, sf_dir, "documents").select("doc_id", report.top_terms(text).alias("t"))
    return made.select("doc_id", F.array_join(F.transform("t", lambda x: F.concat(x["term"], F.lit("="), x["weight"].cast("string"))), " ").alias("terms"))


# --- learning to rank


def ltr_rows(spark, sf_dir):
    # kept, as candidates are asked for twice: their texts, and their rows
    rankings = {m: keep(r, m) for m, r in three_models(spark, sf_dir).items()}
    return ltr.features(rankings, asked(spark, sf_dir), titled(spark, sf_dir), PROFILE)


def _flat(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"


def _union(m: str) -> str:
    return ", ".join(f"coalesce(max(CASE WHEN model = '{m}' THEN {c} END), 0.0)::DOUBLE AS {m}_{c}" for c in ("score", "rank"))


_SHORT = tuple(ltr.SHORT.values())
_RR = {m: f"CASE WHEN {m}_rank > 0 THEN 1.0::DOUBLE / (60 + {m}_rank) ELSE 0 END" for m in _SHORT}
_LTR = f"""WITH {_BM25}{_TFIDF}, {_DENSE}, {_TITLED},
parts AS (SELECT query_id, doc_id, 'bm25' AS model, score, rank FROM bm25 WHERE rank <= 1000 UNION ALL SELECT query_id, doc_id, 'tfidf', score, rank FROM tfidf WHERE rank <= 1000 UNION ALL SELECT query_id, doc_id, 'embedding', score, rank FROM dense WHERE rank <= 1000),
wide AS (SELECT query_id, doc_id, {", ".join(map(_union, _SHORT))} FROM parts GROUP BY ALL),
dt AS (SELECT doc_id, {tokens_sql('title')} AS tt, {tokens_sql('text')} AS dt, {_flat('title')} AS ft, {_flat('text')} AS fx FROM titled),
held_ AS (SELECT w.doc_id, coalesce(tt, []) AS tt, coalesce(dt, []) AS dt, coalesce(ft, '') AS ft, coalesce(fx, '') AS fx FROM (SELECT DISTINCT doc_id FROM wide) w LEFT JOIN dt ON dt.doc_id = w.doc_id),
qt AS (SELECT query_id, {tokens_sql('query')} AS qt, {_flat('query')} AS fq FROM asked),
rows_ AS (SELECT w.*, {", ".join(f"({m}_rank > 0)::INT::DOUBLE AS in_{m}, {_RR[m]} AS reciprocal_rank_{m}" for m in _SHORT)},
 {" + ".join(_RR[m] for m in _SHORT)} AS rrf_sum, len(qt)::DOUBLE AS query_token_count, len(tt)::DOUBLE AS title_token_count, len(dt)::DOUBLE AS snippet_token_count, (len(tt) + len(dt))::DOUBLE AS document_length,
 len(list_intersect(list_distinct(qt), list_concat(tt, dt)))::DOUBLE AS query_term_overlap_count, len(list_intersect(list_distinct(qt), tt))::DOUBLE AS title_query_overlap_count, len(list_distinct(qt)) AS nq,
 (contains(ft, fq) AND fq <> '')::INT::DOUBLE AS exact_query_in_title, (contains(fx, fq) AND fq <> '')::INT::DOUBLE AS exact_query_in_snippet FROM wide w JOIN qt USING (query_id) JOIN held_ USING (doc_id)),
feats AS MATERIALIZED (SELECT *, CASE WHEN nq > 0 THEN query_term_overlap_count / nq ELSE 0 END AS query_term_overlap_ratio, CASE WHEN nq > 0 THEN title_query_overlap_count / nq ELSE 0 END AS title_query_overlap_ratio FROM rows_)"""
_FEATURES = [*(f"{m}_{c}" for m in _SHORT for c in ("score", "rank")), *(f"in_{m}" for m in _SHORT), "query_token_count", "title_token_count", "snippet_token_count", "document_length", "query_term_overlap_count", "query_term_overlap_ratio",
             "title_query_overlap_count", "title_query_overlap_ratio", "exact_query_in_title", "exact_query_in_snippet", *(f"reciprocal_rank_{m}" for m in _SHORT), "rrf_sum"]


@query(f"{_LTR} SELECT query_id, doc_id, {', '.join(f'round({c}, 9) AS {c}' for c in _FEATURES)} FROM feats")
def ltr_features(spark, sf_dir):
    return ltr_rows(spark, sf_dir).select("query_id", "doc_id", *(F.round(c, 9).alias(c) for c in _FEATURES))


@query(f"{_LTR} SELECT b.query_id, b.doc_id, b.rank, {', '.join(f'round({c}, 6) AS {c}' for c in ltr.IMPORTANT)} FROM bm25 b JOIN feats f ON f.query_id = b.query_id AND f.doc_id = b.doc_id WHERE b.rank <= 10")
def ltr_explanations(spark, sf_dir):
    made = ltr.explained(bm25(spark, sf_dir), ltr_rows(spark, sf_dir))
    return made.select("query_id", "doc_id", "rank", "model_details.*")


def ltr_parts(spark, sf_dir):
    rows = keep(ltr.labelled(ltr_rows(spark, sf_dir), judged(spark, sf_dir)), "ltr")
    return rows.join(ltr.split(asked(spark, sf_dir)), "query_id")


@query("""SELECT item_id AS query_id, row_number() OVER (ORDER BY sha256('42|' || item_id), item_id) <= greatest(1, least((SELECT count(*) FROM benchmark) - 1, round(0.2 * (SELECT count(*) FROM benchmark)))) AS validation FROM benchmark""")
def ltr_split(spark, sf_dir):
    return ltr.split(asked(spark, sf_dir))


@query()
def ltr_validation(spark, sf_dir):
    """Metrics of the held-out queries."""
    parts = ltr_parts(spark, sf_dir)
    model = ltr.train(parts.where("not validation").drop("validation"), trees=20)
    return ltr.validation(model, parts.where("validation").drop("validation"), judged(spark, sf_dir))


@query()
def ltr_ranking(spark, sf_dir):
    """Trained on four fifths of the queries, ranks the others."""
    parts = ltr_parts(spark, sf_dir)
    model = ltr.train(parts.where("not validation").drop("validation"), trees=20)
    return ltr.rerank(model, parts.where("validation").drop("validation"))


# --- the document store


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def document_counts(spark, sf_dir):
    return store.counts(table(spark, sf_dir, "documents"), "lang")


@query(f"WITH {_QRELS} SELECT DISTINCT doc_id FROM (SELECT doc_id + 5 AS doc_id FROM qrels) WHERE doc_id NOT IN (SELECT doc_id FROM documents) ORDER BY doc_id LIMIT 100")
def dangling_judgements(spark, sf_dir):
    shifted = judged(spark, sf_dir).withColumn("doc_id", F.col("doc_id") + 5)
    return store.dangling(shifted, table(spark, sf_dir, "documents"))


@query(f"WITH {_QRELS} SELECT DISTINCT query_id, doc_id, relevance FROM qrels WHERE query_id IN (SELECT item_id FROM benchmark WHERE length(text) >= 200) AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def judged_subset(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    return store.judged_subset(judged(spark, sf_dir), asked(spark, sf_dir).where("length(query) >= 200"), docs).select("query_id", "doc_id", "relevance")


@query("SELECT count(*) AS n, min(doc_id) AS least, max(doc_id) AS greatest FROM documents")
def corpus_signature(spark, sf_dir):
    return store.signature(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE source END AS source FROM documents UNION ALL SELECT doc_id + 1000000000, lang, 'new' FROM documents WHERE doc_id % 11 = 0")
def upserted_documents(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    fresh = old.where("doc_id % 7 = 0").withColumn("source", F.lit("new"))
    more = old.where("doc_id % 11 = 0").withColumns({"doc_id": F.col("doc_id") + 1000000000, "source": F.lit("new")})
    return store.upsert(old, fresh.unionByName(more), ["doc_id"])


@query("SELECT pos, CAST(doc_id AS BIGINT) AS doc_id, lang FROM (SELECT * FROM (VALUES (0, 5), (1, 3), (2, 5), (4, 0)) v(pos, doc_id)) JOIN documents USING (doc_id)")
def fetched_documents(spark, sf_dir):
    return store.fetch(table(spark, sf_dir, "documents").select("doc_id", "lang"), [5, 3, 5, -1, 0]).select("pos", "doc_id", "lang")


@query("SELECT text_md5, doc_id FROM (SELECT md5(text) AS text_md5, min(doc_id) AS doc_id FROM documents GROUP BY 1)")
def first_copies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5"), "doc_id")
    return store.first_of_id(docs, "doc_id", "text_md5")


@query("SELECT doc_id, md5(trim(regexp_replace(trim(regexp_replace(translate(text, chr(160), ' '), '\\r\\n?', chr(10), 'g')), '[\\t\\n]+', ' ', 'g'))) AS clean_md5 FROM documents")
def cleaned_fields(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.tsv_text(F.col("text"))).alias("clean_md5"))


_DAMAGED = "CASE WHEN length({w}) >= 7 THEN {w}[1:greatest(2, length({w}) // 2)] || {w}[greatest(2, length({w}) // 2) + 2:] ELSE {w}[1] || {w}[3] || {w}[2] || {w}[4:] END"


@query(f"""WITH p AS (SELECT item_id AS query_id, string_split(text, ' ') AS ps FROM benchmark),
c AS (SELECT query_id, ps, list_filter(range(1, len(ps) + 1), lambda i: regexp_full_match(ps[i], '[A-Za-z]{{5,}}'))[1:2] AS ch FROM p)
SELECT query_id, array_to_string(list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN list_contains(ch, i) THEN {_DAMAGED.format(w='ps[i]')} ELSE ps[i] END), ' ') AS query FROM c""")
def misspelled_queries(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", rewrite.misspelled(F.col("query")).alias("query"))


@query("SELECT * FROM (SELECT doc_id, md5(replace(text, '&', 'and')) AS text_md5 FROM documents)")
def repaired_texts(spark, sf_dir):
    """ASCII letters and digits in their full-width forms come back as they were."""
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    wide = "".join(chr(ord(c) + 0xFEE0) for c in plain)
    text = F.translate(F.regexp_replace("text", "&", "and"), plain, wide)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.repaired(text)).alias("text_md5"))


@query(f"SELECT item_id AS query_id, array_to_string({tokens_sql('text')}, ' ') AS processed_query FROM benchmark")
def processed_queries(spark, sf_dir):
    return export.processed(asked(spark, sf_dir), PROFILE).select("query_id", "processed_query")


@query("""WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, trim(regexp_replace(trim(translate(text, chr(160), ' ')), '\r\n?', chr(10), 'g')) AS text FROM documents)
SELECT doc_id, md5(text) AS text_md5 FROM r""")
def exported_documents(spark, sf_dir):
    """Records under other names, each twice; the first of an id is exported."""
    raw = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("docno"), F.col("text").alias("body"), F.lit(0).alias("place"))
    again = raw.withColumns({"body": F.lit("again"), "place": F.lit(1)})
    both = raw.unionByName(again)
    rows = export.documents(both).withColumn("place", F.when(F.col("text") == "again", 1).otherwise(0))
    return export.exported(rows, "doc_id", "place").select("doc_id", F.md5("text").alias("text_md5"))


@query("SELECT CAST(doc_id AS VARCHAR) AS query_id, concat_ws(' ', nullif(trim(lang), ''), nullif(trim(source), ''), 'number ' || doc_id) AS query FROM documents")
def exported_queries(spark, sf_dir):
    """Records of the clinical form."""
    raw = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.col("lang").alias("disease"), F.col("source").alias("gene"), F.lit(None).cast("string").alias("demographic"), F.concat(F.lit("number "), F.col("doc_id").cast("string")).alias("other"))
    return export.queries(raw)


@query(f"WITH {_QRELS} SELECT 'judged doc_id unknown' AS problem, count(DISTINCT doc_id + 5) AS n FROM qrels WHERE doc_id + 5 NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'queries more than stated', 1")
def ingest_check(spark, sf_dir):
    """The manifest states one query less, and judgements are shifted."""
    docs, own = table(spark, sf_dir, "documents"), asked(spark, sf_dir)
    shifted = judged(spark, sf_dir).withColumn("doc_id", F.col("doc_id") + 5)
    return checks.ingest_problems(docs, own, shifted, {"documents": docs.count(), "queries": own.count() - 1})


@query("SELECT * FROM (SELECT 'wrong lengths' AS problem, count(*) AS n FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT 'documents without a length', count(*) FROM documents WHERE doc_id % 10 = 1) WHERE n > 0")
def index_check(spark, sf_dir):
    """Of an index whose lengths have been tampered with."""
    own = corpus_index(spark, sf_dir)
    broken = own.lengths.where("doc_id % 10 <> 1").withColumn("dl", F.when(F.col("doc_id") % 10 == 0, F.col("dl") + 1).otherwise(F.col("dl")))
    return checks.index_problems(replace(own, lengths=broken), table(spark, sf_dir, "documents"))


@query(f"SELECT 'shard 1' AS problem, CAST(2 AS BIGINT) AS n")
def shard_check(spark, sf_dir):
    """Against a manifest that states two documents less for one shard."""
    held = {r["shard_id"]: r["n"] for r in corpus_index(spark, sf_dir).shard_sizes(4).collect()}
    return checks.shard_problems(corpus_index(spark, sf_dir), 4, held | {1: held[1] - 2})


@query(f"WITH {_CORPUS} SELECT 'terms below the least frequency' AS problem, count(*) AS n FROM (SELECT term FROM post GROUP BY term HAVING count(*) = 2) HAVING count(*) > 0")
def tfidf_check(spark, sf_dir):
    """The whole vocabulary of a least frequency of 2, checked for one of 3; a largest number of terms would leave out rare ones."""
    own = corpus_index(spark, sf_dir)
    other = replace(own, made={("tfidf-idf", 3, 0.98, None): own.tfidf_idf(2, 0.98, None), ("norms", 3, 0.98, None, True): own.norms(2, 0.98, None)})
    return checks.tfidf_problems(other, (3, 0.98, None))


@query("SELECT * FROM (VALUES ('preprocessing.least'), ('preprocessing.stem'), ('parameters.k1')) v(field)")
def manifest_check(spark, sf_dir):
    """Fields in which the manifests of two data sets' indexes differ, but for their names."""
    own = corpus_index(spark, sf_dir)
    one, two = checks.manifest(own, PROFILE, "x", k1=1.5), checks.manifest(own, T.PROFILES["quora"], "x", k1=1.2)
    return spark.createDataFrame([(x,) for x in checks.manifest_problems(one, two)], "field string")


# --- reports


def made_up_report(spark, sf_dir):
    """Report rows by a rule: a data set for each language, a model for each source."""
    scores = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("dataset"), F.col("source").alias("model"))
    return scores.agg(F.round(F.sum(F.col("doc_id") % 97) / F.count("*"), 6).alias("MAP (all)"), F.round(F.sum(F.col("doc_id") % 89) / F.count("*"), 6).alias("nDCG@10"))


_REPORT = "WITH r AS (SELECT lang AS dataset, source AS model, round(sum(doc_id % 97)::DOUBLE / count(*), 6) AS map, round(sum(doc_id % 89)::DOUBLE / count(*), 6) AS ndcg FROM documents GROUP BY ALL)"


@query(f"{_REPORT} SELECT dataset, model, map, NULL::DOUBLE AS precision, NULL::DOUBLE AS recall, ndcg FROM r")
def normalised_report(spark, sf_dir):
    return report.normalised(made_up_report(spark, sf_dir), ["dataset", "model"])


@query(f"{_REPORT} SELECT dataset, min(model) AS model, map FROM r JOIN (SELECT dataset, max(map) AS map FROM r GROUP BY 1) USING (dataset, map) GROUP BY dataset, map")
def best_models(spark, sf_dir):
    return report.best_models(normalised_report(spark, sf_dir))


_FILES = ("results_bm25_refinement_improved_v2.csv", "quora_bm25_refinement.csv", "x/clinical_bm25_baseline.csv", "quora_full_bm25.csv", "quora_full_tfidf.csv", "a_distributed_bm25.csv", "hybrid_parallel_batch_1.csv", "biomedical_run.csv", "quora_ltr.csv", "model_baseline.csv", "with_refinement.csv", "quora_all_embedding_flat.csv", "plain.csv", "prf_run_one.csv")
_FILE = "[" + ", ".join(f"'{f}'" for f in _FILES) + f"][doc_id % {len(_FILES)} + 1]"


@query(f"""WITH f AS (SELECT doc_id, {_FILE} AS file, CASE WHEN doc_id % 5 = 0 THEN ' ' || source || ' ' END AS named, CASE WHEN doc_id % 7 = 0 THEN 'yes' WHEN doc_id % 7 = 1 THEN '0' END AS refined FROM documents),
g AS (SELECT *, regexp_replace(lower(regexp_extract(file, '[^/]*$')), '\.[^.]*$', '') AS stem FROM f),
h AS (SELECT *, coalesce(trim(named), CASE WHEN contains(stem, 'bm25_refinement_improved') THEN 'after_refinement_improved' WHEN contains(stem, 'bm25_refinement') THEN 'after_refinement' WHEN contains(stem, 'bm25_baseline') THEN 'before_refinement'
 WHEN contains(stem, 'full_bm25') THEN 'bm25_baseline' WHEN contains(stem, 'full_tfidf') THEN 'tfidf_baseline' WHEN contains(stem, 'distributed_bm25') THEN 'distributed' WHEN contains(stem, 'hybrid_parallel_batch') THEN 'hybrid_parallel_batch'
 WHEN contains(stem, 'biomedical') THEN 'biomedical' WHEN contains(stem, 'ltr') THEN 'learning_to_rank' WHEN contains(stem, 'baseline') THEN 'baseline' WHEN contains(stem, 'refinement') THEN 'after_refinement'
 ELSE regexp_replace(stem, '^[^_]*_[^_]*_|^[^_]*_(?=[^_]*$)', '') END) AS scenario FROM g)
SELECT doc_id, scenario, CASE WHEN refined = 'yes' THEN 'after' WHEN refined = '0' THEN 'before' WHEN scenario IN ({", ".join(f"'{x}'" for x in report.BEFORE)}) THEN 'before' WHEN scenario IN ({", ".join(f"'{x}'" for x in report.AFTER)}) THEN 'after'
 WHEN contains(file, 'refinement') OR contains(file, '_prf_') OR starts_with(file, 'prf_') THEN 'after' WHEN contains(file, 'baseline') OR contains(file, 'full_bm25') THEN 'before' END AS comparison_phase FROM h""".replace("^[^_]*_[^_]*_|^[^_]*_(?=[^_]*$)", "^[^_]*_[^_]*_"))
def report_scenarios(spark, sf_dir):
    file = F.get(F.array(*map(F.lit, _FILES)), (F.col("doc_id") % len(_FILES)).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", file.alias("file"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" "), "source", F.lit(" "))).alias("named"), F.when(F.col("doc_id") % 7 == 0, "yes").when(F.col("doc_id") % 7 == 1, "0").alias("refined"))
    found = rows.withColumn("scenario", report.scenario(F.col("file"), F.col("named")))
    return found.select("doc_id", "scenario", report.phase(F.col("scenario"), F.col("file"), F.col("refined")).alias("comparison_phase"))


def made_up_dashboard(spark, sf_dir):
    one = made_up_report(spark, sf_dir)
    return report.dashboard({"model_comparison": [("quora_full_bm25.csv", one), ("quora_full_tfidf.csv", one)], "runtime_comparison": [("runs/baseline.csv", one.withColumn("QPS", F.lit(" 12.5 ")))], "own_section": [("x.csv", one.where("false"))]})


@query(f"""{_REPORT}, f AS (SELECT * FROM (VALUES ('model_comparison', 'quora_full_bm25.csv', 'bm25_baseline', NULL::DOUBLE), ('model_comparison', 'quora_full_tfidf.csv', 'tfidf_baseline', NULL), ('runtime_comparison', 'runs/baseline.csv', 'baseline', 12.5)) v(section, source, scenario, qps))
SELECT section, f.source, dataset, model, scenario, 'before' AS comparison_phase, map, ndcg, qps FROM r, f""")
def dashboard_rows(spark, sf_dir):
    return made_up_dashboard(spark, sf_dir)[0].select("section", "source", "dataset", "model", "scenario", "comparison_phase", "map", "ndcg", "qps")


@query(f"""{_REPORT}, c AS (SELECT count(*) AS n FROM r) SELECT CAST(place AS INT) AS place, section, CAST(files AS INT) AS files, times * n AS n FROM (VALUES (0, 'model_comparison', 2, 2), (1, 'before_after_features', 0, 0), (2, 'query_refinement_before_after', 0, 0), (3, 'spelling_correction', 0, 0),
(4, 'runtime_comparison', 1, 1), (5, 'extra_features', 0, 0), (6, 'clustering_evaluation', 0, 0), (7, 'topic_detection_evaluation', 0, 0), (8, 'own_section', 1, 0)) v(place, section, files, times), c""")
def dashboard_sections(spark, sf_dir):
    return made_up_dashboard(spark, sf_dir)[1].select("place", "section", "files", "n")


@query("""SELECT doc_id, CASE WHEN v = '' THEN 'blank' WHEN regexp_full_match(v, '-?[0-9]+') THEN 'integer' WHEN regexp_full_match(v, '-?[0-9]+[.][0-9]+') THEN 'number' ELSE 'text' END AS kind, try_cast(nullif(v, '') AS DOUBLE) AS number, v AS text FROM
(SELECT doc_id, trim(CASE doc_id % 4 WHEN 0 THEN ' ' || doc_id WHEN 1 THEN doc_id || '.25 ' WHEN 2 THEN ' ' ELSE lang END) AS v FROM documents)""")
def coerced_fields(spark, sf_dir):
    """Fields of a CSV report: whole numbers, numbers with a point, blanks and words."""
    own = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 4
    value = F.when(kind == 0, F.concat(F.lit(" "), own)).when(kind == 1, F.concat(own, F.lit(".25 "))).when(kind == 2, " ").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", report.coerced(value).alias("c")).select("doc_id", "c.kind", "c.number", "c.text")
