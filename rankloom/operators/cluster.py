"""Document clusters over vectors, their summaries and topic terms."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import Profile, repaired, tokens
from rankloom.operators.vectors import train_sample

# Words that say nothing about a topic in a clinical and in a question corpus.
CLINICAL_STOP = tuple(
    "able abnormal adult adults age aged also arm arms assess assessment available based care clinical clinically condition conditions "
    "consent control controlled current currently criteria data day days disease diseases dose doses drug eligible eligibility efficacy "
    "evaluate evaluation evidence excluded exclusion female follow group groups health history including inclusion intervention known male "
    "measure measures medical month months not objective objectives outcome outcomes participant participants patient patients phase placebo "
    "previous previously primary prior procedure receive received receiving recruiting related response safety secondary serious significant "
    "status study studies subject subjects therapy therapies treatment treatments trial trials use used using visit weeks willing with without "
    "written year years".split()
)
QUESTION_STOP = tuple(
    "best better compar compare difference differ doe does did good happen how like make mean not people peopl question quora thing things "
    "use way ways what when where which who why work".split()
)
#: Domain stop words by data set; others have none.
STOP = {"clinical_trials": CLINICAL_STOP, "quora": QUESTION_STOP}
#: Vectors that k-means is fitted on, at most.
SAMPLE = 100_000


def centres(vectors: DataFrame, k: int, seed: int = 13, max_iter: int = 100, sample: int = SAMPLE) -> DataFrame:
    """(cluster_id, centre) by k-means on at most ``sample`` vectors (doc_id, embedding): the first by a seeded hash of doc_id.

    Every vector is then assigned. The sample is the same however the table is parted.
    """
    part = train_sample(vectors, sample, seed)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="v").fit(part.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v")))
    return vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster_id int, centre array<double>")


def assigned(vectors: DataFrame, middle: DataFrame) -> DataFrame:
    """(doc_id, cluster_id, distance): the nearest of k centres, by squared distance, then cluster_id."""
    table = F.broadcast(middle.agg(F.collect_list(F.struct("cluster_id", "centre")).alias("cs")))  # k centres in one row
    each = F.transform("cs", lambda c: F.struct(F.round(F.aggregate(F.zip_with("embedding", c["centre"], lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x), 9).alias("distance"), c["cluster_id"].alias("cluster_id")))
    return vectors.crossJoin(table).select("doc_id", F.array_min(each).alias("m")).select("doc_id", "m.cluster_id", "m.distance")


def cluster_summary(members: DataFrame) -> DataFrame:
    """(cluster_id, n, percentage, representative): the representative is the nearest to the centre, then the smallest id."""
    total = F.broadcast(members.agg(F.count("*").alias("total")))
    rows = members.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min(F.struct("distance", "doc_id"))["doc_id"].alias("representative"))
    return rows.crossJoin(total).select("cluster_id", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percentage"), "representative")


def topic_terms(members: DataFrame, docs: DataFrame, profile: Profile, stop: tuple = CLINICAL_STOP, sample: int = 500, most: int = 10) -> DataFrame:
    """(cluster_id, term, n, rank): useful terms by the number of sampled texts of the cluster that hold them."""
    first = Window.partitionBy("cluster_id").orderBy("doc_id")
    part = members.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample).select("cluster_id", "doc_id")
    # the outer form, as Spark would cut each text twice to test a plain explode; the test of useful terms drops its nulls
    words = part.join(docs, "doc_id").select("cluster_id", "doc_id", F.explode_outer(F.array_distinct(tokens(repaired(F.col("text")), profile))).alias("term"))
    digits = F.length(F.regexp_replace("term", "[^0-9]", ""))
    useful = (F.length("term") >= 3) & (digits * 2 < F.length("term")) & ~F.col("term").isin(*stop)
    best = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "term")
    return words.where(useful).groupBy("cluster_id", "term").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def topic_labels(terms: DataFrame) -> DataFrame:
    """(cluster_id, label): the first five terms."""
    return terms.where("rank <= 5").groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("label"))


def topic_diversity(terms: DataFrame) -> DataFrame:
    return terms.agg(F.round(F.countDistinct("term") / F.count("*"), 6).alias("diversity"))


def topic_report(clusters: DataFrame, terms: DataFrame, members: DataFrame, most: int = 3) -> DataFrame:
    """(cluster_id, label, terms, examples): a cluster's topic as text, and its first documents by distance, then id."""
    words = terms.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("terms"))
    near = Window.partitionBy("cluster_id").orderBy("distance", "doc_id")
    first = members.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= most)
    examples = first.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("examples"))
    return clusters.select("cluster_id").join(topic_labels(terms), "cluster_id", "left").join(words, "cluster_id", "left").join(examples, "cluster_id", "left")


def members_of(assignments: DataFrame, cluster_id: int) -> DataFrame:
    """The documents of one cluster, nearest first; a table stored by cluster_id is pruned to it."""
    return assignments.where(F.col("cluster_id") == cluster_id).orderBy("distance", "doc_id")
