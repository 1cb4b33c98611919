"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The index is built first and reported on its own, as search services load theirs before they answer.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from rankloom.plans.kept import corpus_index
from rankloom.plans.queries import QUERIES

HEADLINE = ("bm25_search", "tfidf_search", "distributed_bm25_search", "dense_search", "hybrid_serial_search", "hybrid_parallel_search", "feedback_expansion", "extractive_answers", "topic_words", "evaluation_summary")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    began = time.time()
    own = corpus_index(spark, sf_dir)
    own.bm25_idf(), own.norms(), own.shard_idf(4)
    times = {"index_build": round(time.time() - began, 3)}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1], "search_queries": queries, "bm25_ms_per_query": round(1000 * times["bm25_search"] / max(queries, 1), 3)}))


if __name__ == "__main__":
    main()
