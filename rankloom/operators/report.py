"""Reports of evaluation runs: metric columns under any of their names, the best model, runs before and after a change."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain_name(name: str) -> str:
    """Lower-case ASCII letters and digits of a column's name: "Recall@1000" is recall1000."""
    return re.sub(r"[^a-z0-9]+", "", name.strip().lower())


def number(value: Column) -> Column:
    """A double, or null for blanks, words, booleans and values that are no finite number."""
    read = value.cast("string").try_cast("double")
    return F.when(~F.isnan(read) & (F.abs(read) != float("inf")), read)


def metric(df: DataFrame, names: list[str], prefixes: list[str] = ()) -> Column:
    """The first number of a row under the given names, in their order, then under columns that start with a prefix.

    A name that several columns share once reduced means the last of them. Null where no column holds a number.
    """
    by_name = {plain_name(c): c for c in df.columns}
    exact = [by_name[plain_name(n)] for n in names if plain_name(n) in by_name]
    near = [c for n, c in by_name.items() if any(n.startswith(plain_name(p)) for p in prefixes)]
    found = [number(F.col(f"`{c}`")) for c in dict.fromkeys(exact + near)]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def normalised(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, map, precision, recall, ndcg) of a report whose metric columns may be named in several ways; absent keys are null."""
    by_name = {plain_name(c): c for c in df.columns}
    held = [(F.col(f"`{by_name[plain_name(k)]}`") if plain_name(k) in by_name else F.lit(None)).cast("string").alias(k) for k in keys]
    return df.select(
        *held,
        metric(df, ["map", "mean_average_precision"], ["map"]).alias("map"),
        metric(df, ["precision", "p@10", "precision_at_10"], ["precision"]).alias("precision"),
        metric(df, ["recall", "r@1000", "recall_at_depth"], ["recall"]).alias("recall"),
        metric(df, ["ndcg", "ndcg@10"], ["ndcg"]).alias("ndcg"),
    )


def best_models(report: DataFrame) -> DataFrame:
    """(dataset, model, map): the highest map of each data set, ties to the smaller name; rows without a map don't count."""
    best = F.max(F.struct(F.col("map"))).alias("top")
    tops = report.where(F.col("map").isNotNull()).groupBy("dataset").agg(best)
    return report.join(tops.select("dataset", F.col("top.map").alias("map")), ["dataset", "map"]).groupBy("dataset", "map").agg(F.min("model").alias("model")).select("dataset", "model", "map")


def before_after(before: DataFrame, after: DataFrame, keys: list[str], metrics: tuple = ("map", "precision", "recall", "ndcg")) -> DataFrame:
    """(keys, metric, before, after, change): a row for each metric; a run that only one side holds keeps a null on the other."""
    def long(df: DataFrame, side: str) -> DataFrame:
        return df.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(side)) for m in metrics))).alias("m")).select(*keys, "m.*")

    both = long(before, "before").join(long(after, "after"), [*keys, "metric"], "full")
    return both.withColumn("change", F.round(F.col("after") - F.col("before"), 6))


# What a part of a report's file name says of its scenario, in the order in which they are tried.
SCENARIOS = (
    ("bm25_refinement_improved", "after_refinement_improved"), ("bm25_refinement", "after_refinement"), ("bm25_baseline", "before_refinement"),
    ("full_bm25", "bm25_baseline"), ("full_tfidf", "tfidf_baseline"), ("distributed_bm25", "distributed"), ("hybrid_parallel_batch", "hybrid_parallel_batch"),
    ("biomedical", "biomedical"), ("ltr", "learning_to_rank"), ("baseline", "baseline"), ("refinement", "after_refinement"),
)
# Scenarios before and after a change.
BEFORE = ("before_refinement", "bm25_baseline", "tfidf_baseline", "baseline", "clean_queries", "misspelled_without_correction", "central_bm25", "best_non_ltr_baseline")
AFTER = ("after_refinement", "after_refinement_improved", "misspelled_with_correction", "distributed_bm25", "biomedical_embedding", "hybrid_parallel_biomedical", "learning_to_rank")
# Sections of the dashboard, in order.
SECTIONS = ("model_comparison", "before_after_features", "query_refinement_before_after", "spelling_correction", "runtime_comparison", "extra_features", "clustering_evaluation", "topic_detection_evaluation")


def filled(value: Column) -> Column:
    """The trimmed text, or null where it is blank."""
    text = F.trim(value.cast("string"))
    return F.when(text != "", text)


def flag(value: Column) -> Column:
    """A boolean of a text such as "yes" or "0", else null."""
    text = F.lower(filled(value))
    return F.when(text.isin("true", "1", "yes", "y", "on"), True).when(text.isin("false", "0", "no", "n", "off"), False)


def scenario(file: Column, *explicit: Column) -> Column:
    """The first filled of the explicit columns, else what the file's name without its ending says, else the name after its second "_"."""
    stem = F.regexp_replace(F.lower(F.element_at(F.split(file, "/"), -1)), r"\.[^.]*$", "")
    rule = F.coalesce(*(F.when(F.contains(stem, F.lit(part)), F.lit(name)) for part, name in SCENARIOS), F.element_at(F.split(stem, "_", 3), -1))
    return F.coalesce(*map(filled, explicit), rule)


def phase(scenario_name: Column, file: Column, refinement: Column | None = None, explicit: Column | None = None) -> Column:
    """"before", "after" or null: as stated, by the refinement flag, by the scenario, by the file's name."""
    name = F.lower(F.element_at(F.split(file, "/"), -1))
    on = flag(refinement) if refinement is not None else F.lit(None).cast("boolean")
    by_file = F.when(F.contains(name, F.lit("refinement")) | F.contains(name, F.lit("_prf_")) | name.startswith("prf_"), "after").when(F.contains(name, F.lit("baseline")) | F.contains(name, F.lit("full_bm25")), "before")
    by_rule = F.when(on, "after").when(~on, "before").when(scenario_name.isin(*BEFORE), "before").when(scenario_name.isin(*AFTER), "after").otherwise(by_file)
    return F.coalesce(filled(explicit), by_rule) if explicit is not None else by_rule


def report_rows(df: DataFrame, section: str, file: Column) -> DataFrame:
    """Rows of one CSV report in the form of all: section, source, data set, model, scenario, phase, metrics, times, status."""
    by_name = {plain_name(c): c for c in df.columns}
    held = lambda *names: [F.col(f"`{by_name[plain_name(n)]}`") for n in names if plain_name(n) in by_name]
    text = lambda *names: F.coalesce(*map(filled, held(*names)), F.lit(None).cast("string"))
    named = df.withColumn("_scenario", scenario(file, *held("scenario", "run_name", "run", "name")))
    refinement = held("use_query_refinement", "query_refinement", "refinement")
    return named.select(
        F.lit(section).alias("section"),
        file.alias("source"),
        text("dataset").alias("dataset"),
        text("model").alias("model"),
        F.col("_scenario").alias("scenario"),
        phase(F.col("_scenario"), file, F.coalesce(*map(filled, refinement)) if refinement else None, text("comparison_phase", "phase")).alias("comparison_phase"),
        text("status").alias("status"),
        metric(df, ["map", "mean_average_precision"], ["map"]).alias("map"),
        metric(df, ["precision", "p@10", "precision_at_10"], ["precision"]).alias("precision"),
        metric(df, ["recall", "r@1000", "recall_at_depth"], ["recall"]).alias("recall"),
        metric(df, ["ndcg", "ndcg@10"], ["ndcg"]).alias("ndcg"),
        metric(df, ["wall_seconds", "total_seconds"], ["wall"]).alias("wall_seconds"),
        metric(df, ["ms_per_query", "average_ms_per_query"], ["ms"]).alias("ms_per_query"),
        metric(df, ["qps", "queries_per_second"], ["qps"]).alias("qps"),
    )


def dashboard(sections: dict[str, list[tuple[str, DataFrame]]]) -> tuple[DataFrame, DataFrame]:
    """(rows, sections): reports (file, table) by section as one table, and a row for each section with its counts.

    Sections without reports are there with 0 rows; the known ones come first, in their order.
    """
    parts = [report_rows(df, name, F.lit(file)) for name, files in sections.items() for file, df in files]
    if not parts:
        raise ValueError("no reports")
    rows = reduce(DataFrame.unionByName, parts)
    order = list(dict.fromkeys((*SECTIONS, *sections)))
    names = rows.sparkSession.createDataFrame([(i, x, len(sections.get(x, ()))) for i, x in enumerate(order)], "place int, section string, files int")
    counts = rows.groupBy("section").agg(F.count("*").alias("n"))
    return rows, names.join(counts, "section", "left").select("place", "section", F.initcap(F.translate("section", "_", " ")).alias("label"), "files", F.coalesce("n", F.lit(0)).alias("n"))


def top_terms(value: Column, most: int = 10) -> Column:
    """Terms with weights of a text: a JSON list, or terms parted by blanks and , ; | each perhaps with ":weight".

    Without any weight above 0 they get (n - i) / n by their place i of n, to 4 places.
    """
    text = F.trim(F.coalesce(value, F.lit("")))
    rows = F.from_json(text, "array<struct<term: string, weight: string>>")
    words = F.from_json(text, "array<string>")
    weight = lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))
    kind = "array<struct<term: string, weight: double>>"
    of_rows = F.transform(rows, lambda x: F.struct(F.trim(x["term"]).alias("term"), weight(x["weight"]).alias("weight"))).cast(kind)
    of_words = F.transform(words, lambda x: F.struct(F.trim(x).alias("term"), F.lit(0.0).alias("weight"))).cast(kind)
    number = lambda x: F.regexp_extract(x, ":([^:]*)$", 1).try_cast("double")
    stated = lambda x: F.coalesce(number(x) >= 0, F.lit(False))
    plain = F.transform(F.split(text, r"[\s,;|]+"), lambda x: F.struct(F.when(stated(x), F.regexp_replace(x, ":[^:]*$", "")).otherwise(x).alias("term"), F.when(stated(x), number(x)).otherwise(0.0).alias("weight"))).cast(kind)
    found = F.when(text.startswith("[") & F.exists(of_rows, lambda x: x["term"] != ""), of_rows).when(text.startswith("[") & words.isNotNull(), of_words).otherwise(plain)
    kept = F.slice(F.filter(found, lambda x: x["term"] != ""), 1, most)
    n = F.size(kept)
    placed = F.transform(kept, lambda x, i: F.struct(x["term"].alias("term"), F.round((n - i) / n, 4).alias("weight"))).cast(kind)
    return F.when(F.exists(kept, lambda x: x["weight"] > 0), kept).otherwise(placed)


def cluster_topics(clusters: DataFrame, topics: DataFrame) -> DataFrame:
    """Clusters (cluster_id, n, percentage, representative) with their topic (cluster_id, label, terms, examples).

    A cluster without a topic, or a topic without examples, falls back on the representative.
    """
    joined = clusters.join(topics, "cluster_id", "left")
    return joined.select("cluster_id", F.coalesce("label", F.lit("")).alias("label"), F.col("n").alias("size"), "percentage", F.coalesce("terms", F.lit("")).alias("top_terms"), F.coalesce(filled(F.col("examples")), F.col("representative").cast("string")).alias("examples"))


def coerced(value: Column) -> Column:
    """A CSV field as (kind, number, text): a whole number, a number with a point, blank, or text."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    whole, real = text.try_cast("long"), number(text)
    kind = F.when(text == "", "blank").when(~F.contains(text, F.lit(".")) & whole.isNotNull(), "integer").when(F.contains(text, F.lit(".")) & real.isNotNull(), "number").otherwise("text")
    return F.struct(kind.alias("kind"), F.when(kind.isin("integer", "number"), real).alias("number"), text.alias("text"))
