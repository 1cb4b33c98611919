"""Evaluation suites: cases by section, each a ranking of all queries in one plan, measured, timed and reported as a row."""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import metrics, rewrite
from rankloom.plans.kept import keep
from rankloom.plans.request import MODELS, SearchRequest
from rankloom.plans.search import Corpus, ranked, rewritten
from rankloom.sources.files import read_qrels, read_queries, write_report

#: Models of the baseline section.
BASELINES = ("tfidf", "bm25", "embedding", "hybrid_serial", "hybrid_parallel")
NO_HELD_OUT = "all judged queries were evaluated, as the model's metadata name no held-out ones"


@dataclass(frozen=True)
class Case:
    """One row of a suite; ``only`` are ids of the queries to evaluate, all judged ones if None."""

    dataset: str
    model: str
    scenario: str
    section: str
    feature_group: str
    comparison_phase: str | None = None
    use_query_refinement: bool = False
    use_spelling_correction: bool = False
    misspelled_queries: bool = False
    biomedical_weight: float = 0.0
    only: tuple | None = None
    warning: str = ""

    @property
    def run_name(self) -> str:
        return f"{self.dataset}_{self.scenario}" if self.model in self.scenario else f"{self.dataset}_{self.model}_{self.scenario}"


@dataclass(frozen=True)
class Settings:
    depth: int = 1000
    precision_k: int = 10
    ndcg_k: int = 10
    candidate_count: int = 1000
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    rrf_k: int = 60
    num_shards: int | None = None
    shard_top_k: int | None = None
    feedback_docs: int = 3
    expansion_terms: int = 5


def cases(datasets: Iterable[str], ltr: bool = False, medical_weight: float = 1.0) -> list[Case]:
    """All sections: baselines, refinement, spelling, features before and after, runtime; learning to rank where a model is."""
    out = []
    for d in datasets:
        out += [Case(d, m, f"{m}_baseline", "model_comparison", "baseline_representation") for m in BASELINES]
        out += [
            Case(d, "bm25", "before_refinement", "query_refinement_before_after", "query_refinement", "before"),
            Case(d, "bm25", "after_refinement", "query_refinement_before_after", "query_refinement", "after", use_query_refinement=True),
            Case(d, "bm25", "clean_queries", "spelling_correction", "spelling_correction", "before"),
            Case(d, "bm25", "misspelled_without_correction", "spelling_correction", "spelling_correction", "before", misspelled_queries=True),
            Case(d, "bm25", "misspelled_with_correction", "spelling_correction", "spelling_correction", "after", misspelled_queries=True, use_spelling_correction=True),
            Case(d, "bm25", "central_bm25", "before_after_features", "distributed_bm25", "before"),
            Case(d, "distributed_bm25", "distributed_bm25", "before_after_features", "distributed_bm25", "after"),
            *(Case(d, m, f"{m}_runtime", "runtime_comparison", "runtime") for m in ("bm25", "distributed_bm25", "hybrid_serial", "hybrid_parallel")),
        ]
        if d == "clinical_trials":
            out += [
                Case(d, "bm25", "clinical_bm25_baseline", "before_after_features", "biomedical_retrieval", "before"),
                Case(d, "biomedical_embedding", "biomedical_embedding", "before_after_features", "biomedical_retrieval", "after"),
                Case(d, "hybrid_parallel", "hybrid_parallel_biomedical", "before_after_features", "biomedical_retrieval", "after", biomedical_weight=medical_weight),
            ]
        if ltr:
            out.append(Case(d, "ltr", "learning_to_rank", "extra_features", "learning_to_rank", "after"))
    return out


def held_out(case: Case, metadata: dict | None) -> Case:
    """The case on the held-out queries that a model's metadata name; on all, with a warning, if they name none."""
    names = (metadata or {}).get("held_out_query_ids") or (metadata or {}).get("validation_query_ids") or []
    only = tuple(dict.fromkeys(x for x in names if str(x).strip())) if isinstance(names, list) else ()
    return replace(case, only=only or None, warning="" if only else NO_HELD_OUT)


def request(case: Case, own: Settings) -> SearchRequest:
    return SearchRequest(
        "all", case.dataset, case.model, candidate_count=max(own.candidate_count, own.depth) if case.model.startswith("hybrid") else own.candidate_count, top_k=min(own.depth, 1000), bm25_k1=own.bm25_k1,
        bm25_b=own.bm25_b, rrf_k=own.rrf_k, num_shards=own.num_shards, shard_top_k=own.shard_top_k, biomedical_weight=case.biomedical_weight,
        use_query_refinement=case.use_query_refinement, use_spelling_correction=case.use_spelling_correction, feedback_docs=own.feedback_docs, expansion_terms=own.expansion_terms,
    )


def measured(corpus: Corpus, queries: DataFrame, qrels: DataFrame, case: Case, own: Settings) -> dict:
    """Metrics and times of a case. Queries are rewritten and stored before the clock starts, and rankings stored before it stops."""
    asked, judged = metrics.guarded(queries, qrels, case.only)
    if case.misspelled_queries:
        asked = asked.select("query_id", rewrite.misspelled(F.col("query")).alias("query"))
    r = request(case, own)
    ready = keep(rewritten(corpus, r, asked.select("query_id", "query"))[0], "asked")
    n = ready.count()
    began = time.perf_counter()
    ranking = keep(metrics.distinct_results(ranked(corpus, r, ready, case.model, own.depth).select("query_id", "doc_id", "rank")), "ranking")
    seconds = time.perf_counter() - began
    row = metrics.summary(metrics.per_query(ranking, judged, own.precision_k, own.depth, own.ndcg_k)).first().asDict()
    return row | {"wall_seconds": round(seconds, 6), "ms_per_query": round(1000 * seconds / max(n, 1), 6), "qps": round(n / max(seconds, 1e-9), 6)}


ROW = (
    "section string, run_name string, dataset string, model string, scenario string, feature_group string, comparison_phase string, status string, error string, warning string, "
    "queries long, map double, precision double, recall double, ndcg double, wall_seconds double, ms_per_query double, qps double, use_query_refinement boolean, use_spelling_correction boolean, misspelled_queries boolean"
)


def evaluate(spark: SparkSession, data: dict[str, tuple[Corpus, DataFrame, DataFrame]], wanted: Iterable[Case], own: Settings = Settings(), metadata: dict[str, dict] | None = None, run: Callable = measured) -> DataFrame:
    """A row for each case; equal cases of several sections are measured once, and one that fails is a row with its error.

    data: (corpus, queries, judgements) by data set; metadata: of the trained models, by data set.
    """
    known: dict = {}
    rows = []
    for case in wanted:
        if case.model == "ltr":
            case = held_out(case, (metadata or {}).get(case.dataset))
        key = replace(case, scenario="", section="", feature_group="", comparison_phase=None, warning="")
        if key not in known:
            try:
                if case.dataset not in data:
                    raise ValueError(f"no data for {case.dataset}")
                if case.model == "ltr" and data[case.dataset][0].model is None:
                    known[key] = {"status": "skipped", "error": "no trained model"}
                else:
                    known[key] = run(*data[case.dataset], case, own) | {"status": "completed", "error": ""}
            except Exception as e:  # noqa: BLE001 - the error is the row's result
                known[key] = {"status": "failed", "error": str(e).splitlines()[0][:500]}
        own_row = asdict(case) | {"run_name": case.run_name} | known[key]
        rows.append(tuple(own_row.get(f.split()[0]) for f in ROW.split(", ")))
    return spark.createDataFrame(rows, ROW)


def compared(report: DataFrame) -> DataFrame:
    """(dataset, feature_group, metric, before, after, change) of the rows that say which phase they are of."""
    held = report.where("status = 'completed' and comparison_phase is not null")
    long = held.select("dataset", "feature_group", "comparison_phase", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("map", "precision", "recall", "ndcg")))).alias("x")).select("dataset", "feature_group", "comparison_phase", "x.*")
    sides = long.groupBy("dataset", "feature_group", "metric").agg(F.max(F.when(F.col("comparison_phase") == "before", F.col("value"))).alias("before"), F.max(F.when(F.col("comparison_phase") == "after", F.col("value"))).alias("after"))
    return sides.withColumn("change", F.round(F.col("after") - F.col("before"), 6))


def single_against_batch(corpus: Corpus, queries: DataFrame, own: SearchRequest, most: int = 5) -> dict:
    """Wall seconds of ``most`` queries asked one by one and all at once, the ratio, and whether both gave as many rows."""
    some = queries.orderBy("query_id").limit(most).collect()
    one, counts = 0.0, []
    spark = queries.sparkSession
    for r in some:
        began = time.perf_counter()
        counts.append(ranked(corpus, own, spark.createDataFrame([tuple(r)], queries.schema), own.model, own.top_k).count())
        one += time.perf_counter() - began
    began = time.perf_counter()
    total = ranked(corpus, own, spark.createDataFrame([tuple(r) for r in some], queries.schema), own.model, own.top_k).count()
    batch = time.perf_counter() - began
    return {"queries": len(some), "single_seconds": one, "batch_seconds": batch, "speed_up": one / max(batch, 1e-9), "same_counts": sum(counts) == total}


def main(arguments: list[str] | None = None, corpus: Callable[[SparkSession, str, str], Corpus] | None = None) -> DataFrame:
    """Command line: a grid of data sets and models over files of queries and judgements, written as one CSV report.

    ``corpus`` gives the corpus of a data set from its folder; the default builds the lexical indexes of documents.parquet.
    """
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("folder", help="a folder with <dataset>/documents.parquet, queries.tsv and qrels.tsv")
    p.add_argument("--datasets", nargs="+", required=True)
    p.add_argument("--models", nargs="+", default=["bm25"], choices=[m for m in MODELS if m not in ("rag", "agent")])
    p.add_argument("--depth", type=int, default=1000)
    p.add_argument("--precision-k", type=int, default=10)
    p.add_argument("--refinement", action="store_true")
    p.add_argument("--spelling", action="store_true")
    p.add_argument("--suite", action="store_true", help="all sections in place of the grid")
    p.add_argument("--metadata", help="a JSON file: metadata of trained models by data set")
    p.add_argument("--out")
    a = p.parse_args(arguments)
    if not 1 <= a.precision_k <= a.depth:
        p.error("precision-k is to be from 1 to the depth")
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    data = {}
    for d in a.datasets:
        base = f"{a.folder.rstrip('/')}/{d}"
        data[d] = (corpus or lexical)(spark, base, d), read_queries(spark, f"{base}/queries.tsv"), read_qrels(spark, f"{base}/qrels.tsv").select("query_id", "doc_id", "relevance")
    grid = [Case(d, m, f"{m}_grid", "model_comparison", "grid", use_query_refinement=a.refinement, use_spelling_correction=a.spelling) for d in a.datasets for m in a.models]
    metadata = json.loads("\n".join(r[0] for r in spark.read.text(a.metadata).collect())) if a.metadata else None
    report = evaluate(spark, data, cases(a.datasets) if a.suite else grid, Settings(depth=a.depth, precision_k=a.precision_k), metadata)
    if a.out:
        write_report(report.coalesce(1), a.out)  # a row for each case
    return report


def lexical(spark: SparkSession, folder: str, dataset: str) -> Corpus:
    """A corpus with lexical models and a spelling vocabulary."""
    from rankloom.plans.kept import corpus_index

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return Corpus(dataset, docs, corpus_index(spark, folder, dataset), words=rewrite.surface_vocabulary(docs))


if __name__ == "__main__":
    main()
