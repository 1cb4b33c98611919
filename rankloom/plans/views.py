"""What a service shows of its data, as tables and plain values: data sets, documents, clusters, topics, evaluations, history.

Each function is what one route of a search service would answer; rows can be had as JSON by ``as_json``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import PROFILES
from rankloom.operators import report, rewrite
from rankloom.operators.checks import snapshot
from rankloom.plans.request import DATASETS, MODELS
from rankloom.plans.search import Corpus, Response
from rankloom.sources import files, store


def known(dataset: str) -> str:
    name = str(dataset or "").strip().lower()
    if name not in DATASETS:
        raise ValueError(f"unknown data set: {dataset}")
    return name


def datasets() -> list[dict]:
    """The data sets with their models and preprocessing; vectors of the medical model are for one only."""
    return [{"dataset": d, "models": [m for m in MODELS if m != "biomedical_embedding" or d == "clinical_trials"], "preprocessing": snapshot(PROFILES[d])} for d in DATASETS]


def document(corpus: Corpus, doc_id) -> dict | None:
    return store.get(corpus.docs, "doc_id", doc_id)


def results(response: Response) -> dict:
    """One answer as plain values: the query as asked and as searched, the model, the ranking, and of "rag" the answer and its sources."""
    rows = [r.asDict(recursive=True) for r in response.results.orderBy("rank").collect()]  # top_k rows
    out = {"query": response.request.query, "searched": response.query.first()["query"], "model": response.model, "count": len(rows), "results": rows}
    if response.answers is not None:
        out |= {k: v for k, v in response.answers.first().asDict().items() if k != "query_id"}
    if response.sources is not None:
        held = response.sources.first()
        out["sources"] = [s.asDict() for s in held["sources"]] if held else []
    return out


def as_json(rows: DataFrame) -> DataFrame:
    """(value): each row of text columns as JSON, with whole numbers, numbers and blanks told apart."""
    fields = []
    for c in rows.columns:
        x = report.coerced(F.col(f"`{c}`"))
        shown = F.when(x["kind"] == "integer", x["number"].cast("long").cast("string")).when(x["kind"] == "number", x["number"].cast("string")).otherwise(F.substring(F.to_json(F.struct(x["text"].alias("t"))), 6, 2**30))
        # the text's JSON ends with the closing brace of the object that it was put in
        text = F.when(x["kind"].isin("integer", "number"), shown).otherwise(F.regexp_replace(shown, r"\}$", ""))
        fields.append(F.concat(F.lit(json.dumps(c) + ": "), text))
    return rows.select(F.concat(F.lit("{"), F.array_join(F.array(*fields), ", "), F.lit("}")).alias("value"))


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a cluster summary report, as text."""
    return files.read_report(spark, path)


def topics(spark: SparkSession, path: str, most: int = 10) -> DataFrame:
    """The rows of a topic report, its column top_terms parsed into terms with weights."""
    return files.read_report(spark, path).withColumn("top_terms", report.top_terms(F.col("top_terms"), most))


def evaluation(spark: SparkSession, folder: str, manifest: dict[str, list[str] | str]) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(rows, sections, errors) of the reports that a manifest names by section; one that can't be read is an error and the others are shown."""
    sections, errors = {}, []
    for name, wanted in manifest.items():
        sections[name] = []
        for file in [wanted] if isinstance(wanted, str) else wanted:
            try:
                if ".." in file.split("/"):
                    raise ValueError("outside the folder")
                sections[name].append((file, files.read_report(spark, f"{folder.rstrip('/')}/{file}")))
            except Exception as e:  # noqa: BLE001 - shown beside the other reports
                errors.append({"section": name, "source": file, "error": str(e).splitlines()[0][:300]})
    rows, counts = report.dashboard(sections)
    return rows, counts, errors


def history(records: DataFrame, user: str, dataset: str, most: int = 20) -> DataFrame:
    """A user's newest queries of one data set."""
    return rewrite.recent_queries(records.where((F.col("user_id") == user) & (F.col("dataset") == known(dataset))), most)
