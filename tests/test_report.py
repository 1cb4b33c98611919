from datetime import datetime

from rankloom.operators import report
from rankloom.streaming import history


def test_metrics_under_other_names(spark):
    rows = spark.createDataFrame([("quora", "0.5", "", "true", "0.9"), ("quora", "n/a", "0.25", None, "nan")], "Data_Set string, `MAP` string, `map (mean)` string, recall string, `Recall@1000` string")
    got = [tuple(r) for r in report.normalised(rows, ["dataset", "model"]).collect()]
    assert got == [("quora", None, 0.5, None, 0.9, None), ("quora", None, 0.25, None, None, None)]


def test_best_models_and_ties(spark):
    rows = spark.createDataFrame([("q", "b", 0.5), ("q", "a", 0.5), ("q", "c", 0.1), ("z", "x", None)], "dataset string, model string, map double")
    assert [tuple(r) for r in report.best_models(rows).collect()] == [("q", "a", 0.5)]


def test_before_after(spark):
    make = lambda rows: spark.createDataFrame(rows, "model string, map double")
    got = {tuple(r) for r in report.before_after(make([("bm25", 0.25), ("old", 0.1)]), make([("bm25", 0.5)]), ["model"], ("map",)).collect()}
    assert got == {("bm25", "map", 0.25, 0.5, 0.25), ("old", "map", 0.1, None, None)}


def test_history_stream_appends_once(spark, tmp_path):
    rows = [("u", "quora", " how ", datetime(2024, 1, 1, 10, 5)), (" ", "quora", "x", datetime(2024, 1, 1, 10, 6)), ("u", None, "x", datetime(2024, 1, 1, 10, 7)), ("v", "quora", "why", datetime(2024, 1, 1, 11, 0))]
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    table = spark.createDataFrame(rows, history.SCHEMA)
    table.write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        history.append_history(spark.readStream.schema(history.SCHEMA).parquet(source), sink, mark).awaitTermination(60)
    assert sorted((r["user_id"], r["query"]) for r in spark.read.parquet(sink).collect()) == [("u", "how"), ("v", "why")]
    assert sorted((r["start"].hour, r["n"]) for r in history.query_counts(table).collect()) == [(10, 1), (11, 1)]
