"""Tables that are computed once a session and kept as Parquet in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from rankloom.functions.text import PROFILES
from rankloom.operators.checks import signature_problems
from rankloom.operators.index import Index
from rankloom.sources.files import spread
from rankloom.sources.store import signature


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write df in the folder of spark.checkpoint.dir, in local mode in one of our own where that is unset, and read it back."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        base = f"file://{tempfile.gettempdir()}/rankloom-work"
    path = f"{base.rstrip('/')}/rankloom-{tag}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KNOWN: dict[tuple[str, str, str], list] = {}


def files_state(spark: SparkSession, path: str) -> tuple:
    """Number and bytes of the files of a table and when it was last changed; no data are read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = system.getContentSummary(at)
    return held.getFileCount(), held.getLength(), system.getFileStatus(at).getModificationTime()


def corpus_index(spark: SparkSession, sf_dir: str, dataset: str = "clinical_trials") -> Index:
    """The index of a folder's documents, made once an application, and anew when the corpus signature has changed.

    The signature is compared when the files have changed.
    """
    path = f"{sf_dir}/documents.parquet"
    at, state = (spark.sparkContext.applicationId, sf_dir, dataset), files_state(spark, path)
    docs = spark.read.parquet(path).select("doc_id", "text")
    known = _KNOWN.get(at)
    if known and (known[0] == state or not signature_problems(known[1], docs)):
        known[0] = state
        return known[2]
    profile = PROFILES[dataset]
    stored = signature(docs).first().asDict()
    _KNOWN[at] = [state, stored, Index.of_texts(spread(docs), profile, keep)]
    return _KNOWN[at][2]
