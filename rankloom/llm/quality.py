"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of features x is sigmoid(w0 + sum w x + 1/2 sum_f ((sum v_f x)^2 - sum (v_f x)^2)): all pairwise interactions
in time linear in the number of features. Words are hashed into BUCKETS (value 1 + log of their count, all scaled to
length one); each structure statistic and the text's length fall into one of BINS ranges cut at training quantiles.

Labels are learned from rows whose crc32(doc_id as text) mod 5 is not 0, at most TRAIN_ROWS of them, chosen by a hash
of doc_id; lang, source and doc_id are never inputs. Every text is scored whole.

Defined edge cases: a null text counts as empty and gets a score; null labels are not learned from; labels of one class
only, or none, give the score 0.5 (no label), 0.99 or 0.01 (one class) everywhere; a null doc_id has a null held_out;
repeated rows give equal scores; an empty table gives an empty result; further columns are not carried.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import held_out, map_slices, train_row

BUCKETS = 1 << 14
BINS = 12
RANK = 6
EPOCHS = 8
TRAIN_ROWS = 8000
THRESHOLD = 0.3
SEED = 7
#: Features that are scored at once.
FLUSH = 200_000
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\n\v\f", "line": b"\n", "stop": b".", "comma": b",", "bang": b"!?", "bar": b"|", "sign": b"#$%&*@^~_=+<>{}[]\\/"}
_SETS = [np.frombuffer(x, np.uint8) for x in _CLASSES.values()]
STATS = 8 + len(_CLASSES)


def statistics(text: str, raw: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """What the text looks like, whatever its words: lengths, repetition, and shares of kinds of bytes."""
    n, size = len(words), max(len(raw), 1)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    top = counts.most_common(1)[0][1] if n else 0
    twice = sum(a == b for a, b in zip(words, words[1:]))
    letters = seen[65:91].sum() + seen[97:123].sum() + seen[128:].sum()
    return [np.log1p(len(text)), np.log1p(n), len(raw) / max(n, 1), len(counts) / max(n, 1), top / max(n, 1), twice / max(n, 1), letters / size, seen[128:].sum() / size, *(float(seen[s].sum() / size) for s in _SETS)]


def features(text: str) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(word buckets, their values, statistics)."""
    raw = text.encode()
    words = raw.split()
    counts = Counter(words)
    index = np.fromiter((zlib.crc32(w) & (BUCKETS - 1) for w in counts), np.int32, len(counts))
    value = 1 + np.log(np.fromiter(counts.values(), np.float32, len(counts)))
    return index, (value / max(np.sqrt((value * value).sum()), 1e-9)).astype(np.float32), statistics(text, raw, words, counts)


@dataclass
class Machine:
    """cuts: (STATS, BINS - 1) bounds; w0, w, v: the machine's parameters."""

    cuts: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def flat(self, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, value, where each row starts) of rows of ``features``."""
        stats = np.array([r[2] for r in rows], np.float64).reshape(len(rows), STATS)
        slot = np.stack([np.searchsorted(c, stats[:, k]) for k, c in enumerate(self.cuts)], axis=1)
        own = BUCKETS + np.arange(STATS) * BINS + slot
        index = np.concatenate([np.concatenate([own[i], r[0]]) for i, r in enumerate(rows)])
        share = np.full(STATS, STATS**-0.5, np.float32)
        value = np.concatenate([np.concatenate([share, r[1]]) for r in rows])
        lengths = np.array([STATS + len(r[0]) for r in rows])
        return index.astype(np.int64), value, np.cumsum(lengths) - lengths

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log odds, sums of v x) by the sum-of-squares identity."""
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.w0 + np.add.reduceat(self.w[index] * value, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, rows: list[tuple]) -> np.ndarray:
        out, part, size = [], [], 0
        for i, r in enumerate(rows):
            part.append(r)
            size += STATS + len(r[0])
            if size >= FLUSH or i == len(rows) - 1:
                out.append(self.raw(*self.flat(part))[0])
                part, size = [], 0
        odds = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30).astype(np.float64)))


def fit(rows: list[tuple], labels: np.ndarray, epochs: int = EPOCHS, rank: int = RANK, rate: float = 0.15, decay: float = 1e-5, seed: int = SEED) -> Machine:
    """Adagrad over mini-batches, with one pass's parameters kept in float32."""
    stats = np.array([r[2] for r in rows], np.float64).reshape(len(rows), STATS)
    cuts = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(rows) else np.zeros((STATS, BINS - 1))
    total = BUCKETS + STATS * BINS
    rng = np.random.default_rng(seed)
    own = Machine(cuts, 0.0, np.zeros(total, np.float32), rng.normal(0, 0.05, (total, rank)).astype(np.float32))
    share = labels.mean() if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        own.v[:] = 0
        own.w0 = float(np.log(0.5 / 0.5) if not len(labels) else np.log(0.99 / 0.01) * (1 if share else -1))
        return own
    own.w0 = float(np.log(share / (1 - share)))
    gw, gv, g0 = np.full(total, 1e-6, np.float32), np.full((total, rank), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            pick = order[at : at + 128]
            index, value, starts = own.flat([rows[i] for i in pick])
            odds, sums = own.raw(index, value, starts)
            slope = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels[pick]) / len(pick)
            each = np.repeat(np.arange(len(pick)), np.diff(np.append(starts, len(index))))
            step = (slope[each] * value).astype(np.float32)
            keys, where = np.unique(index, return_inverse=True)
            dw = np.bincount(where, step, len(keys)) + decay * own.w[keys]
            part = step[:, None] * (sums[each] - own.v[index] * value[:, None])
            dv = np.stack([np.bincount(where, part[:, f], len(keys)) for f in range(rank)], axis=1) + decay * own.v[keys]
            gw[keys] += dw * dw
            gv[keys] += dv * dv
            g0 += float(slope.sum()) ** 2
            own.w[keys] -= rate * dw / np.sqrt(gw[keys])
            own.v[keys] -= 0.3 * rate * dv / np.sqrt(gv[keys])
            own.w0 -= rate * float(slope.sum()) / np.sqrt(g0)
    return own


def training_rows(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """(text, label) of at most so many labelled rows that may be learned from, the first by a hash of doc_id."""
    chosen = labels.where(F.col(column).isNotNull() & train_row("doc_id")).select("doc_id", F.col(column).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "label").limit(most)
    # at most ``most`` rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = TRAIN_ROWS) -> Machine:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [features(x or "") for x in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32())), pa.array([m[2] for m in made], pa.list_(pa.float64())), batch.column(1)], ["i", "x", "s", "label"])

    table = map_slices(training_rows(docs, labels, column, most), ["text", "label"], "i array<int>, x array<float>, s array<double>, label int", run).toArrow()
    rows = [(np.asarray(i.values, np.int32), np.asarray(x.values, np.float32), s.as_py()) for i, x, s in zip(table["i"], table["x"], table["s"])]
    return fit(rows, table["label"].to_numpy().astype(np.float64))


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(machine))  # about BUCKETS x RANK numbers
    loaded: list[Machine] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not loaded:
            loaded.append(pickle.loads(sent.value))
        scores = loaded[0].score([features(x or "") for x in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(held_out(batch.column(0).to_pylist()), pa.bool_()), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [key, "held_out", "score", "predicted"])

    return map_slices(docs, [key, text], f"{key} {dict(docs.dtypes)[key]}, held_out boolean, score double, predicted int", run)


def keep_good(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns, whose text the machine accepts."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(machine))
    loaded: list[Machine] = []
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not loaded:
            loaded.append(pickle.loads(sent.value))
        return batch.filter(pa.array(loaded[0].score([features(x or "") for x in batch.column(at).to_pylist()]) >= threshold))

    return map_slices(docs, docs.columns, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes), run)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
