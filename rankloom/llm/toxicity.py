"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over all texts. Words that look disguised (leetspeak, letters set apart, letters
repeated) become lattices of the characters that they may stand for, and Viterbi decoding under the model restores
them, in time linear in their length and without a limit to it. Each masking sign may hide a letter, but LONGEST_MASK
equal ones or more are a rule or a gap and hide nothing. Letters set apart may be several words: a boundary may stand
at each gap. The restored words are scored by a list learned from labels: words and beginnings of words that occur in toxic
texts far beyond their share, each with its log odds. A word counts once a text, by its best entry; the sum, its share of
the words, the best entry and the text's length go into a logistic fit.

Labels are learned from rows whose crc32(doc_id as text) mod 5 is not 0, at most TRAIN_ROWS of them, chosen by a hash of
doc_id; lang, source and doc_id are never inputs. Every text is scored whole.

Defined edge cases: a null text counts as empty and gets the score of a text without listed words; null labels are not
learned from; without labels of both classes the score is next to 0 everywhere; a null doc_id has a null held_out; repeated
rows give equal scores; an empty table gives an empty result; further columns are not carried.
"""

from __future__ import annotations

import functools
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import held_out, map_slices, materialise
from rankloom.llm.quality import training_rows

TRAIN_ROWS = 8000
THRESHOLD = 0.5
#: Entries that the list holds, at most; in how many toxic texts each must occur, and in what share of them.
MOST_WORDS, LEAST_TEXTS, LEAST_SHARE = 5000, 3, 0.015
#: Beginnings of words that may be entries, marked by "^".
STEMS = (4, 5, 7)
#: The model's letters; all else is a boundary.
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáåçèéêëìíîïñòóôöõùúûüßœæø"
SIZE = len(LETTERS) + 1
#: What signs may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "<": "c", "¡": "i", "£": "l"}
_MASKS = frozenset("*#_?.-")
_EDGES = "\"'`´‘’“”„«».,;:?!()[]{}<>*#$%&@|+-_=~/\\"
#: Signs that stand for letters, digits left out.
_SIGNS = frozenset(c for c in LEET if not c.isdigit())
_PLAIN_EDGES = "".join(c for c in _EDGES if c not in LEET)
LONGEST_MASK = 5
#: Words up to this length are remembered once decoded.
REMEMBERED = 64
_PARTS = re.compile(r"[^\w@$!|+€*#?(<£¡-]+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!])(?:[ .*_\-]{1,3}(?:[^\W_]|[@$!])){3,}(?![^\W_])")
_GAP = re.compile(r"[ .*_\-]+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_RUNS = re.compile(r"([^*#_?.\-])\1{3,}")
_PLACE = {c: i + 1 for i, c in enumerate(LETTERS)} | {" ": 0}
_CODE = np.zeros(0x250, np.int64)
for _i, _c in enumerate(LETTERS):
    _CODE[ord(_c)] = _i + 1
    if len(_c.upper()) == 1 and ord(_c.upper()) < 0x250:
        _CODE[ord(_c.upper())] = _i + 1


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return np.where(points < 0x250, _CODE[np.minimum(points, 0x24F)], 0)


def trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of letter trigrams over all texts; each task sends at most SIZE**3 sums, and so does the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                joined = codes("  ".join(x for x in batch.column(0).slice(at, 64).to_pylist() if x))
                if len(joined) > 2:
                    total += np.bincount((joined[:-2] * SIZE + joined[1:-1]) * SIZE + joined[2:], minlength=SIZE**3)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["gram", "n"])

    sums = docs.select(text).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SIZE**3, np.int64)
    out[sums["gram"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(SIZE, SIZE, SIZE)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a letter after two others: the trigram's share, mixed with those of bigram and letter."""
    tri = counts.astype(np.float64)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    one = (uni + 1) / (uni.sum() + SIZE)
    two = (bi + 5 * one) / (bi.sum(axis=1, keepdims=True) + 5)
    return np.log((tri + 5 * two[None]) / (tri.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each place the letters (or nothing, "") that it may stand for, with the channel's log probability."""
    out, at = [], 0
    while at < len(word):
        c = word[at]
        run = at
        while run < len(word) and word[run] == c:
            run += 1
        n = run - at
        if c in LETTERS:
            out.append([(c, 0.0)])
            if n >= 2:
                out.append([(c, 0.0 if n == 2 else -0.7), ("", -3.0 if n == 2 else -0.7)])
        elif c in LEET:
            for k in range(min(n, 2)):
                out.append([(x, -0.2) for x in LEET[c]] + ([("", -0.7)] if k or n > 2 else [("", -6.0)]))
        elif c in _MASKS:
            hidden = [(x, -4.0) for x in LETTERS[:26]] if n < LONGEST_MASK else []
            out += [[("", -0.5), *hidden]] * (n if hidden else 1)
        else:
            out.append([("", -2.0)])
        at = run
    return out


def viterbi(places: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The likeliest letters through the lattice, from boundary to boundary; a " " within is a boundary too."""
    states, trail = {(0, 0): 0.0}, []
    for options in [*places, [(" ", 0.0)]]:
        new: dict = {}
        back: dict = {}
        for own, odds in states.items():
            a, b = own
            for letter, cost in options:
                if letter:
                    c = _PLACE[letter]
                    key, total = (b, c), odds + cost + float(model[a, b, c])
                else:
                    key, total = own, odds + cost
                if key not in new or total > new[key]:
                    new[key], back[key] = total, (own, letter)
        states = new
        trail.append(back)
    at, made = max(states, key=states.get), []
    for back in reversed(trail):
        at, letter = back[at]
        made.append(letter)
    return "".join(reversed(made)).strip()


class Restorer:
    """Restored words of texts under one model; decoded words are kept while there is room."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.known = functools.lru_cache(100_000)(lambda word: viterbi(lattice(word), model))

    def decode(self, word: str) -> str:
        word = _RUNS.sub(r"\1\1\1", word)  # the lattice of a longer run is the same
        return self.known(word) if len(word) <= REMEMBERED else viterbi(lattice(word), self.model)

    def apart(self, letters: list[str]) -> list[str]:
        """The words of letters set apart."""
        places = lattice(letters[0])
        for c in letters[1:]:
            places += [[("", 0.0), (" ", -1.0)], *lattice(c)]
        return viterbi(places, self.model).split()

    def words(self, text: str) -> set[str]:
        low = text.lower()
        out, odd = set(), set()
        for w in set(low.split()):
            part = w.strip(_PLAIN_EDGES)
            if part.isalpha():
                out.add(part)
                continue
            inner = part.strip(_EDGES)
            out.add(inner)
            odd.update(x for x in (part, inner) if len(x) >= 3 and not x.isalpha())
        for w in odd:
            parts = [p for p in _PARTS.split(w) if p]
            out.update(p for p in parts if p.isalpha())
            for p in parts:
                letters = sum(c.isalpha() for c in p)
                if letters < len(p) and 3 * letters >= len(p) and (letters >= 2 or not _SIGNS.isdisjoint(p)):
                    out.add(self.decode(p))
        if _TRIPLE.search(low):
            for w in [w for w in out if _TRIPLE.search(w)]:
                out.add(self.decode(w))
        for m in _SPACED.finditer(low):
            letters = _GAP.split(m[0])
            if 2 * sum(c.isalpha() for c in letters) >= len(letters):
                joined = "".join(letters)
                out.update((joined, self.decode(joined), *self.apart(letters)))
        out.discard("")
        return out


@dataclass
class Scorer:
    """listed: log odds of words and beginnings; weights: of the four inputs of ``inputs``, and the bias."""

    model: np.ndarray
    listed: dict[str, float]
    weights: np.ndarray

    def __post_init__(self):
        self.heads = frozenset(w.lstrip("^")[: min(STEMS)] for w in self.listed)

    def inputs(self, words: set[str], length: int) -> list[float]:
        """(sum of log odds, sum for each hundred words, best entry, log of length), the first three bounded."""
        listed, heads, first = self.listed, self.heads, min(STEMS)
        found = [max(listed.get(w, 0.0), *(listed.get("^" + w[:k], 0.0) for k in STEMS)) for w in words if w[:first] in heads]
        total = sum(found)
        return [min(total, 40.0), min(100 * total / max(length, 20), 40.0), max(found, default=0.0), float(np.log1p(length))]

    def scores(self, inputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs @ self.weights[:-1] + self.weights[-1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, pull: float = 0.5) -> np.ndarray:
    """Weights and bias by Newton steps, with a weak pull of the weights to zero."""
    wide = np.column_stack([x, np.ones(len(x))])
    weights, ridge = np.zeros(wide.shape[1]), np.diag([pull] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(wide @ weights, -30, 30)))
        step = np.linalg.solve((wide * (p * (1 - p) + 1e-9)[:, None]).T @ wide + ridge, wide.T @ (p - y) + ridge @ weights)
        weights -= step * min(1.0, 3 / max(np.abs(step).max(), 1e-9))
    return weights


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", most: int = TRAIN_ROWS) -> Scorer:
    spark = docs.sparkSession
    model = language_model(trigrams(docs))
    sent = spark.sparkContext.broadcast(model.tobytes())
    loaded: list[Restorer] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not loaded:
            loaded.append(Restorer(np.frombuffer(sent.value, np.float32).reshape(SIZE, SIZE, SIZE)))
        texts = [x or "" for x in batch.column(0).to_pylist()]
        found = [sorted(loaded[0].words(x)) for x in texts]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), pa.array([len(x.split()) for x in texts], pa.int32()), batch.column(1)], ["words", "length", "label"])

    # at most TRAIN_ROWS texts, which are cut into words once
    rows = materialise(map_slices(training_rows(docs, labels, column, most), ["text", "label"], "words array<string>, length int, label int", run), "toxic")
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    yes, no = totals.get(1, 0), totals.get(0, 0)
    if not yes or not no:
        return Scorer(model, {}, np.array([0.0] * 4 + [-30.0]))
    entries = F.array_distinct(F.flatten(F.array("words", *(F.transform("words", lambda w, k=k: F.concat(F.lit("^"), F.substring(w, 1, k))) for k in STEMS))))
    counts = rows.select("label", F.explode(entries).alias("word")).groupBy("word").agg(F.sum(F.col("label").cast("long")).alias("n1"), F.count("*").alias("n"))
    odds = F.log((F.col("n1") + 0.5) / (yes + 1)) - F.log((F.col("n") - F.col("n1") + 0.5) / (no + 1))
    share = F.col("n1") / F.col("n") - F.sqrt(F.col("n1") * (F.col("n") - F.col("n1")) / F.pow("n", F.lit(3)))
    least = max(LEAST_TEXTS, LEAST_SHARE * yes)
    best = counts.where(F.col("n1") >= least).withColumn("odds", odds).where((share >= 0.3) & (F.col("odds") > 1.5)).orderBy(F.desc("n1"), "word").limit(MOST_WORDS)
    scorer = Scorer(model, {r["word"]: float(r["odds"]) for r in best.select("word", "odds").collect()}, np.zeros(5))
    learned = spark.sparkContext.broadcast(pickle.dumps((scorer.listed, scorer.weights)))  # MOST_WORDS entries

    def gather(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = Scorer(None, *pickle.loads(learned.value))
        made = [own.inputs(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        return pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), batch.column(2)], ["x", "label"])

    table = map_slices(rows, ["words", "length", "label"], "x array<double>, label int", gather).toArrow()
    scorer.weights = logistic(np.array(table["x"].to_pylist()), table["label"].to_numpy().astype(np.float64))
    return scorer


def score(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(scorer))  # SIZE**3 numbers and MOST_WORDS words
    loaded: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not loaded:
            own = pickle.loads(sent.value)
            loaded.extend([own, Restorer(own.model)])
        own, restorer = loaded
        scores = own.scores(np.array([own.inputs(restorer.words(x), len(x.split())) for x in (x or "" for x in batch.column(1).to_pylist())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(held_out(batch.column(0).to_pylist()), pa.bool_()), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [key, "held_out", "score", "predicted"])

    return map_slices(docs, [key, text], f"{key} {dict(docs.dtypes)[key]}, held_out boolean, score double, predicted int", run)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
