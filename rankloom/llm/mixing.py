"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sizes are words. Sources share a budget by weight; a source's target stops at a multiple of its size, and what is over
is shared again by weight. Whole blocks then go to sources, and within a source to its shards, by the highest quotients
votes / (2 seats + 1). A shard turns its integer quota into whole passes over its documents and a rest; the rest takes
the blocks with the lowest seeded hash. The cut-off comes from a histogram of hashes, so no block is sorted or
collected, and a document knows from its own blocks alone what the mix takes of it.

Everything runs on DataFrame functions. To the driver come the totals of each source and shard, sources x SHARDS rows,
as the seats are dealt there: sources are a catalogue, not hosts. They go back by broadcast up to MOST_SENT rows.

Defined edge cases: a null text has size 0 and nothing of it is taken; a null source is a source of its own, the last;
a null doc_id hashes as null; repeated rows are taken alike; ties of hashes are taken or left together; sources
without words have target 0; an empty table gives an empty result; further columns are not carried by ``mix``, and all
are kept by ``apply_mix``, whatever their names.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import map_slices, materialise

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2.0
BLOCK = 64
SHARDS = 16
BINS = 4096
MOST_SENT = 1 << 16
SEED = 20240607
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> dict:
    """Target words of each source: the budget by weight, capped, the excess reshared until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, list(order), budget * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit > most * sizes[s]]
        if not over:
            out |= {s: weight[s] * unit for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free = [s for s in free if s not in over]
    return out


def sainte_lague(votes: dict, seats: int, caps: dict | None = None) -> dict:
    """Seats by the highest quotients votes / (2 seats + 1), none above its cap; ties go to the earlier key.

    Starts from the whole quotas less one, which every such allotment reaches, and deals out only what is left.
    """
    total = sum(votes.values())
    caps = caps or {}
    if not total:
        return dict.fromkeys(votes, 0)
    order = {k: i for i, k in enumerate(votes)}
    out = {k: max(0, min(caps.get(k, seats), int(seats * v / total) - len(votes))) for k, v in votes.items()}
    heap = [(-v / (2 * out[k] + 1), order[k], k) for k, v in votes.items() if v and out[k] < caps.get(k, seats)]
    heapq.heapify(heap)
    left = seats - sum(out.values())
    while left > 0 and heap:
        _, i, k = heapq.heappop(heap)
        out[k] += 1
        left -= 1
        if out[k] < caps.get(k, seats):
            heapq.heappush(heap, (-votes[k] / (2 * out[k] + 1), i, k))
    return out


def _block_hash(seed: int) -> Column:
    return F.expr(f"pmod(xxhash64(doc_id, b, {seed}L), {BINS})")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of each document."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def _sent(table: DataFrame, rows: int) -> DataFrame:
    """The table, for a broadcast if it has at most MOST_SENT rows; else Spark joins it by shuffle."""
    return F.broadcast(table) if rows <= MOST_SENT else table


_SHARD = f"cast(pmod(xxhash64({{seed}}L, doc_id), {SHARDS}) as int)"
_CHOSEN = f"filter(sequence(0L, ({{size}} - 1) div {BLOCK}), b -> pmod(xxhash64(doc_id, b, {{seed}}L), {BINS}) < {{cutoff}})"


def plan(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED) -> DataFrame:
    """(source, shard, source_size, target, passes, cutoff) for a stored table of ``sized``, ready to be joined.

    A document of a shard is taken ``passes`` times whole, and its blocks of BLOCK words whose hash lies below cutoff
    once more.
    """
    spark = sizes.sparkSession
    own = sizes.withColumn("shard", F.expr(_SHARD.format(seed=seed + 1)))
    words = {(r["source"], r["shard"]): r["n"] for r in own.groupBy("source", "shard").agg(F.sum("size").alias("n")).collect()}
    by_source: dict = {}
    for (s, _), n in words.items():
        by_source[s] = by_source.get(s, 0) + n
    goal = targets(by_source, weights, budget, most)
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    blocks = sainte_lague({s: goal[s] for s in order}, round(sum(goal.values()) / BLOCK))
    rows = []
    for s in order:
        shards = {k: words[s, k] for k in range(SHARDS) if (s, k) in words}
        quota = sainte_lague(shards, blocks[s])
        for k, n in shards.items():
            want = min(quota[k] * BLOCK, int(most * n))
            rows.append((s, k, by_source[s], float(goal[s]), want // n if n else 0, want % n if n else 0))
    table = spark.createDataFrame(rows, "source string, shard int, source_size long, target double, passes long, rest long")
    pieces = own.where("size > 0").withColumn("b", F.explode(F.expr(f"sequence(0L, (size - 1) div {BLOCK})")))
    bins = pieces.groupBy("source", "shard", _block_hash(seed).alias("bin")).agg(F.sum(F.expr(f"least({BLOCK}, size - b * {BLOCK})")).alias("n"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"]) & (a["shard"] == b["shard"])
    # at most BINS rows for each source and shard: the running sum stands where it is nearest to the rest
    run = Window.partitionBy("source", "shard").orderBy("bin")
    summed = bins.withColumn("upto", F.sum("n").over(run))
    near = summed.join(_sent(table, len(rows)), same(summed, table)).select(summed["source"], summed["shard"], "bin", F.abs(F.col("upto") - F.col("rest")).alias("off"), "rest")
    cut = near.groupBy("source", "shard").agg(F.min(F.struct("off", "bin")).alias("best"), F.first("rest").alias("rest")).select("source", "shard", F.when(F.col("best.off") <= F.col("rest"), F.col("best.bin") + 1).otherwise(0).alias("cutoff"))
    full = table.join(cut, same(table, cut), "left").select(table["source"], table["shard"], "source_size", "target", "passes", F.coalesce("cutoff", F.lit(0)).cast("long").alias("cutoff"))
    return _sent(full, len(rows))


def mix(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, passes, cutoff) for a stored table of ``sized``.

    taken is passes * size plus the words of the document's chosen blocks.
    """
    own, table = sizes.withColumn("shard", F.expr(_SHARD.format(seed=seed + 1))), plan(sizes, weights, budget, most, seed)
    on = own["source"].eqNullSafe(table["source"]) & (own["shard"] == table["shard"])
    full = own.join(table, on, "left").select(own["doc_id"], own["source"], "size", "source_size", "target", "passes", "cutoff")
    chosen = _CHOSEN.format(size="size", seed=seed, cutoff="cutoff")
    part = F.expr(f"case when size > 0 and cutoff > 0 then aggregate({chosen}, 0L, (a, b) -> a + least({BLOCK}, size - b * {BLOCK})) else 0L end")
    return full.withColumn("taken", F.col("passes") * F.col("size") + part)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(materialise(sized(docs), "sizes")).select("doc_id", "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed documents, all columns: a row for each whole pass over a document, and one with its chosen blocks.

    White space of the chosen blocks is kept; n_chars, if there is one, follows the text. Only the plan's small table
    meets the documents, whose texts stay where they are.
    """
    names, kinds = docs.columns, dict(docs.dtypes)
    table = plan(materialise(sized(docs), "sizes"), seed=seed).withColumnsRenamed({c: f"_mix_{c}" for c in ("source", "shard", "source_size", "target", "passes", "cutoff")})
    own = docs.withColumns({"_mix_own": F.expr(_SHARD.format(seed=seed + 1)), "_mix_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")}).where("_mix_size > 0")
    joined = own.join(table, F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col("_mix_own") == F.col("_mix_shard")))
    picked = joined.withColumn("_mix_blocks", F.when(F.col("_mix_cutoff") > 0, F.expr(_CHOSEN.format(size="_mix_size", seed=seed, cutoff="_mix_cutoff"))).otherwise(F.expr("cast(array() as array<bigint>)")))
    word, at = re.compile(WORD), names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[int] = []
        texts: list[str] = []
        for i, (text, passes, blocks) in enumerate(zip(*(batch.column(k).to_pylist() for k in (at, len(names), len(names) + 1)))):
            rows += [i] * passes
            texts += [text] * passes
            if blocks:
                starts = [m.start() for m in word.finditer(text)][::BLOCK]
                cuts = [*starts, len(text)]
                rows.append(i)
                texts.append("".join(text[cuts[b] : cuts[b + 1]] for b in blocks))
        pick = pa.array(rows, pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else batch.column(k).take(pick) for k in range(len(names))], names)

    kept = picked.where((F.col("_mix_passes") > 0) | (F.size("_mix_blocks") > 0))
    out = map_slices(kept, [*names, "_mix_passes", "_mix_blocks"], ", ".join(f"`{c}` {kinds[c]}" for c in names), run)
    return out.withColumn("n_chars", F.length("text").cast(kinds["n_chars"])) if "n_chars" in names else out
