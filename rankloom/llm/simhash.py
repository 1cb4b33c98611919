"""SimHash near-duplicates: 64-bit fingerprints, linked within a Hamming radius by vantage-point trees.

A top tree, fitted on a bounded sample of fingerprints (``SAMPLE``), parts the fingerprints into shards by their
distance to vantage points. A pair that a node parts has its near end within the radius of the boundary; that end is
copied over the boundary, so every pair within the radius meets in some shard. Inside a shard a tree of the same kind
prunes further, and small leaves are compared in full. Shards that stay large are parted into blocks, one task for each
pair of blocks. Only spanning forests of the links leave a shard, so a group of copies never gives all of its pairs.

Defined edge cases: a null text counts as empty; texts without words have fingerprint zero, linked like any other; with
one or two words the whole sequence is the shingle; null doc_ids never name a component, and a component of null
doc_ids only has a null id; repeated rows get the same result; an empty table gives an empty result; further columns
are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import map_slices, materialise, sent
from rankloom.llm.components import connected_components
from rankloom.llm.passages import mix, shingles

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints that the top tree is fitted on, at most; every fingerprint is then placed.
SAMPLE = 32768
#: Fingerprints wanted in a shard, and the most that one task takes; its own tree parts them further. The sample can tell
#: some 2,000 leaves apart, so shards are parted into block pairs only beyond about 10**9 distinct fingerprints.
SHARD, BLOCK = 4096, 1 << 19
LEAF = 256


def fingerprint(text: str, width: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half of the XXH64 values of the lower-cased (A-Z) word shingles, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(*[words[k:] for k in range(width)]))) if len(words) >= width else [b" ".join(words)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 15):
        part = shingles[at : at + (1 << 15)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(seed)), "<u8", len(part))
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = np.array([fingerprint(x or "", width, seed) for x in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64))], [key, "fp"])

    return map_slices(df, [key, text], f"{key} {dict(df.dtypes)[key]}, fp long", run)


def distances(points: np.ndarray, one: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ one).astype(np.int64)


def choose(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and a boundary that leave few points near it on the inner side; None if nothing parts them."""
    best = None
    for one in points[rng.integers(0, len(points), 6)]:
        counts = np.bincount(distances(points, one), minlength=65)
        upto = np.cumsum(counts)
        for mu in range(64):
            inner, outer = upto[mu], len(points) - upto[mu] + counts[max(0, mu - radius + 1) : mu + 1].sum()
            worst = max(inner, outer)
            if inner and inner < len(points) and worst <= 0.9 * len(points) and (best is None or (inner * inner + outer * outer) < best[0]):
                best = (inner * inner + outer * outer, one, mu)
    return best and (best[1], best[2])


def fit_tree(sample: np.ndarray, leaf: int, radius: int, seed: int = SEED) -> list[tuple]:
    """Nodes (vantage point, boundary, inner, outer); a negative child -1-k is leaf k, and so is the root of an empty list."""
    rng, nodes, leaves = np.random.default_rng(seed), [], 0
    todo = [(sample, None, 0)]
    while todo:
        points, parent, side = todo.pop()
        split = choose(points, radius, rng) if len(points) > leaf else None
        if split:
            own = len(nodes)
            nodes.append([*split, None, None])
            d = distances(points, split[0])
            todo += [(points[d <= split[1]], own, 2), (points[d > split[1] - radius], own, 3)]
        else:
            own, leaves = -1 - leaves, leaves + 1
        if parent is not None:
            nodes[parent][side] = own
    return [tuple(x) for x in nodes]


def place(nodes: list[tuple], points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of point, leaf) for each leaf that a point belongs to or is copied to."""
    index, leaves, todo = [], [], [(np.arange(len(points)), 0 if nodes else -1)]
    while todo:
        own, at = todo.pop()
        if not len(own):
            continue
        if at < 0:
            index.append(own)
            leaves.append(np.full(len(own), -1 - at))
            continue
        one, mu, inner, outer = nodes[at]
        d = distances(points[own], one)
        todo += [(own[d <= mu], inner), (own[d > mu - radius], outer)]
    return (np.concatenate(index), np.concatenate(leaves)) if index else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _components(near: np.ndarray) -> np.ndarray:
    """The smallest index reachable, for a symmetric boolean matrix with a true diagonal."""
    labels = np.arange(len(near))
    while True:
        new = np.where(near, labels[None, :], len(near)).min(axis=1)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def forest(points: np.ndarray, radius: int, seed: int = SEED) -> set[tuple[int, int]]:
    """Pairs of points within the radius that connect what any such pairs connect; points must be distinct."""
    rng, out, todo = np.random.default_rng(seed), set(), [points]

    def compare(own: np.ndarray) -> None:
        near = np.bitwise_count(own[:, None] ^ own[None, :]) <= radius
        if near.sum() > len(own):
            for i, k in enumerate(_components(near)):
                if i != k:
                    out.add((int(own[i]), int(own[k])))

    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            if len(own) > 1:
                compare(own)
            continue
        split = choose(own, radius, rng)
        if split:
            d = distances(own, split[0])
            todo += [own[d <= split[1]], own[d > split[1] - radius]]
        else:
            half = [own[i : i + LEAF] for i in range(0, len(own), LEAF)]
            for i, a in enumerate(half):
                for b in half[i + 1 :]:
                    compare(np.concatenate([a, b]))
    return out


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that span all links within the radius between the distinct fingerprints in column fp."""
    total = distinct.count()
    every = max(1, total // SAMPLE)
    sample = np.array([r[0] for r in distinct.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).limit(2 * SAMPLE).collect()], np.int64).view(np.uint64)
    # leaves follow the number of fingerprints, up to what the sample can tell apart
    nodes = fit_tree(sample, max(16, int(len(sample) * SHARD / max(total, 1))), radius)

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        points = batch.column(0).to_numpy(zero_copy_only=False)
        index, leaves = place(nodes, points.view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(leaves.astype(np.int32)), pa.array(points[index])], ["shard", "fp"])

    placed = materialise(map_slices(distinct, ["fp"], "shard int, fp long", route), "shards")
    # at most as many rows as the tree has leaves, which SAMPLE bounds
    blocks = F.broadcast(placed.groupBy("shard").count().select("shard", F.ceil(F.col("count") / BLOCK).cast("int").alias("g")))
    own = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    cells = placed.join(blocks, "shard").withColumn("b", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select("shard", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "fp")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = forest(np.unique(pdf["fp"].to_numpy()).view(np.uint64), radius)
        ends = np.array(sorted(pairs), np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"u": ends[:, 0], "v": ends[:, 1]})

    return cells.groupBy("shard", "i", "j").applyInPandas(links, "u long, v long")


def near_duplicates(prints: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(key, fp, component_id) for a stored table of ``fingerprints``; component_id is the smallest key reachable."""
    groups = materialise(prints.groupBy("fp").agg(F.min(key).alias("least")), "groups")
    roots = connected_components(near_links(groups, radius))
    labelled = materialise(groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "labels")
    tops = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(labelled.join(tops, "root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def op8(spark, sf_dir: str) -> DataFrame:
    prints = materialise(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")), "prints")
    return near_duplicates(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near-duplicates of ``keep_one``: Jaccard similarity of sets of five-word shingles.
WIDTH, LEAST = 5, 0.8
#: Min-hashes in a band and bands: texts at LEAST share a band with a probability of 0.997.
ROWS, BANDS = 8, 32
#: Texts of one band of which all pairs are asked; of more, each asks the most central one and ``band_forest`` does the rest.
FULL = 16
#: Shingles of one band that are compared in one go; of more, one pair of blocks at a time.
HOLD = 1 << 20


def shingle_set(text: str) -> np.ndarray:
    """Sorted hashes of the five-word shingles; of the whole sequence where it is shorter, nothing without words."""
    own = shingles(text, WIDTH)
    return np.unique(own if len(own) else shingles(text, max(1, len(text.encode().split()))))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, bands): a hash of each band of min-hashes; sets without elements share all bands."""
    rows, number = ROWS, BANDS
    k = np.arange(rows * number, dtype=np.uint64)
    factors = mix(k + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    held = np.array([i for i, x in enumerate(sets) if len(x)], np.int64)
    least = np.full((len(k), len(sets)), np.iinfo(np.uint64).max)
    if len(held):
        joined = np.concatenate([sets[i] for i in held])
        starts = np.cumsum([0] + [len(sets[i]) for i in held[:-1]])
        for i, factor in enumerate(factors):
            least[i, held] = np.minimum.reduceat((joined ^ (factor >> np.uint64(1))) * factor, starts)
    total = np.repeat(np.arange(number, dtype=np.uint64)[:, None], len(sets), axis=1)
    for part in least.reshape(number, rows, len(sets)).transpose(1, 0, 2):
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + part)
    return total.T.view(np.int64) if number else total.T


def _sketch(texts: DataFrame) -> DataFrame:
    """(band, u) for each text (u, text) and band."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = bands([shingle_set(x) for x in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([pa.array(own.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), own.shape[1]))], ["band", "u"])

    return map_slices(texts, ["u", "text"], "band long, u long", run)


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, u, v) for rows (band, u) sorted by both: all pairs of a band of FULL texts or fewer; a larger one's texts, with null v."""
    none = np.zeros(0, np.int64)
    held, large = (none, none), None  # the band that may go on, and whether it is known to be large

    def made(band: np.ndarray, u: np.ndarray, known) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, band[1:] != band[:-1])) if len(band) else none
        sizes = np.diff(np.append(starts, len(band)))
        each, first = np.repeat(sizes, sizes), np.repeat(starts, sizes)
        big = each > FULL
        if known is not None:
            big |= band == known
        i, j = [np.flatnonzero(big)], [np.flatnonzero(big)]
        for step in range(1, min(FULL, int(sizes.max(initial=1)))):
            own = np.flatnonzero((np.arange(len(band)) - first >= step) & ~big)
            i.append(own)
            j.append(own - step)
        alone = np.arange(sum(map(len, i))) < len(i[0])
        i, j = np.concatenate(i), np.concatenate(j)
        return pa.RecordBatch.from_arrays([pa.array(band[i]), pa.array(u[i]), pa.array(u[j], mask=alone)], ["band", "u", "v"])

    for batch in batches:
        band, u = (np.append(x, batch.column(k).to_numpy()) for k, x in enumerate(held))
        if not len(band):
            continue
        cut = int(np.searchsorted(band, band[-1]))
        known = large
        if len(band) - cut > FULL or band[-1] == large:
            large, cut = band[-1], len(band)  # a large band need not be held: its texts are given out as they come
        else:
            large = None
        held = band[cut:], u[cut:]
        yield made(band[:cut], u[:cut], known)
    yield made(*held, large)


def tree_pairs(texts: DataFrame) -> DataFrame:
    """(u, v) of stored texts (u, text) whose fingerprints are equal or linked by the vantage-point trees: spanning forests only."""
    prints = materialise(fingerprints(texts, "u"), "prints")
    groups = materialise(prints.groupBy("fp").agg(F.min("u").alias("least")), "groups")
    equal = prints.join(groups, "fp").where("u <> least").select("u", F.col("least").alias("v"))
    ends = near_links(groups, RADIUS).withColumnsRenamed({"u": "x", "v": "y"})
    linked = ends.join(groups.select(F.col("fp").alias("x"), F.col("least").alias("u")), "x").join(groups.select(F.col("fp").alias("y"), F.col("least").alias("v")), "y").select("u", "v")
    return equal.unionByName(linked)


def similar(texts: DataFrame) -> DataFrame:
    """(u, v) of alike texts among stored distinct ones (u long, text): Jaccard similarity of LEAST or more.

    The trees give the pairs whose fingerprints are within their radius. Alike texts may differ in ten bits and more, and
    trees of such a radius would copy most fingerprints to most leaves, so texts that share a band of min-hashes are
    compared too. A band of very many texts compares each with its most central one, that shares most bands with others;
    then all of its pairs that these links leave unjoined are compared, so the components are those of all pairs of a band.
    """

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [shingle_set(x).view(np.int64) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], ["u", "own"])

    # sizes first, as most unlike pairs differ in them
    small, large = F.least(F.size("own"), F.size("other")), F.greatest(F.size("own"), F.size("other"))
    common = F.size(F.array_intersect("own", "other"))
    alike = F.when(small >= LEAST * large, common >= LEAST * (small + large - common)).otherwise(False)
    pair = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = materialise(_sketch(texts).repartition("band").sortWithinPartitions("band", "u").mapInArrow(_partners, "band long, u long, v long"), "partners")
    hot = found.where("v is null").select("band", "u").distinct()
    sizes = hot.groupBy("band").agg(F.count("*").alias("n"))
    weight = hot.join(sizes, "band").groupBy("u").agg(F.sum("n").alias("w"))
    first = hot.join(weight, "u").groupBy("band").agg(F.max_by("u", F.struct("w", "u")).alias("v"))
    placed = materialise(hot.join(first, "band"), "placed")
    stars = placed.where("u <> v").select("u", "v")
    asked = materialise(pair(found.where("v is not null")).unionByName(pair(stars)).unionByName(pair(tree_pairs(texts))).distinct(), "asked")
    ends = asked.select("u").unionByName(asked.select(F.col("v").alias("u"))).distinct()
    own = materialise(map_slices(texts.join(sent(materialise(ends, "ends")), "u", "left_semi"), ["u", "text"], "u long, own array<long>", sets), "sets")
    both = asked.join(own, "u").join(own.select(F.col("u").alias("v"), F.col("own").alias("other")), "v")
    good = materialise(both.where(alike).select("u", "v"), "alike")
    if placed.limit(1).count() == 0:
        return good
    return good.unionByName(materialise(_unjoined(placed.select("band", "u"), own, connected_components(good)), "joined"))


def _unjoined(hot: DataFrame, own: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v) of alike texts of large bands (band, u) that join what the components ``roots`` leave apart.

    Bands of one component are done, and of bands of the same texts one is compared. Bands of more than HOLD shingles are
    parted into blocks, and each pair of blocks is compared.
    """
    labels = hot.join(roots.withColumnRenamed("node", "u"), "u", "left").select("band", "u", F.coalesce("root", "u").alias("label"))
    labels = materialise(labels.join(own.select("u", F.size("own").alias("m")), "u"), "labels")
    same = F.sum(F.xxhash64("u").cast("decimal(38,0)")).alias("texts")
    large = labels.groupBy("band").agg(F.count("*").alias("n"), same, F.sum("m").alias("m"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    kept = large.groupBy("n", "texts").agg(F.min("band").alias("band"), F.max("m").alias("m")).select("band", F.ceil((F.col("m") + 1) / HOLD).cast("int").alias("g"))
    rows = labels.drop("m").join(materialise(kept, "bands"), "band")
    rows = rows.withColumn("p", F.pmod(F.xxhash64("u"), F.col("g")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    cells = rows.select("band", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "u", "label").join(own, "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def made() -> pa.RecordBatch:
            pairs = band_forest(np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64), [r[2] for r in held])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*pairs) if pairs else ([], []))], ["u", "v"])

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            edges, flat = batch.column(5).offsets.to_numpy(), batch.column(5).values.to_numpy()
            for k, (u, label) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                if keys[k] != key:
                    if len(held) > 1:
                        yield made()
                    key, held = keys[k], []
                held.append((u, label, flat[edges[k] : edges[k + 1]].copy()))
        if len(held) > 1:
            yield made()

    cells = cells.select("band", "i", "j", "u", "label", "own").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return cells.mapInArrow(run, "u long, v long")


def band_forest(u: np.ndarray, label: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Alike pairs that join what any alike pairs of the texts join, beside those of one label, which are joined already.

    A text with too few shingles that others have is alike to none. Small components are compared with all others first.
    """
    sets = [x if len(x) else np.zeros(1, np.int64) for x in sets]  # texts without shingles are alike
    size, out, own = np.array([len(x) for x in sets]), [], np.arange(len(sets))
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(own, size)
    alive = np.ones(len(sets), bool)
    while True:
        shared = np.bincount(ids[alive[row]], minlength=len(values)) > 1
        good = alive & (np.bincount(row, shared[ids], minlength=len(sets)) >= LEAST * size - 1e-9)
        if (good == alive).all():
            break
        alive = good
    own = np.flatnonzero(alive)
    if len(own) < 2:
        return out
    part = np.unique(label, return_inverse=True)[1]
    starts = np.cumsum(size) - size
    members: dict[int, list[int]] = {}
    for i in own.tolist():
        members.setdefault(int(part[i]), []).append(i)
    free, mark = alive, np.zeros(len(values), bool)
    for first in sorted(members, key=lambda k: len(members[k])):
        todo = [i for i in members[first] if free[i]]
        free[todo] = False
        while todo:
            x = todo.pop()
            rest = np.flatnonzero(free & (size >= LEAST * size[x] - 1e-9) & (LEAST * size <= size[x] + 1e-9))
            if not len(rest):
                continue
            mine = ids[starts[x] : starts[x] + size[x]]
            mark[mine] = True
            n = size[rest]
            edges = np.cumsum(n) - n
            common = np.add.reduceat(mark[ids[np.arange(n.sum()) + np.repeat(starts[rest] - edges, n)]], edges, dtype=np.int64)
            mark[mine] = False
            for y in rest[common >= LEAST * (size[x] + n - common)].tolist():
                if free[y]:
                    out.append((int(u[x]), int(u[y])))
                    reached = [i for i in members[int(part[y])] if free[i]]
                    free[reached] = False
                    todo += reached
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents without near-duplicates: of each component the row with its smallest doc_id stays, once.

    Rows may repeat an id or have none: of equal ids the text with the smaller hash comes first, null ids come last.
    Texts are linked from a Jaccard similarity of LEAST on, as ``similar`` finds them by trees and bands.

    Texts stay where they are as long as what is dropped is small enough to be sent to them: first all rows of a text but
    one, for the search, then all rows of a component but one.
    """
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    keys = materialise(docs.select(own.alias("u"), "doc_id"), "keys")
    groups = materialise(keys.groupBy("u").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "groups")
    again = materialise(keys.join(groups.where("n > 1"), "u").where("not doc_id <=> least").select("u", "doc_id").distinct(), "again")
    full = docs.select(own.alias("u"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = _without(full, again).select("u", "text")
    # rows that repeat both id and text are still there
    twice = keys.join(groups.where("n > 1"), "u").where("doc_id <=> least").groupBy("u").count().where("count > 1").select("u")
    twice = materialise(twice, "twice")
    if twice.limit(1).count():
        texts = texts.join(sent(twice), "u", "left_anti").unionByName(texts.join(sent(twice), "u", "left_semi").dropDuplicates(["u"]))
    roots = connected_components(similar(texts)).withColumnRenamed("node", "u")
    labels = materialise(groups.select("u", "least").join(roots, "u", "left").select("u", "least", F.coalesce("root", "u").alias("root")), "labels")
    # ids need not be unique or present: a row is known by its id and its text, and rows without an id come last
    best = materialise(labels.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "u")).alias("m")).select("m.u", F.col("m.least").alias("doc_id")), "best")
    drop = materialise(keys.distinct().join(best.withColumn("kept", F.lit(True)), (keys["u"] == best["u"]) & keys["doc_id"].eqNullSafe(best["doc_id"]), "left").where("kept is null").select(keys["u"], keys["doc_id"]), "drop")
    kept = _without(docs.withColumn("__dedup_u", own), drop, "__dedup_u")
    again = materialise(keys.join(best, (keys["u"] == best["u"]) & keys["doc_id"].eqNullSafe(best["doc_id"]), "left_semi").groupBy("u").count().where("count > 1").select(F.col("u").alias("__dedup_u")), "again")
    if again.limit(1).count():
        place = Window.partitionBy("__dedup_u").orderBy(F.to_json(F.struct(*docs.columns)))
        some = kept.join(sent(again), "__dedup_u", "left_semi").withColumn("__dedup_place", F.row_number().over(place)).where("__dedup_place = 1").drop("__dedup_place")
        kept = kept.join(sent(again), "__dedup_u", "left_anti").unionByName(some)
    return kept.select(*docs.columns)


def _without(df: DataFrame, drop: DataFrame, u: str = "u") -> DataFrame:
    """Rows whose text hash and id are not in the stored table (u, doc_id); ids may be null."""
    gone = sent(drop).withColumnsRenamed({"u": "_gone", "doc_id": "_id"})
    return df.join(gone, (df[u] == gone["_gone"]) & df["doc_id"].eqNullSafe(gone["_id"]), "left_anti")
