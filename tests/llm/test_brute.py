"""Whole queries and stages against plain Python versions of their contracts."""

import base64
import hashlib
import itertools
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from rankloom.llm import ann, bpe, media, mixing, passages, pii, quality, simhash, toxicity
from rankloom.llm.common import materialise

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


# --- media


def test_media_rows(spark, texts):
    for r in media.op2(spark, SF).collect():
        raw = texts[r["doc_id"]].encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        image = np.frombuffer(padded, np.uint8).reshape(-1, 64)
        tile = media.write_npy(media.to_uint8(slow_resize(image, 32, 32)))
        small = np.round(slow_resize(image, 8, 9), 6)
        bits = "".join("1" if b > a else "0" for row in small for a, b in zip(row, row[1:]))
        assert r["feature"] == f"{int(bits, 2):016x}:{zlib.crc32(tile):08x}"


def slow_resize(image, height, width):
    """Area averages by the share of each source row and column that falls into each output cell."""

    def shares(n, m):
        edges = np.linspace(0, n, m + 1)
        return np.clip(np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n)), 0, None)

    return shares(image.shape[0], height) @ image @ shares(image.shape[1], width).T * (height * width / image.size)


@pytest.mark.parametrize("data", [b"P5 0 4 255\n", b"P5 4 0 255\n", b"P6 0 0 255\n", b"P4 0 3\n", b"P2 2 1 255 300 -5", b"P2 2 1 255 300 5", b"P5 1 1 10\n\xff", b"P2 1 1 255 99999999999999999999", b"BM", b"", b"P7 1 1"])
def test_bad_images_are_value_errors(data):
    with pytest.raises(ValueError):
        media.decode(data)


def test_bad_images_give_nulls_and_bmp_is_lossless(spark):
    bad = spark.createDataFrame([(1, bytearray(b"P5 0 4 255\n")), (2, None), (3, bytearray(b"P2 2 1 10 10 5"))], "doc_id long, media binary")
    got = {r["doc_id"]: r["dhash"] for r in media.media_tiles(bad).collect()}
    assert got[1] is None and got[2] is None and got[3] is not None
    texts = spark.createDataFrame([(1, "x" * 300), (2, None)], "doc_id long, text string")
    one, two = ({r["doc_id"]: r["payload_sha256"] for r in media.media_digest(materialise(media.texts_as_media(texts, form=f), "m")).collect()} for f in ("pgm", "bmp"))
    assert one == two == {1: hashlib.sha256(b"x" * 300 + bytes(20)).hexdigest(), 2: hashlib.sha256(bytes(64)).hexdigest()}


# --- passages


def test_streams_do_not_hang_on_how_rows_are_batched(monkeypatch):
    """Groups that go over batches, or are larger than a task holds, give the same links or link the same texts."""

    class Plan:
        def __init__(self):
            self.calls = []

        def repartition(self, *_):
            return self

        sortWithinPartitions = repartition

        def mapInArrow(self, f, _):
            self.calls.append(f)
            return self

    rng = np.random.default_rng(3)
    h = np.concatenate([np.full(n, v) for v, n in [(7, 30), (-3, 1), (3, 500), (100, 2), (5, 1), (-9, 60), (12, 1)]])
    near, doc = rng.integers(0, 3, len(h)).astype(np.int32), rng.integers(0, 60, len(h))
    place, s = passages.packed(rng.integers(0, 1000, len(h)), rng.integers(20, 46, len(h)), rng.integers(20, 46, len(h)), 0), rng.integers(0, 100, len(h)).astype(np.int32)
    found, spans = Plan(), Plan()
    passages.links(found)
    passages.same_spans(spans)

    def run(f, columns, hold, size):
        monkeypatch.setattr(passages, "HOLD", hold)
        batches = (pa.RecordBatch.from_arrays([pa.array(x[i : i + size]) for x in columns], [str(k) for k in range(len(columns))]) for i in range(0, len(h), size))
        return [r for b in f(batches) for r in b.to_pylist()]

    for f, columns in ((found.calls[0], (h, near, doc, place)), (spans.calls[0], (h, doc, s))):
        whole = run(f, columns, 1 << 20, 10_000)
        assert sorted(map(str, whole)) == sorted(map(str, run(f, columns, 1 << 20, 7)))
        parts = run(f, columns, 20, 13)
        assert joined(whole) == joined(parts)
        assert sorted(str(r) for r in whole if r.get("b", 0) is None) == sorted(str(r) for r in parts if r.get("b", 0) is None)


def joined(rows):
    top = {}

    def find(k):
        top.setdefault(k, k)
        while top[k] != k:
            k = top[k]
        return k

    for r in rows:
        if r["b"] is not None:
            top[find(r["a"])] = find(r["b"])
    return sorted(sorted(k for k in top if find(k) == q) for q in {find(k) for k in top})


def test_batched_windows_are_those_of_single_texts():
    rng = np.random.default_rng(1)
    sizes = np.array([46, 100, 47, 500, 64, 46])
    values = rng.integers(0, 1 << 63, sizes.sum(), dtype=np.uint64)
    want, at = [], 0
    for n in sizes:
        l, c, r = passages.compact_windows(values[at : at + n])
        want += [(max(a, b - 45) + at, b + at, min(x, b + 45) + at) for a, b, x in zip(l.tolist(), c.tolist(), r.tolist())]
        at += n
    assert list(zip(*(x.tolist() for x in passages.compact_windows(values, 46, sizes, 45)))) == want


def test_recall_of_near_passages_among_frequent_lines(spark):
    """Pairs of passages of 50 to 60 words with a word changed, in texts made of 40 frequent lines: the class joins nearly all."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    lines = [[word() for _ in range(12)] for _ in range(40)]
    texts = [[w for _ in range(10) for w in rng.choice(lines)] for _ in range(300)]
    for i in range(0, 300, 2):
        own = [word() for _ in range(50 + i % 11)]
        for k in (0, 1):
            part = list(own)
            if k:
                part[len(part) // 2] = "changed"
            at = 12 * rng.randint(0, 10)
            texts[i + k][at:at] = part
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    out = {r["doc_id"]: r["class_id"] for r in passages.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(out[i] == out[i + 1] for i in range(0, 300, 2))
    assert found >= 145, found


def test_all_alike_windows_of_a_value_are_joined():
    """Spanning links join the texts of every alike pair of windows, found one by one, whichever text comes first."""
    rng = np.random.default_rng(5)
    line, rows = rng.integers(0, 1 << 32, 20, dtype=np.uint32), []
    for i in range(100):
        if i % 5 == 0:  # texts that share the line only, or a part of what stands beside it
            base = rng.integers(0, 1 << 32, 91, dtype=np.uint32)
            base[40:60] = line
        own = base.copy()
        at = rng.integers(0, 91, rng.integers(0, 12))
        own[at] = rng.integers(0, 1 << 32, len(at), dtype=np.uint32)
        if i % 7 == 0:
            own[70:] = own[69]
        if i % 4 == 0:
            own[10:39] = own[11:40].copy()
        own[45] = line[5]
        left, right = rng.integers(20, 46, 2)
        if left + right >= 45:
            rows.append((int(rng.integers(0, 120)), i * 100 + 50, (int(left) << 10) | (int(right) << 4), own[45 - left : 46 + right].tobytes()))
    got = passages.window_forest(*(np.array([r[k] for r in rows]) for k in range(3)), [r[3] for r in rows])
    cuts = [np.frombuffer(r[3], np.uint32) for r in rows]
    want = [{"a": rows[i][0], "b": rows[k][0]} for i, k in itertools.combinations(range(len(rows)), 2) if rows[i][0] != rows[k][0] and slow_alike(cuts[i], cuts[k])]
    assert len(want) > 30 and joined(want) == joined([{"a": r[0], "b": r[1]} for r in got])
    assert all(a > b and end - start >= 50 for a, b, start, end, _ in got)


def slow_alike(a, b):
    runs = lambda x: [set(x[i : i + 46].tolist()) for i in range(len(x) - 45)]
    return any(len(x & y) >= 0.8 * len(x | y) for x in runs(a) for y in runs(b))


def test_near_passages_made_of_frequent_lines_are_all_joined(spark):
    """Passages made of lines that all texts hold, each in two texts with a word changed: every pair, by brute force, is joined."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    lines = [[word() for _ in range(26)] for _ in range(5)]
    texts = []
    for i in range(70):
        own = [w for k in rng.sample(range(5), 3) for w in lines[k]]
        for _ in range(2):
            part = list(own)
            part[rng.randrange(len(part))] = word()
            part[rng.randrange(len(part))] = word()
            texts.append([*(word() for _ in range(40)), *part, *(word() for _ in range(40))])
    rng.shuffle(texts)
    out = {r["doc_id"]: r for r in passages.passage_classes(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")).collect()}
    own = [passages.shingles(" ".join(x)).astype(np.uint32) for x in texts]
    alike = [(i, k) for i, k in itertools.combinations(range(len(texts)), 2) if passages.verify(own[i], own[k])]
    assert len(alike) > 300
    missed = [(i, k) for i, k in alike if out[i]["class_id"] != out[k]["class_id"]]
    assert not missed, (len(missed), len(alike))


def test_windows_of_many_values_are_compared_at_once():
    """Groups side by side, small ones and such as are compared one by one, link what each alone links by brute force."""
    rng = np.random.default_rng(11)
    line, groups = rng.integers(0, 1 << 32, 30, dtype=np.uint32), []
    for g in range(12):
        rows = []
        for i in range(14):
            if i % 4 == 0:  # all groups hold the line
                base = rng.integers(0, 1 << 32, 91, dtype=np.uint32)
                base[35:65] = line
            own = base.copy()
            at = rng.integers(0, 91, rng.integers(0, 9))
            own[at] = rng.integers(0, 1 << 32, len(at), dtype=np.uint32)
            if i % 5 == 0:
                own[10:39] = own[11:40].copy()
            if i % 7 == 0:
                own[70:] = own[69]
            left, right = rng.integers(25, 46, 2)
            rows.append((int(rng.integers(0, 40)) + 100 * g, i * 100 + 50, (int(left) << 10) | (int(right) << 4), own[45 - left : 46 + right].tobytes()))
        groups.append(rows)
    want = []
    for rows in groups:
        cuts = [np.frombuffer(r[3], np.uint32) for r in rows]
        want += [{"a": rows[i][0], "b": rows[k][0]} for i, k in itertools.combinations(range(len(rows)), 2) if rows[i][0] != rows[k][0] and slow_alike(cuts[i], cuts[k])]
    flat = [r for rows in groups for r in rows]
    number = np.repeat(np.arange(len(groups)), [len(x) for x in groups])
    for small in (0, 8, 1000):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(passages, "SMALL", small)
            got = passages.window_forest(*(np.array([r[k] for r in flat]) for k in range(3)), [r[3] for r in flat], number)
        assert len(want) > 30 and joined(want) == joined([{"a": r[0], "b": r[1]} for r in got])


def test_only_windows_that_may_share_a_span_are_looked_up(spark):
    """Lines of 20 words that texts share ask for no span; a passage that two of them share asks for all of its own."""
    rng = random.Random(8)
    fresh = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    lines, both = [fresh(20) for _ in range(10)], fresh(60)
    texts = [[w for line in rng.sample(lines, 6) for w in [*line, *fresh(30)]] for _ in range(100)]
    shared = [[*fresh(40), *both, *fresh(40)] for _ in range(2)]

    def asked(rows):
        docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id long, text string").coalesce(1)
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        try:
            return passages.links(passages.windows(docs)).where("b is null").select("a", "ca", "code").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")

    # eight bits tell two sides apart but by chance; the last value of a part is always asked for
    assert len({r["a"] for r in asked(texts)}) < 60
    rows = asked(texts + shared)
    # each span of 46 shingles of the 56 that both hold lies around a core that is asked for
    for doc in (100, 101):
        spans = {s for r in rows if r["a"] == doc for s in range(r["ca"] - (r["code"] >> 10), r["ca"] + ((r["code"] >> 4) & 63) - 44) if r["ca"] - 45 <= s <= r["ca"]}
        assert spans >= set(range(40, 51))


def test_rows_that_repeat_an_id_count_as_one_text(spark):
    rng = random.Random(2)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    shared, other = fresh(60), fresh(70)
    rows = [(1, shared)] * 3 + [(1, other), (2, fresh(20) + " " + shared), (3, other + " " + fresh(9)), (4, fresh(80)), (None, shared)]
    out = [(r["doc_id"], r["class_id"], r["n_links"]) for r in passages.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(x for x in out if x[0]) == [(1, 1, 2)] * 4 + [(2, 1, 1), (3, 1, 1), (4, 4, 0)] and [x for x in out if x[0] is None] == [(None, None, 0)]


def test_all_alike_texts_of_a_large_band_are_joined():
    """Links join what all pairs of alike texts join, also texts that are both unlike the most central one."""
    rng = np.random.default_rng(9)
    base, rows = rng.integers(0, 1 << 62, 60), []
    for i in range(160):
        own = base.copy()
        at = rng.choice(60, int(rng.integers(0, 14)), replace=False)
        own[at] = rng.integers(0, 1 << 62, len(at))
        if i % 2:  # half of them have a partner that only they are alike to
            own = rows[-1].copy()
            own[rng.integers(0, 60, 4)] = rng.integers(0, 1 << 62, 4)
        rows.append(own)
    sets = [np.unique(x) for x in rows] + [np.zeros(0, np.int64)] * 2
    want = [(i, k) for i, k in itertools.combinations(range(len(sets)), 2) if len(np.intersect1d(sets[i], sets[k])) >= 0.8 * len(np.union1d(sets[i], sets[k]))]
    edges = lambda pairs: joined([{"a": i, "b": k} for i, k in pairs])
    label = np.arange(len(sets))
    got = simhash.band_forest(np.arange(len(sets)), label, sets)
    assert len(want) > 80 and edges(got) == edges(want)
    known = want[::9]
    for i, k in known:
        label[label == label[k]] = label[i]
    assert edges(simhash.band_forest(np.arange(len(sets)), label, sets) + known) == edges(want)


def test_links_of_texts_unlike_the_central_one_are_kept(spark, monkeypatch):
    """A large band's texts form a chain, of which only neighbours are alike: one text of all stays, however blocks part them."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    words, rows = [word() for _ in range(300)], []
    for i in range(60):
        for k in range(5 * i, 5 * i + 3):
            words[k % 300] = word()
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for hold in (simhash.HOLD, 4000):
        monkeypatch.setattr(simhash, "HOLD", hold)
        assert [r["doc_id"] for r in simhash.keep_one(frame).collect()] == [0]


# --- nearest neighbours


def test_search_in_query_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 12))
    rows = materialise(ann.valid(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")), "v")
    index = ann.fit(rows)
    whole = sorted(map(tuple, ann.search(rows, rows.where("vec_id % 20 = 0"), index=index).collect()))
    monkeypatch.setattr(ann, "ASKS", 9)
    assert sorted(map(tuple, ann.search(rows, rows.where("vec_id % 20 = 0"), index=index).collect())) == whole


def test_clustered_vectors_need_few_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 64)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(50, 32))[rng.integers(0, 50, 6000)] + 0.1 * rng.normal(size=(6000, 32))
    rows = materialise(ann.valid(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")), "v")
    index = ann.fit(rows)
    assert len(index.centres) > 80 and index.share < 0.4
    found = 0
    for r in ann.search(rows, rows.where("vec_id % 100 = 0"), index=index).groupBy("query_id").agg(F.collect_set("vec_id").alias("ids")).collect():
        scores = x @ x[r["query_id"]]
        scores[r["query_id"]] = -np.inf
        found += len(set(np.argsort(-scores)[:20].tolist()) & set(r["ids"]))
    assert found >= 0.9 * 20 * 60


def test_repeated_query_ids_ask_with_their_least_vector(spark, tmp_path):
    rows = [(0, [2.0, 0.0]), (0, [0.0, 1.0]), (5, [1.0, 0.0]), (6, [0.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [(r["vec_id"], r["score"]) for r in ann.op6(spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == [(6, 1.0), (5, 0.0)]


# --- personal data


def slow_spans(text):
    """The contract, pattern by pattern."""

    def luhn(d):
        total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d)))
        return total % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], ("email", "ip", "card", "phone").index(x[0]), x[2]))


def test_personal_data_rows(spark, texts):
    rng = random.Random(31)
    made = ["4111 1111 1111 1111 and 4111-1111-1111-1112", "+49 (30) 123-4567 89", "a@b.c.d, 1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004", "x" * 50 + "@y.z", "é😀 +1 202 555 0143 4012888888881881"]
    made += ["".join(rng.choices("ab@.-+ 0123456789()", k=rng.randint(0, 80))) for _ in range(1500)]
    rows = [*texts.items(), *((10_000 + i, x) for i, x in enumerate(made))]
    for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = texts.get(r["doc_id"]) if r["doc_id"] < 10_000 else made[r["doc_id"] - 10_000]
        base = slow_spans(text)
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        every = [tuple(x.split(":")) for x in r["spans"].split(",") if x]
        assert {(k, str(a), str(b)) for k, a, b in base} <= set(every) and len(every) == len(base) + r["n_added"]


@pytest.mark.parametrize("text", ["see [at] " + "a" * 1_000_000, "1 " * 300_000, "a dot " * 150_000, " " * 500_000 + "[at]", "a@" * 300_000, "one " * 200_000, "+1(" * 200_000, "1.2." * 200_000, "a@b.c one at x dot y " * 20_000])
def test_long_texts_take_linear_time(text):
    began = time.time()
    pii.detect_spans(text)
    assert time.time() - began < 6


# --- mixing


def spark_hash(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def slow_mix(rows):
    """taken of each (doc_id, source, size), block by block."""
    sizes, shard_words = {}, {}
    shard = {i: spark_hash(mixing.SEED + 1, i) % mixing.SHARDS for i, _, _ in rows}
    for i, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
        shard_words[s, shard[i]] = shard_words.get((s, shard[i]), 0) + n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, free, left = {}, list(order), 1.5 * sum(sizes.values())
    while free:
        unit = left / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * unit > 2 * sizes[s]]
        for s in over or free:
            goal[s] = 2.0 * sizes[s] if over else weights[s] * unit
        left -= sum(goal[s] for s in over)
        free = [s for s in free if s not in over] if over else []
    blocks = mixing.sainte_lague({s: goal[s] for s in order}, round(sum(goal.values()) / 64))
    plan, taken = {}, []
    for s in order:
        own = {k: shard_words[s, k] for k in range(mixing.SHARDS) if (s, k) in shard_words}
        for k, quota in mixing.sainte_lague(own, blocks[s]).items():
            want = min(quota * 64, int(2 * own[k]))
            passes, rest = (want // own[k], want % own[k]) if own[k] else (0, 0)
            held = {}
            for i, x, n in rows:
                if x == s and shard[i] == k:
                    for b in range(-(-n // 64)):
                        at = spark_hash(i, b, mixing.SEED) % mixing.BINS
                        held[at] = held.get(at, 0) + min(64, n - 64 * b)
            best, total = (rest, 0), 0
            for at in sorted(held):
                total += held[at]
                best = min(best, (abs(total - rest), at + 1))
            plan[s, k] = passes, best[1] if best[0] <= rest else 0
    for i, s, n in rows:
        passes, cut = plan[s, shard[i]]
        chosen = [b for b in range(-(-n // 64)) if spark_hash(i, b, mixing.SEED) % mixing.BINS < cut]
        taken.append((i, passes, chosen, passes * n + sum(min(64, n - 64 * b) for b in chosen), goal[s]))
    return taken


def test_mix_rows(spark, docs, texts):
    sources = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    rows = [(i, sources[i], len(WORD.findall(x))) for i, x in texts.items()]
    want = {i: (taken, goal) for i, _, _, taken, goal in slow_mix(rows)}
    for r in mixing.op9(spark, SF).collect():
        assert (r["taken"], r["target"]) == pytest.approx(want[r["doc_id"]])


def test_mixed_texts(spark, docs):
    rows = [(1, "  one two\tthree " * 90, "a", 5), (2, "x " * 70, "b", 5), (3, None, "b", 5), (4, "", None, None), (5, "w " * 1000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, passes int").withColumn("size", F.lit("kept"))
    want = []
    for (i, passes, chosen, _, _), (_, text, _, _) in zip(slow_mix([(i, s, len(WORD.findall(x or ""))) for i, x, s, _ in rows]), rows):
        cuts = [*[m.start() for m in WORD.finditer(text or "")][::64], len(text or "")]
        want += [(i, text)] * (passes if text and WORD.search(text) else 0) + ([(i, "".join(text[cuts[b] : cuts[b + 1]] for b in chosen))] if chosen else [])
    got = mixing.apply_mix(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted(want) and {r["size"] for r in got.collect()} == {"kept"}


# --- models


@pytest.mark.parametrize("train, score, column", [(quality.train, quality.score, "quality"), (toxicity.train, toxicity.score, "toxic")])
def test_labels_and_metadata_do_not_leak(spark, docs, train, score, column):
    """Other labels of held-out rows, languages and sources change no score."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = labels.withColumn(column, F.when(held, 1 - F.col(column)).otherwise(F.col(column)))
    strange = docs.withColumns({"lang": F.lit("xx"), "source": F.col("doc_id").cast("string"), "n_chars": F.lit(0)})
    one = {r["doc_id"]: (r["score"], r["held_out"]) for r in score(docs, train(docs, labels)).collect()}
    two = {r["doc_id"]: (r["score"], r["held_out"]) for r in score(strange, train(strange, other)).collect()}
    assert one == two and all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, (_, h) in one.items())


def test_kept_documents_are_those_that_score_enough(spark, docs):
    machine = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    more = docs.limit(20).unionByName(spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0), (7, "", "en", "s", 0)], docs.schema)).withColumns({"score": F.lit(1), "label": F.lit(2), "predicted": F.lit(3)})
    kept = quality.keep_good(more, machine)
    good = {r["text"] for r in docs.join(quality.score(docs, machine).where("predicted = 1"), "doc_id").collect()}
    empty = float(machine.score([quality.features("")])[0]) >= quality.THRESHOLD
    rows = kept.collect()
    assert kept.columns == more.columns and all(not r["text"] or r["text"] in good for r in rows) and sum(not r["text"] for r in rows) == 3 * empty
    assert quality.keep_good(more.limit(0), machine).count() == 0


def test_viterbi_by_enumeration():
    rng = np.random.default_rng(4)
    model = np.log(rng.dirichlet(np.ones(toxicity.SIZE), (toxicity.SIZE, toxicity.SIZE))).astype(np.float32)
    for word in ("a1", "f*k", "s$x", "b0o", "aab", "!d"):
        places = toxicity.lattice(word)
        best = None
        for path in itertools.product(*places, [(" ", 0.0)]):
            a, b, total = 0, 0, 0.0
            for letter, cost in path:
                total += cost
                if letter:
                    c = toxicity._PLACE[letter]
                    total += float(model[a, b, c])
                    a, b = b, c
            best = max(best or (total, ""), (total, "".join(x for x, _ in path).strip()))
        assert toxicity.viterbi(places, model) == best[1]


@pytest.mark.parametrize("text", ["$tupid", "you $tup!d one", "s t u p i d", "s  t  u  p  i  d", "a s t u p i d", "stu" + "p" * 60 + "id", "s.t.u.p.1.d", "st*pid", "st**id", "s_t_u_p_i_d"])
def test_disguised_words_are_restored(text):
    counts = np.zeros((toxicity.SIZE,) * 3, np.int64)
    for w in ["stupid"] * 60 + ["a", "you", "one", "the", "it"] * 30:
        c = [0, 0, *toxicity.codes(w), 0, 0]
        for x in zip(c, c[1:], c[2:]):
            counts[x] += 1
    assert "stupid" in toxicity.Restorer(toxicity.language_model(counts)).words(text)


def test_long_disguises_take_linear_time():
    own = toxicity.Restorer(toxicity.language_model(np.ones((toxicity.SIZE,) * 3, np.int64)))
    for text in ("a1" * 20_000, "b" * 200_000, "a b " * 20_000, "*" * 200_000, "x-" * 20_000):
        began = time.time()
        own.words(text)
        assert time.time() - began < 20


# --- the pipeline


def test_pipeline_by_hand(spark, docs, texts):
    """Each stage redone in plain Python on what the stage before kept; the last rows are compared."""
    rows = [r.asDict() for r in docs.collect()]
    machine = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in rows if machine.score([quality.features(r["text"] or "")])[0] >= quality.THRESHOLD]
    assert 0 < len(rows) < len(texts)
    sets = [{tuple(w.lower() for w in x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in ((r["text"] or "").split() for r in rows)]
    top = list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            x, y = find(i), find(j)
            first, second = sorted((x, y), key=lambda k: rows[k]["doc_id"])
            top[second] = first
    rows = [r for i, r in enumerate(rows) if find(i) == i]
    for r in rows:
        r["text"] = pii.redact_text(r["text"] or "")
    mixed = []
    for (i, passes, chosen, _, _), r in zip(slow_mix([(r["doc_id"], r["source"], len(WORD.findall(r["text"]))) for r in rows]), rows):
        cuts = [*[m.start() for m in WORD.finditer(r["text"])][::64], len(r["text"])]
        mixed += [(i, r["text"])] * (passes if WORD.search(r["text"]) else 0) + ([(i, "".join(r["text"][cuts[b] : cuts[b + 1]] for b in chosen))] if chosen else [])
    with open(public_tokenizers.path(bpe.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, x in mixed:
        ids = library.encode_ordinary(x)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_pipeline_edges(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id here", "en", "s", 10), (3, "same text", "en", None, 9), (3, "same text", "en", None, 9), (4, "w " * 30_000, "en", "s", 60_000)]
    for name, part in (("some", rows), ("none", [])):
        spark.createDataFrame(part, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert len({r["doc_id"] for r in got}) <= len(part) and (part or got == [])
