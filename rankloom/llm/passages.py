"""Substring dedup: near-duplicate passages by compact windows over token min-hashes.

Tokens are shingles of five lower-cased words. For each of HASHES hash functions, the Cartesian tree of a text's token
hashes, cut at the least passage length, gives its compact windows (l, c, r): every passage that starts in [l, c], ends
in [c, r] and is long enough has its min-hash at c. Two texts share a min-hash where their windows hold the same value.
Windows are dealt by value and sorted, so equal values pass a task as a stream; windows of equal content are linked to
the first of them only. All pairs of
different contents of a value are linked; where very many windows hold the value, they are compared at once instead,
until each is joined to all that it is alike to (``forests``), so no pair hangs on what the first text of a value holds.
Where a value is held more than once, all spans of the least length around it are grouped by their whole content, so a
passage that texts hold word for word is always found, whatever lines other texts share with it. For other near passages,
for a pair of texts, an interval join finds the places where windows of AGREE hash functions overlap by the least length;
these are verified on the texts, unless they lie in a passage that both hold word for word: some span of that length
must have a Jaccard similarity of LEAST or more. A passage that both texts hold exactly has equal min-hashes under every
hash function; near ones are found by chance.

Defined edge cases: a null text counts as empty; texts under 50 words hold no passage; null doc_ids take no part and
come back with null class and no links; rows that repeat a doc_id count as one text (the passages of any of them) and
each comes back; repeats within one text are no links; an empty table gives an empty result; further columns are not
carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import free_shuffles, map_slices, materialise, sent
from rankloom.llm.components import connected_components

SHINGLE = 5
#: Least passage in shingles: 50 words.
LENGTH = 46
HASHES, AGREE = 6, 2
LEAST = 0.8
#: How far alignments of two hash functions may differ, and how many shingles one verification reads on each side.
DRIFT, SPAN, MARGIN = 8, 192, 48
_LOW = np.uint64((1 << 22) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator, on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    words = text.encode().lower().split()
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def rolled(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` word hashes."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    own = mix(words + np.uint64(0x9E3779B97F4A7C15))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + own[k : k + len(total)]
    return mix(total)


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words."""
    return rolled(word_hashes(text), width)


def _runs(values: np.ndarray, width: int, pick: np.ufunc = np.minimum) -> list[np.ndarray]:
    """Minima (or maxima) of the runs of 1, 2, 4, ... values, up to ``width``."""
    runs = [values]
    while 2 ** len(runs) <= min(width, len(values)):
        half = 2 ** (len(runs) - 1)
        runs.append(pick(runs[-1][:-half], runs[-1][half:]))
    return runs


def _slide(runs: list[np.ndarray], width: int, pick: np.ufunc = np.minimum) -> np.ndarray:
    """Minimum (or maximum) of each run of ``width`` values, by the two longest of ``_runs`` that cover it."""
    k = width.bit_length() - 1
    n = len(runs[0]) - width + 1
    return pick(runs[k][:n], runs[k][width - 2**k :][:n])


def compact_windows(values: np.ndarray, length: int = LENGTH, sizes: np.ndarray | None = None, reach: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of every node of the Cartesian tree whose range holds at least ``length`` values.

    ``sizes`` parts the values into texts of at least ``length`` values, each with its own tree; all trees are built at
    once. With ``reach``, l and r stop that far from c: passages of the least length that hold c need length - 1 only.
    Equal values are told apart by their place in a random order, so long repeats give no more windows than other text.
    """
    n = len(values)
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    sizes = np.array([n]) if sizes is None else sizes
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    last = first + np.repeat(sizes, sizes) - 1
    at = np.arange(n)
    keys = (values & ~_LOW) | (mix((at - first).astype(np.uint64)) & _LOW)
    reach = n if reach is None else reach
    # minima of runs of 1, 2, 4, ... values tell how far the values beside c are larger
    runs = _runs(keys, max(reach, length))
    least = _slide(runs, length)
    least[at[: len(least)] + (length - 1) > last[: len(least)]] = 0  # no passage reaches over the end of a text
    padded = np.concatenate([np.zeros(length - 1, np.uint64), least, np.zeros(length - 1, np.uint64)])
    c = np.flatnonzero(_slide(_runs(padded, length, np.maximum), length, np.maximum) == keys)
    own, l, r = keys[c], c.copy(), c.copy()
    low, high = np.maximum(first[c], c - reach), np.minimum(last[c], c + reach)
    for i in range(len(runs) - 1, -1, -1):
        width = 2**i
        good = l - width >= low
        good[good] = runs[i][l[good] - width] > own[good]
        l -= width * good
        good = r + width <= high
        good[good] = runs[i][r[good] + 1] > own[good]
        r += width * good
    return l, c, r


#: c, how far l and r are from it, and the number of the hash function, in one number; above these 47 bits stand ``sides``.
WINDOWS = "h long, near int, doc_id long, place long"


def packed(c: np.ndarray, left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    return (c << 16) | (left << 10) | (right << 4) | k


#: One for each hash function.
SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def content_sums(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A polynomial's running sum over own, and what takes a difference of it back to place 0."""
    base = 0x9E3779B97F4A7C15
    power, back = (np.cumprod(np.append(np.uint64(1), np.full(len(own) - 1, x, np.uint64))) for x in (base, pow(base, -1, 1 << 64)))
    return np.append(np.uint64(0), np.cumsum(mix(own) * power, dtype=np.uint64)), back


def content_hashes(sums: tuple[np.ndarray, np.ndarray], l: np.ndarray, r: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each own[l : r + 1], wherever it lies, by own's ``content_sums``."""
    total, back = sums
    return mix((total[r + 1] - total[l]) * back[l])


#: Words of texts that are handled at once: their arrays stay in the processor's cache.
TOGETHER = 1 << 15


def together(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Shingles of several texts side by side, the places of these texts in the list, where each begins and its length.

    Texts too short for a passage are left out.
    """
    at: list[int] = []
    parts: list[np.ndarray] = []
    size = 0
    for i, x in enumerate(texts):
        own = word_hashes(x or "")
        if len(own) >= LENGTH + SHINGLE - 1:
            at.append(i)
            parts.append(own)
            size += len(own)
        if at and (size >= TOGETHER or i == len(texts) - 1):
            words = np.array([len(x) for x in parts])
            joined = rolled(np.concatenate(parts))
            sizes = words - (SHINGLE - 1)
            if len(at) > 1:
                ends = np.repeat(np.cumsum(words), words)
                joined = joined[np.arange(len(joined)) + SHINGLE <= ends[: len(joined)]]
            yield joined, np.array(at), np.cumsum(sizes) - sizes, sizes
            at, parts, size = [], [], 0


#: A span of LENGTH shingles around a core holds so many on its left, or so many on its right.
ON_LEFT = (LENGTH - 1) // 2
ON_RIGHT = LENGTH - 1 - ON_LEFT + 1


def sides(sums: tuple[np.ndarray, np.ndarray], l: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Eight bits for what the windows hold from ON_LEFT before the core on, and eight up to ON_RIGHT after it; 0: they hold less."""
    low, high = (
        np.where(inside, (content_hashes(sums, a, b) >> np.uint64(32)).astype(np.int64) % 255 + 1, 0)
        for inside, a, b in ((c - l >= ON_LEFT, np.maximum(c - ON_LEFT, l), c), (r - c >= ON_RIGHT, c, np.minimum(c + ON_RIGHT, r)))
    )
    return low << 8 | high


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each compact window: its value, a hash of its content, and its place."""
    names = [x.split()[0] for x in WINDOWS.split(", ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for own, at, first, sizes in together(batch.column(1).to_pylist()):
            first, doc, sums = np.repeat(first, sizes), np.repeat(batch.column(0).to_numpy()[at], sizes), content_sums(own)
            for k, seed in enumerate(SEEDS):
                values = mix(own ^ seed)
                l, c, r = compact_windows(values, LENGTH, sizes, LENGTH - 1)
                near = (content_hashes(sums, l, r) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                place = packed(c - first[c], c - l, r - c, k)
                if k == 0:
                    place |= sides(sums, l, c, r) << 47
                for column, part in zip(columns, (values[c].view(np.int64), near, doc[c], place)):
                    column.append(part)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names) if columns[0] else None

    return map_slices(docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), text), [key, text], WINDOWS, run)


#: Rows of one value that a task holds to put them in order; of more, each such part is put in order by itself.
HOLD = 1 << 20


def whole_groups(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[list[np.ndarray]]:
    """Columns of batches in which equal values of the first stand together, so cut that up to HOLD rows of a value come at once, or, if ``whole``, all.

    Spark sorts a single number by radix, several columns by comparison; so it sorts by the first column alone, and what
    is to be put in order within a value is done here, for the few values that occur more than once.
    """
    tail: list[np.ndarray] | None = None
    for batch in batches:
        own = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
        if tail is not None:
            own = [np.concatenate([x, y]) for x, y in zip(tail, own)]
        if not len(own[0]):
            continue
        other = np.flatnonzero(own[0] != own[0][-1])
        at = int(other[-1]) + 1 if len(other) else 0
        if not whole and len(own[0]) - at > HOLD:
            at = len(own[0])
        if at:
            yield [x[:at] for x in own]
        tail = [x[at:] for x in own]
    if tail is not None and len(tail[0]):
        yield tail


def _several(h: np.ndarray, known: int | None) -> np.ndarray:
    """Places of values that stand beside an equal one or are the known one."""
    same = np.zeros(len(h), bool)
    same[1:] |= h[1:] == h[:-1]
    same[:-1] |= h[1:] == h[:-1]
    if known is not None:
        same |= h == known
    return np.flatnonzero(same)


#: code: how far lo and hi are from ca, and the number of the hash function. Rows without b are windows to look up, rows
#: without cb are windows to compare with the others of their value, which is in b. Bit 3 of code (SAME): a's window of
#: the first hash function is b's, word for word.
LINKS = "a long, b long, ca int, cb int, code int"
SAME = 8


#: Windows of one value of which all pairs are linked; of more, all contents are compared in ``forests``.
FULL = 8


def links(found: DataFrame) -> DataFrame:
    """Each window with the first of its content; for values that FULL windows or fewer hold, all pairs of other contents.

    lo and hi bound the passages, in places of text a, for which both texts have this min-hash. Rows without b are the
    windows of the first hash function whose value is held more than once. Rows without cb are the windows of the first two
    texts of each content, for values that more than FULL windows hold.
    """
    names = [x.split()[0] for x in LINKS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # first row of the last value, first row of its last content
        for h, near, doc, place in whole_groups(batches):
            some, value = _several(h, None if held is None else held[0][0]), h[-1]
            some = some[np.lexsort((place[some], doc[some], near[some], h[some]))]
            if not len(some):
                continue
            h, near, doc, place = (x[some] for x in (h, near, doc, place))
            old = 0
            if held is not None and (h == held[0][0]).any():
                # a value of more than HOLD rows goes on; it is the only one of this part that may
                h, near, doc, place = (np.concatenate([x, y]) for x, y in zip(held, (h, near, doc, place)))
                front = np.flatnonzero(h == h[0])
                back = np.flatnonzero(h != h[0])
                h, near, doc, place = (x[np.concatenate([front, back])] for x in (h, near, doc, place))
                old = 2
            n = len(h)
            new = np.append(True, h[1:] != h[:-1])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, n))
            several = (np.repeat(sizes, sizes) > FULL) | (np.arange(n) < old)
            part = np.append(True, new[1:] | (near[1:] != near[:-1]))
            group, close = starts[np.cumsum(new) - 1], np.flatnonzero(part)[np.cumsum(part) - 1]
            fresh = np.arange(n) >= old
            final = np.flatnonzero(h == value)[-1:]
            held = tuple(x[[group[final[0]], close[final[0]]]] for x in (h, near, doc, place)) if len(final) else None
            i = np.flatnonzero(fresh & (doc != doc[close]))
            at = close[i]
            same = ((place[i] & 0xF) == 0) & ((place[i] & 0xFFFF) == (place[at] & 0xFFFF)) & (place[i] >> 47 == place[at] >> 47) & (doc[i] > doc[at])
            for step in range(1, FULL):
                rows = np.flatnonzero(~several & (np.arange(n) - group >= step))
                rows = rows[(close[rows] != close[rows - step]) & (close[rows] != rows - step) & (doc[rows] != doc[rows - step])]
                i, at = np.append(i, rows), np.append(at, rows - step)
            same = np.append(same, np.zeros(len(i) - len(same), bool))
            # the larger id comes first, so that links of all hash functions are of one direction
            flip = doc[i] < doc[at]
            x, y = np.where(flip, at, i), np.where(flip, i, at)
            left = np.minimum((place[x] >> 10) & 63, (place[y] >> 10) & 63)
            right = np.minimum((place[x] >> 4) & 63, (place[y] >> 4) & 63)
            long = left + right + 1 >= LENGTH
            x, y, left, right, same = x[long], y[long], left[long], right[long], same[long]
            # a window shares a whole span with another only if it is alike to it on one side of the core; of a value that
            # may go on in another part not all are here
            side, ask = (place >> 47) & 0xFFFF, (h == value) | ((group == 0) & (old > 0))
            for own in (side >> 8, side & 255):
                _, of, count = np.unique(group << 8 | own, return_inverse=True, return_counts=True)
                ask |= (count[of] > 1) & ((own > 0) | (side == 0))
            core_of = (place >> 16) & 0x7FFFFFFF
            one = np.flatnonzero(fresh & ((place & 15) == 0) & ask)
            c, reach = core_of[one], place[one] & 0xFFF0
            # a content's second text stands for it where its first text holds the other content too
            mixed = np.repeat((np.add.reduceat(part, starts, dtype=np.int64) > 1) | (sizes > HOLD), sizes) | (h == h[0]) & (old > 0)
            second = np.append(False, (close[1:] == close[:-1]) & (doc[:-1] == doc[close[1:]])) & (doc != doc[close]) & mixed
            own = np.flatnonzero(fresh & several & ((close == np.arange(n)) | second))
            core, kind = core_of[own], np.repeat([0, 1, 2], [len(x), len(one), len(own)])
            columns = [
                np.concatenate([doc[x], doc[one], doc[own]]), pa.array(np.concatenate([doc[y], doc[one], h[own]]), mask=kind == 1),
                np.concatenate([core_of[x], c, core]), pa.array(np.concatenate([core_of[y], c, core]).astype(np.int32), mask=kind == 2),
                np.concatenate([(left << 10) | (right << 4) | (place[x] & 15) | SAME * same, reach, place[own] & 0xFFFF]),
            ]
            if len(kind):
                yield pa.RecordBatch.from_arrays([z if isinstance(z, pa.Array) else pa.array(z.astype(t.to_pandas_dtype()), t) for z, t in zip(columns, kinds)], names)

    return found.repartition("h").sortWithinPartitions("h").mapInArrow(run, LINKS)


def once(texts: DataFrame) -> DataFrame:
    """Texts (doc_id, text) with rows that repeat both taken once; only ids that occur more than once are looked at."""
    again = texts.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.limit(1).count():
        return texts
    return texts.join(again, "doc_id", "left_anti").unionByName(texts.join(again, "doc_id", "left_semi").distinct())


def _asked(texts: DataFrame, asks: DataFrame, schema: str, fn) -> DataFrame:
    """``fn(own, first, size, doc_id, s, n)`` for the shingles of several texts, side by side, and their asks (doc_id, s, n).

    first and size tell, for each ask, where the shingles of its text are; it gives columns.
    """
    asks = materialise(asks, "asks")
    lists = asks.groupBy("doc_id").agg(F.collect_list(F.struct("s", "n")).alias("asks"))
    # texts that nothing is asked of needn't be shuffled, as long as the ids of the others are few enough to be sent
    texts = texts.join(sent(materialise(asks.select("doc_id").distinct(), "ids")), "doc_id", "left_semi")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = batch.column(2)
        edges, flat = rows.offsets.to_numpy(), rows.flatten()
        s, n = (flat.field(i).to_numpy() for i in range(2))
        edges, ids, made = edges - edges[0], batch.column(0).to_numpy(), []
        for own, at, first, sizes in together(batch.column(1).to_pylist()):
            count = np.diff(edges)[at]
            part = np.arange(count.sum()) + np.repeat(edges[at] - (np.cumsum(count) - count), count)
            made.append(fn(own, *(np.repeat(x, count) for x in (first, sizes, ids[at])), s[part], n[part]))
        if not made:
            return None
        return pa.RecordBatch.from_arrays([pa.array(sum(x, []), pa.binary()) if isinstance(x[0], list) else pa.array(np.concatenate(x)) for x in zip(*made)], names)

    return map_slices(texts.join(lists, "doc_id"), ["doc_id", "text", "asks"], schema, run)


def spans(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(h, doc_id, s): a hash of the whole of each span of LENGTH shingles around a looked-up window.

    A window that is linked to one of another text, word for word, is left out: what else holds its spans meets them there.
    """

    def made(own: np.ndarray, first: np.ndarray, size: np.ndarray, doc_id: np.ndarray, c: np.ndarray, code: np.ndarray):
        # of rows that repeat an id, several may have a window at this place
        place, known = (first + c) << 16 | (code & 0xFFF0), (code & SAME) > 0
        _, of = np.unique(place, return_inverse=True)
        left = (np.bincount(of[~known], minlength=len(of)) > np.bincount(of[known], minlength=len(of)))[of] & ~known
        of = np.zeros(len(own), np.int64)
        of[first] = np.arange(len(first))
        whose, ids = first, doc_id
        first, size, c, code = (x[left] for x in (first, size, c, code))
        # and another row may be shorter
        low, high = (np.clip(x, 0, size - LENGTH + 1) for x in (c - ((code >> 10) & 63), np.minimum(c, c + ((code >> 4) & 63) - LENGTH + 1) + 1))
        step = np.zeros(len(own) + 1, np.int64)
        np.add.at(step, first + low, 1)
        np.add.at(step, first + high, -1)
        starts = np.flatnonzero(np.cumsum(step[:-1]) > 0)
        at = np.maximum.accumulate(of)[starts]
        return content_hashes(content_sums(own), starts, starts + LENGTH - 1).view(np.int64), ids[at], (starts - whose[at]).astype(np.int32)

    return _asked(texts, found.where(f"b is null or (cb is not null and code & {SAME} > 0)").select(F.col("a").alias("doc_id"), F.col("ca").alias("s"), F.col("code").alias("n")), "h long, doc_id long, s int", made)


def cuts(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, s, n, cut): the shingles that the places of near passages ask for, equal requests once."""
    side = lambda d, s: places.select(F.col(d).alias("doc_id"), F.col(s).alias("s"), "n")

    def made(own: np.ndarray, first: np.ndarray, size: np.ndarray, doc_id: np.ndarray, start: np.ndarray, n: np.ndarray):
        short, ends = own.astype(np.uint32), first + np.minimum(start.astype(np.int64) + n + 2 * DRIFT, size)
        return doc_id, start, n, [short[p:q].tobytes() for p, q in zip((first + start).tolist(), ends.tolist())]

    return _asked(texts, side("a", "sa").unionByName(side("b", "sb")).distinct(), "doc_id long, s int, n int, cut binary", made)


def same_spans(spans: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """(a, b, start, end, other) of passages that two texts hold word for word, for spans (h, doc_id, s).

    Each span of LENGTH shingles has its least value at one window, so texts that hold the same span all have that window.
    Spans are grouped by a hash of the whole of them, and each is linked to the first text of its group: however many
    texts share a line, a span's partner has all of its words. Links one place further on are then joined to passages,
    with those of ``linked`` (a, b, s, shift, n), which are n spans each.
    """

    names = ["a", "b", "s", "shift", "n"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the first span of the value that the part before ended with
        for h, doc, s in whole_groups(batches):
            some, value = _several(h, None if last is None else last[0]), h[-1]
            some = some[np.lexsort((s[some], doc[some], h[some]))]
            if not len(some):
                continue
            h, doc, s = (x[some] for x in (h, doc, s))
            new = np.append(True, h[1:] != h[:-1])
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            b, t = doc[first], s[first]
            if last is not None:  # a value of more than HOLD rows goes on
                b, t = np.where(h == last[0], last[1], b), np.where(h == last[0], last[2], t)
            final = np.flatnonzero(h == value)[-1:]
            last = (value, b[final[0]], t[final[0]]) if len(final) else None
            pick = np.flatnonzero(doc != b)
            if len(pick):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[pick], b[pick], s[pick], (s[pick] - t[pick]).astype(np.int32), np.ones(len(pick), np.int32))], names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, s, shift, n in whole_groups(batches):
            order = np.lexsort((s, shift, b, a))
            a, b, s, shift, n = (x[order] for x in (a, b, s, shift, n))
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (shift[1:] != shift[:-1]))
            # the last span so far, of the same two texts and shift
            reach = (np.maximum.accumulate((np.cumsum(new) << 32) + s + n - 1) & 0xFFFFFFFF).astype(np.int32)
            new[1:] |= s[1:] > reach[:-1] + 1
            at = np.flatnonzero(new)
            ends = reach[np.append(at[1:], len(s)) - 1] + np.int32(LENGTH + SHINGLE - 1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[at], b[at], s[at], ends, s[at] - shift[at])], ["a", "b", "start", "end", "other"])

    joined = spans.repartition("h").sortWithinPartitions("h").mapInArrow(join, "a long, b long, s int, shift int, n int")
    if linked is not None:
        joined = joined.unionByName(linked)
    return joined.repartition("a").sortWithinPartitions("a").mapInArrow(merge, "a long, b long, start int, end int, other int")


#: Windows of one value that are compared in one go; of more, one for each pair of blocks.
BLOCK = 1 << 14
#: Windows of one value of which all pairs of runs under the cores are compared at once.
SMALL = 256
#: Windows of small values that are compared together.
AT_ONCE = 1 << 10


def _best(member: np.ndarray) -> np.ndarray:
    """(rows, runs): the number of true places of each run of LENGTH."""
    total = np.zeros((len(member), member.shape[1] + 1), np.int16)
    np.cumsum(member, axis=1, dtype=np.int16, out=total[:, 1:])
    return total[:, LENGTH:] - total[:, :-LENGTH]


def _needed(sizes: np.ndarray) -> np.ndarray:
    """How many values two runs share at least if they are alike, for the sum of their numbers of distinct values."""
    return np.ceil(sizes * (LEAST / (1 + LEAST)) - 1e-9).astype(np.int16)


def window_forest(doc: np.ndarray, c: np.ndarray, code: np.ndarray, cuts: list[bytes], group: np.ndarray | None = None) -> list[tuple[int, int, int, int, int]]:
    """(a, b, start, end, other) of alike passages that join what any alike windows of one value, of different texts, join.

    ``group`` numbers the values, equal ones side by side, so that many small ones are compared at once. A window whose
    runs hold too few values that other texts' windows hold too can't be alike to any, so a line that very many texts
    share costs a count. Of the others, those of values that at most SMALL windows hold are joined by all pairs of runs
    that stand alike under the cores; what that leaves apart, and the windows of larger values, each that is reached is
    compared with all that are not reached yet.
    """
    left, right, out = (code >> 10) & 63, (code >> 4) & 63, []
    sizes, width = left + right + 1, 2 * LENGTH - 1
    group = np.zeros(len(doc), np.int64) if group is None else np.cumsum(np.append(0, group[1:] != group[:-1]))
    row = np.repeat(np.arange(len(doc)), sizes)
    values, ids = np.unique((group[row].astype(np.uint64) << np.uint64(32)) | np.frombuffer(b"".join(cuts), np.uint32), return_inverse=True)
    at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes - (LENGTH - 1 - left), sizes)
    grid = np.full((len(doc), width), len(values), np.int32)  # cores stand in one column, ends are filled
    grid[row, at] = ids
    # a value counts in the runs that hold its place and no place of it before that
    before = _before(row * len(values) + ids)
    repeats = np.zeros(len(doc), bool)
    repeats[row[before >= 0]] = True
    low = np.zeros((len(doc) if repeats.any() else 0, width), np.int64)
    if len(low):
        low[row, at] = np.maximum(at - LENGTH, np.where(before >= 0, at[before], -1)) + 1

    def counts(member: np.ndarray, own: np.ndarray) -> np.ndarray:
        """How many distinct values each run of the windows holds at the true places."""
        total = _best(member)
        some = np.flatnonzero(repeats[own])
        if len(some):
            step = np.bincount((np.arange(len(some))[:, None] * (width + 1) + low[own[some]])[member[some]], minlength=len(some) * (width + 1)).reshape(len(some), -1)
            step[:, 1:] -= member[some]
            total[some] = step.cumsum(axis=1)[:, :LENGTH]
        return total

    run = np.arange(LENGTH)
    distinct = np.where((run >= LENGTH - 1 - left[:, None]) & (run <= right[:, None]), counts(grid < len(values), np.arange(len(doc))), 9 * LENGTH)
    least = distinct.min(axis=1)
    single = least == LENGTH
    text = np.unique(np.stack([group, doc]), axis=1, return_inverse=True)[1].reshape(-1)
    free, own, holder = np.zeros(len(doc), bool), np.arange(len(doc)), np.zeros(len(values) + 1, np.int64)
    while len(own):  # the values of which a window went are looked at again
        starts = np.flatnonzero(np.append(True, group[own][1:] != group[own][:-1]))
        bound = np.repeat(np.minimum.reduceat(least[own], starts), np.diff(np.append(starts, len(own))))
        part = grid[own]
        holder[part] = text[own][:, None]
        shared = np.zeros(len(values) + 1, bool)
        shared[part[holder[part] != text[own][:, None]]] = True  # some text holds it beside the last that does
        shared[-1] = False
        good = (counts(shared[part], own) >= _needed(distinct[own] + bound[:, None])).any(axis=1)
        still = np.logical_and.reduceat(good, starts)[np.cumsum(np.isin(np.arange(len(own)), starts)) - 1]
        free[own[still]] = True
        own = own[good & ~still]

    def hits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The runs of windows x and y that stand alike under the cores: equal ones, or else such as share enough."""
        same = _best((grid[x] == grid[y]) & (grid[x] < len(values)))
        whole = same >= LENGTH
        return np.where(whole.any(axis=1)[:, None], whole, (same >= _needed(np.array(2 * LENGTH))) & (single[x] & single[y])[:, None])

    def linked(x: np.ndarray, y: np.ndarray, hit: np.ndarray) -> None:
        a, b = np.where(doc[x] > doc[y], x, y), np.where(doc[x] > doc[y], y, x)
        first, last = hit.argmax(axis=1) - (LENGTH - 1), (LENGTH - 1) - hit[:, ::-1].argmax(axis=1) - (LENGTH - 1)
        out.extend(zip(doc[a].tolist(), doc[b].tolist(), (c[a] + first).tolist(), (c[a] + last + LENGTH + SHINGLE - 1).tolist(), (c[b] + first).tolist()))

    def sure(x: int, rest: np.ndarray) -> np.ndarray:
        """Which of the windows have a run that is alike to one of x."""
        good = np.zeros(len(rest), bool)
        for k in range(0, len(rest), 128):
            some = rest[k : k + 128]
            member = (grid[some][:, :, None] == grid[x]).any(axis=1) & (grid[x] < len(values))
            good[k : k + 128] = (counts(member, np.full(len(some), x)) >= _needed(distinct[x] + least[some][:, None])).any(axis=1)
        return good

    def near(x: int, y: int) -> bool:
        a, b = (x, y) if doc[x] > doc[y] else (y, x)
        span = verify(*(np.frombuffer(cuts[i], np.uint32) for i in (a, b)))
        if span:
            out.append((int(doc[a]), int(doc[b]), int(c[a] - left[a] + span[0]), int(c[a] - left[a] + span[1]) + SHINGLE - 1, int(c[b] - left[b] + span[2])))
        return bool(span)

    mark = np.zeros(len(values) + 1, bool)

    def reached(x: int, rest: np.ndarray) -> np.ndarray:
        """Those of the windows whose runs hold as many values of x as alike ones do."""
        mark[grid[x]], mark[-1] = True, False
        rest = rest[(counts(mark[grid[rest]], rest) >= _needed(distinct[rest] + least[x])).any(axis=1)]
        mark[grid[x]] = False
        return rest

    own = np.flatnonzero(free)
    starts = np.flatnonzero(np.append(True, group[own][1:] != group[own][:-1])) if len(own) else own
    held = np.diff(np.append(starts, len(own)))
    small = held <= SMALL
    # all pairs of the small values, and which of them stand alike
    place = np.repeat(small, held).nonzero()[0]
    after = np.repeat(starts + held, held)[place] - place - 1
    one, two, runs = [], [], []
    for k in _chunks(after, 1 << 12):
        x = np.repeat(place[k], after[k])
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(after[k]) - after[k], after[k])
        x, y = own[x], own[y]
        equal = ((grid[x] == grid[y]) & (grid[x] < len(values))).sum(axis=1, dtype=np.int16)
        some = (equal >= _needed(np.array(2 * LENGTH))) & (text[x] != text[y])
        x, y = x[some], y[some]
        hit = hits(x, y)
        some = hit.any(axis=1)
        one.append(x[some]), two.append(y[some]), runs.append(hit[some])
    label = np.arange(len(doc))
    if one:
        x, y, hit = (np.concatenate(z) for z in (one, two, runs))
        label, used = _spanning(x, y, len(doc))
        linked(x[used], y[used], hit[used])
    for start, n, few in zip(starts.tolist(), held.tolist(), small.tolist()):
        part = own[start : start + n]
        if few:
            # windows outside the largest class are compared with all of other classes, each pair once
            _, tag, total = np.unique(label[part], return_inverse=True, return_counts=True)
            alone = np.flatnonzero(tag != total.argmax())
            if not len(alone):
                continue
            flat, low_id = grid[part], int(grid[part].min())
            true = flat < len(values)
            bits = np.zeros((n, 64 * ((int(flat[true].max()) - low_id) // 64 + 1)), bool)
            bits[np.nonzero(true)[0], flat[true] - low_id] = True
            bits = np.packbits(bits, axis=1).view(np.uint64)
            both = np.stack([np.bitwise_count(bits[k] & bits).sum(axis=1, dtype=np.int16) for k in alone])
            able = both >= _needed(least[part][alone][:, None] + least[part])
            able &= (tag[alone][:, None] != tag) & (text[part][alone][:, None] != text[part])
            able[:, alone] &= np.arange(len(alone)) > np.arange(len(alone))[:, None]
            for x, row_able in zip(part[alone][able.any(axis=1)].tolist(), able[able.any(axis=1)]):
                rest = part[row_able]
                rest = rest[label[rest] != label[x]]
                if len(rest):
                    rest = reached(x, rest)
                for y in rest[sure(x, rest)].tolist():
                    if label[y] != label[x] and near(x, y):
                        label[part[label[part] == label[y]]] = label[x]
            continue
        for root in part:
            if not free[root]:
                continue
            free[root], todo = False, [root]
            while todo:
                x = todo.pop()
                rest = part[free[part] & (text[part] != text[x])]
                if not len(rest):
                    continue
                rest = reached(x, rest)
                # runs that stand alike under the cores need no more; for others all runs are compared
                hit = hits(np.full(len(rest), x), rest)
                clear = hit.any(axis=1)
                linked(np.full(clear.sum(), x), rest[clear], hit[clear])
                other = rest[~clear]
                other = [y for y in other[sure(x, other)].tolist() if near(x, y)]
                todo += [*rest[clear].tolist(), *other]
                free[todo] = False
    return out


def _chunks(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Parts of sizes whose sum is at most ``most``, or single ones."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def _spanning(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least number of each class of 0 .. n - 1 that the edges join, and the places of edges that are a spanning forest."""
    label, used, live = np.arange(n), [], np.arange(len(x))
    while len(live):
        u, v = label[x[live]], label[y[live]]
        live, u, v = live[u != v], u[u != v], v[u != v]
        # each class hangs on a smaller one by one edge
        top, at = np.unique(np.maximum(u, v), return_index=True)
        used.append(live[at])
        label_of = np.arange(n)
        label_of[top] = np.minimum(u, v)[at]
        while (label_of[label_of] != label_of).any():
            label_of = label_of[label_of]
        label = label_of[label]
    return label, np.concatenate([*used, live])


def forests(texts: DataFrame, hot: DataFrame) -> DataFrame:
    """(a, b, start, end, other) of near passages around windows (doc_id, c, code) of values h that more than FULL windows hold.

    The windows of a value that are more than BLOCK are parted, and each pair of blocks is compared.
    """
    sizes = materialise(hot.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y"), "sizes")
    asks = hot.join(sizes.select("h"), "h", "left_semi").select("doc_id", F.col("c").alias("s"), F.col("code").alias("n"))

    def made(own: np.ndarray, first: np.ndarray, size: np.ndarray, doc_id: np.ndarray, c: np.ndarray, code: np.ndarray):
        left, right = (code >> 10) & 63, (code >> 4) & 63
        good = (c >= left) & (c + right < size)  # of rows that repeat an id, another may be shorter
        first, doc_id, c, code, left, right = (x[good] for x in (first, doc_id, c, code, left, right))
        short, at = own.astype(np.uint32), first + c
        cut = [short[p:q].tobytes() for p, q in zip((at - left).tolist(), (at + right + 1).tolist())]
        return mix(own[at] ^ SEEDS[code & 15]).view(np.int64), doc_id, c, code, cut

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["a", "b", "start", "end", "other"], [pa.int64(), pa.int64(), *[pa.int32()] * 3]
        tail: list = [np.zeros(0, np.int64) for _ in range(6)] + [[]]

        def found(own: list) -> Iterator[pa.RecordBatch]:
            h, doc, c, code, i, j, cuts = own
            new = np.append(True, (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
            starts = np.append(np.flatnonzero(new), len(h))
            for part in _chunks(np.diff(starts), AT_ONCE):
                a, b = starts[part.start], starts[part.stop]
                out = window_forest(doc[a:b], c[a:b], code[a:b], cuts[a:b], np.cumsum(new[a:b])) if b - a > 1 else []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            own = [np.append(x, batch.column(k).to_numpy().astype(np.int64)) for x, k in zip(tail, (0, 1, 2, 3, 5, 6))]
            own.append(tail[6] + batch.column(4).to_pylist())
            other = np.flatnonzero((own[0] != own[0][-1]) | (own[4] != own[4][-1]) | (own[5] != own[5][-1]))
            at = int(other[-1]) + 1 if len(other) else 0
            if at:
                yield from found([x[:at] for x in own])
            tail = [x[at:] for x in own]
        if len(tail[0]):
            yield from found(tail)

    rows = _asked(texts, asks, "h long, doc_id long, c int, code int, cut binary", made)
    large = sizes.where(F.col("n") > BLOCK).select("h", F.ceil(F.col("n") / BLOCK).cast("int").alias("g"))
    own, blocks = F.pmod(F.xxhash64("doc_id", "c"), F.col("g")).cast("int"), F.coalesce("g", F.lit(1))
    rows = rows.join(F.broadcast(large), "h", "left").withColumn("g", blocks).withColumn("p", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    cells = rows.select("h", "doc_id", "c", "code", "cut", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"))
    return cells.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(join, "a long, b long, start int, end int, other int")


def candidates(rows: list[tuple]) -> list[tuple[int, int, int, int, int]]:
    """Places to verify, (start in a, start in b, length, first core, last core), of one pair's links (k, ca, cb, lo, hi).

    Links are taken in groups along text a; a group is a place if AGREE hash functions have windows that overlap by the
    least length and are aligned alike.
    """
    out, group = [], []

    def close() -> None:
        if len({x[0] for x in group}) < AGREE:
            return
        for i, (_, ca, cb, lo, hi) in enumerate(group):
            agree = {k for k, a, b, l, h in group if abs((a - b) - (ca - cb)) <= DRIFT and min(h, hi) - max(l, lo) + 1 >= LENGTH}
            if len(agree) >= AGREE:
                start = max(group[0][1] - MARGIN, ca - cb, 0)
                out.append((start, start - (ca - cb), group[-1][1] + MARGIN - start + 1, group[0][1], group[-1][1]))
                return

    for row in sorted(rows, key=lambda x: (x[1], x[2], x[0])):
        if group and (row[1] - group[-1][1] > MARGIN or row[1] - group[0][1] > SPAN or abs((row[1] - row[2]) - (group[0][1] - group[0][2])) > 4 * DRIFT):
            close()
            group = []
        group.append(row)
    close()
    return out


def _before(values: np.ndarray) -> np.ndarray:
    """The last place before each at which the same value is, or -1."""
    order = np.argsort(values, kind="stable")
    out = np.full(len(values), -1)
    again = values[order[1:]] == values[order[:-1]]
    out[order[1:][again]] = order[:-1][again]
    return out


def _distinct(values: np.ndarray) -> np.ndarray:
    """The number of distinct values of each run of LENGTH: each counts where its first place in the run is."""
    at = np.arange(len(values))
    step = np.zeros(len(values) + 1, np.int64)
    np.add.at(step, np.maximum(at - LENGTH, _before(values)) + 1, 1)
    np.add.at(step, at + 1, -1)
    return np.cumsum(step)[: len(values) - LENGTH + 1]


def _single(values: np.ndarray) -> bool:
    """Whether no value occurs twice."""
    own = np.sort(values)
    return bool((own[1:] != own[:-1]).all())


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(runs of a, runs of b): how many distinct values each two runs of LENGTH share.

    A shared value counts at its first place in either run, so each pair of equal values adds to a rectangle of runs.
    """
    if _single(a) and _single(b):
        _, p, q = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        top, left = np.maximum(p - LENGTH, -1) + 1, np.maximum(q - LENGTH, -1) + 1
    else:
        p, q = np.nonzero(a[:, None] == b[None, :])
        top, left = np.maximum(p - LENGTH, _before(a)[p]) + 1, np.maximum(q - LENGTH, _before(b)[q]) + 1
    width = len(b) + 1
    plus, minus = (np.bincount(np.concatenate([i * width + j, k * width + m]), minlength=(len(a) + 1) * width) for i, j, k, m in ((top, left, p + 1, q + 1), (p + 1, left, top, q + 1)))
    grid = (plus - minus).astype(np.int16).reshape(-1, width)  # no sum is above LENGTH
    part = grid[: len(a) - LENGTH + 1, : len(b) - LENGTH + 1]
    return part.cumsum(axis=0, dtype=np.int16).cumsum(axis=1, dtype=np.int16)


def verify(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int] | None:
    """The part of a, [start, end) in shingles, that is made of spans of LENGTH with Jaccard LEAST or more to b's.

    The third number is where its first span is in b. Every span of a is compared with every span of b.
    """
    n = min(len(a), len(b))
    if n < LENGTH:
        return None
    single = _single(a)
    n_a = np.full(len(a) - LENGTH + 1, LENGTH) if single else _distinct(a)
    # no two spans can be alike if the texts share fewer values than the least that any two must
    if len(np.intersect1d(a, b, assume_unique=single and _single(b))) < LEAST * n_a.min():
        return None
    same = np.concatenate([[0], np.cumsum(a[:n] == b[:n])])
    whole = np.flatnonzero(same[LENGTH:] - same[:-LENGTH] >= LENGTH)
    if len(whole):
        return int(whole[0]), int(whole[-1]) + LENGTH, int(whole[0])
    both = common(a, b)
    n_b = np.full(len(b) - LENGTH + 1, LENGTH) if _single(b) else _distinct(b)
    # both >= LEAST (n_a + n_b - both), in whole numbers
    least = np.ceil(np.arange(2 * LENGTH + 1) * (LEAST / (1 + LEAST)) - 1e-9).astype(np.int16)
    alike = both >= (least[2 * LENGTH] if n_a.min() + n_b.min() == 2 * LENGTH else least[n_a[:, None] + n_b[None, :]])
    hits = np.flatnonzero(alike.any(axis=1))
    return (int(hits[0]), int(hits[-1]) + LENGTH, int(alike[hits[0]].argmax())) if len(hits) else None


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, start, end, other): verified passages of text a, in words, and where they start in text b; stored."""
    texts = once(docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")))
    found = materialise(links(windows(texts)), "links")
    pairs = found.where("b is not null and cb is not null")
    names = ["a", "b", "sa", "sb", "n", "c0", "c1"]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, ca, cb, code in whole_groups(batches, whole=True):
            order = np.lexsort((code & 7, b, a))
            a, b, k = a[order], b[order], code[order] & 7
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            starts = np.flatnonzero(new)
            # fewer hash functions than must agree give no place
            several = np.add.reduceat(np.append(True, k[1:] != k[:-1]) | new, starts, dtype=np.int64) >= AGREE
            out = []
            for p, q in zip(starts[several].tolist(), np.append(starts[1:], len(a))[several].tolist()):
                at = order[p:q]
                own = zip(k[p:q].tolist(), ca[at].tolist(), cb[at].tolist(), (ca[at] - (code[at] >> 10)).tolist(), (ca[at] + ((code[at] >> 4) & 63)).tolist())
                out += [(int(a[p]), int(b[p]), *x) for x in candidates(list(own))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)

    places = materialise(pairs.repartition("a", "b").sortWithinPartitions("a").mapInArrow(choose, "a long, b long, sa int, sb int, n int, c0 int, c1 int"), "places")
    free_shuffles(docs.sparkSession)
    reach = [F.expr(x).cast("int").alias(y) for x, y in (("ca - (code >> 10)", "s"), ("ca - cb", "shift"), (f"(code >> 10) + ((code >> 4) & 63) + 2 - {LENGTH}", "n"))]
    linked = found.where(f"b is not null and cb is not null and code & {SAME} > 0").select("a", "b", *reach)
    exact = materialise(same_spans(spans(texts, found), linked), "exact")
    # a place whose cores lie in a passage that both texts hold word for word, aligned alike, is verified by it
    whole = exact.select(F.col("a").alias("ea"), F.col("b").alias("eb"), (F.col("start") - F.col("other")).alias("shift"), "start", "end")
    inside = (F.col("a") == F.col("ea")) & (F.col("b") == F.col("eb")) & (F.col("sa") - F.col("sb") == F.col("shift")) & (F.col("start") <= F.col("c0")) & (F.col("c1") + SHINGLE <= F.col("end"))
    free_shuffles(docs.sparkSession)
    rest = materialise(places.join(whole, inside, "left_anti"), "rest")
    held = materialise(cuts(texts, rest), "cuts")
    free_shuffles(docs.sparkSession)
    left = held.select(F.col("doc_id").alias("a"), F.col("s").alias("sa"), "n", F.col("cut").alias("x"))
    right = held.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"), "n", F.col("cut").alias("y"))
    both = rest.join(left, ["a", "sa", "n"]).join(right, ["b", "sb", "n"])

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for a, b, sa, sb, n, x, y in zip(*(batch.column(i).to_pylist() for i in range(7))):
            span = verify(np.frombuffer(x, np.uint32)[: n + DRIFT], np.frombuffer(y, np.uint32))
            if span:
                out.append((a, b, sa + span[0], sa + span[1] + SHINGLE - 1, sb + span[2]))
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, kinds)], ["a", "b", "start", "end", "other"])

    near = materialise(map_slices(both, ["a", "b", "sa", "sb", "n", "x", "y"], "a long, b long, start int, end int, other int", check), "near")
    free_shuffles(docs.sparkSession)
    hot = found.where("b is not null and cb is null").select(F.col("b").alias("h"), F.col("a").alias("doc_id"), F.col("ca").alias("c"), "code")
    others = materialise(forests(texts, hot), "forests")
    free_shuffles(docs.sparkSession)
    return near.unionByName(exact).unionByName(others)


def passage_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, spans) for each row: class_id is the smallest doc_id joined to it by shared passages.

    n_links counts the texts it was verified with, spans lists its repeated words as start:end, merged; a text without
    repeated passages is its own class.
    """
    passages = repeated_passages(docs, key, text)
    roots = connected_components(passages.select(F.col("a").alias("u"), F.col("b").alias("v")))
    ends = passages.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(passages.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    counts = ends.groupBy("x").agg(F.count("*").alias("n_links"))
    step = "if(size(m) > 0 and s.start <= element_at(m, -1).end, concat(slice(m, 1, size(m) - 1), array(named_struct('start', element_at(m, -1).start, 'end', greatest(element_at(m, -1).end, s.end)))), concat(m, array(s)))"
    merged = f"aggregate(array_sort(collect_set(struct(start, end))), cast(array() as array<struct<start: int, end: int>>), (m, s) -> {step})"
    both = passages.select("a", "start", "end").unionByName(passages.select(F.col("b").alias("a"), F.col("other").alias("start"), (F.col("other") + F.col("end") - F.col("start")).alias("end")))
    spans = both.groupBy("a").agg(F.expr(merged).alias("m")).select("a", F.expr("array_join(transform(m, s -> concat(s.start, ':', s.end)), ',')").alias("spans"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"))
    out = rows.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(counts.withColumnRenamed("x", "doc_id"), "doc_id", "left").join(spans.withColumnRenamed("a", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("spans", F.lit("")).alias("spans"))


def op1(spark, sf_dir: str) -> DataFrame:
    return passage_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
