"""Personal data with offset-preserving deobfuscation.

Plain detectors find e-mail addresses, IP addresses, card and phone numbers in the text as it stands. Where a text
holds a sign of disguise, transducers rewrite it: homoglyphs and full-width forms to ASCII, zero-width characters to
nothing, spelled digits in a row to digits, and at/dot in words or brackets to "@" and ".". Every output character
carries the span of source characters that it came from, so what the detectors find in the rewritten text maps back to
the source. Such a span is added if it overlaps no plain span.

Defined edge cases: a null text counts as empty and has no spans; texts of any length are read whole, in time linear
in the text; repeated rows give equal results; an empty table gives an empty result; further columns are not carried by
``detect`` and are kept as they are by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import map_slices

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As the leftmost matches of the address pattern: the local part is all that can stand before an "@" that a domain follows."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            free = found.end()
            out.append((start, free))
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


def plain(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    found = [("email", *s) for s in emails(text)] if "@" in text else []
    found += [("ip", *s) for s in ips(text)]
    found += [("card", *s) for s in cards(text)]
    found += [("phone", *s) for s in phones(text)] if "+" in text else []
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


# Letters of other scripts that look like ASCII ones.
_LOOK_ALIKE = dict(zip("авеѕіјкмнорстухАВЕЅІЈКМНОРСТУХαοορικυνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abesijkmhopctyxABESIJKMHOPCTYXaoopikuvABEZHIKMNOPTYX"))
_ZERO_WIDTH = frozenset("​‌‍⁠﻿­")
_NUMBERS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_STRANGE = re.compile("[" + "".join(_LOOK_ALIKE) + "".join(_ZERO_WIDTH) + "！-～\U0001d400-\U0001d7ff․。²³¹⁰-₉①-⑨]")
_AT = r"\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+|\s+@\s*|\s*@\s+"
_DOT = r"\s*[\[({<]\s*(?:dot|punkt|point|punto|\.)\s*[\])}>]\s*|\s+(?:dot|punkt|point|punto)\s+|\s+\.\s+"
_NAME = r"[A-Za-z0-9_%+-]+"
#: An address in disguise: names joined by dots, an at, and a domain with at least one dot, any of them disguised.
#: No match starts inside a name: what follows a name doesn't hang on where it starts, so a start there only costs time.
_ADDRESS = re.compile(rf"(?<![A-Za-z0-9_%+-])({_NAME}(?:(?:{_DOT}|\.){_NAME}){{0,8}})({_AT}|@)([A-Za-z0-9-]+(?:(?:{_DOT}|\.)[A-Za-z0-9-]+){{1,8}})", re.I)
_DOTS = re.compile(_DOT, re.I)
_SPELLED = re.compile(r"(?<![A-Za-z])(?:plus[\s-]+)?(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|[0-9])(?:[\s,.-]+(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|dot|point|[0-9]))+(?![A-Za-z])", re.I)
_DIGIT_WORD = re.compile(r"\b(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)\b", re.I)
_BRACKETED = re.compile(r"[\[({<]\s*(?:at|@|dot|punkt|point|punto|\.)\s*[\])}>]", re.I)
_LOOSE_AT = re.compile(r"\s@|@\s")
_DOT_WORDS = frozenset(("dot", "punkt", "point", "punto"))
_DIGIT_WORDS = frozenset(_NUMBERS)


Mapped = tuple[str, list[tuple[int, int]]]


def _characters(text: str) -> Mapped:
    """Homoglyphs, compatibility forms and zero-width characters, one character at a time."""
    out, spans = [], []
    for i, c in enumerate(text):
        if c in _ZERO_WIDTH:
            continue
        new = c if c < "\x80" else _LOOK_ALIKE.get(c) or ("." if c in "․。" else c if not _STRANGE.match(c) else unicodedata.normalize("NFKC", c))
        out.append(new)
        spans += [(i, i + 1)] * len(new)
    return "".join(out), spans


def _rewrite(mapped: Mapped, pattern: re.Pattern, new: "callable") -> Mapped:
    """Replace matches; new(match) gives pieces (text, start, end) that stand for parts of the match."""
    text, spans = mapped
    out, marks, at = [], [], 0
    for m in pattern.finditer(text):
        pieces = new(m)
        if pieces is None:
            continue
        out.append(text[at : m.start()])
        marks += spans[at : m.start()]
        for piece, start, end in pieces:
            out.append(piece)
            marks += spans[start:end] if len(piece) == end - start else [(spans[start][0], spans[end - 1][1])] * len(piece)
        at = m.end()
    out.append(text[at:])
    marks += spans[at:]
    return "".join(out), marks


def _spelled(m: re.Match) -> list | None:
    """Digits in words, at least four of them, as digits; plus as +; separators between digits go, dots stay."""
    text, start, pieces = m[0], m.start(), []
    if len(_DIGIT_WORD.findall(text)) < 4:
        return None
    for t in re.finditer(r"[A-Za-z]+|[0-9]|\.", text):
        word = t[0].lower()
        new = "+" if word == "plus" else "." if word in ("dot", "point", ".") else _NUMBERS.get(word, word)
        pieces.append((new, start + t.start(), start + t.end()))
    return pieces


def _address(m: re.Match) -> list | None:
    """The parts of an address; a dot in words is needed beside an at in words, so that plain prose stays."""
    name, at, domain = m[1], m[2], m[3]
    if at == "@" and not _DOTS.search(name) and not _DOTS.search(domain):
        return None
    bare = at.strip().lower() == "at"
    if bare and not _DOTS.search(domain):
        return None
    pieces = []
    for k, part in ((1, name), (3, domain)):
        base, last = m.start(k), 0
        if k == 3:
            pieces.append(("@", m.start(2), m.end(2)))
        for d in _DOTS.finditer(part):
            if d.start() > last:
                pieces.append((part[last : d.start()], base + last, base + d.start()))
            pieces.append((".", base + d.start(), base + d.end()))
            last = d.end()
        if last < len(part):
            pieces.append((part[last:], base + last, base + len(part)))
    return pieces


def _signs(text: str) -> tuple[bool, bool]:
    """Whether digits may be spelled, and whether an address may be disguised."""
    words = set(text.lower().replace("-", " ").replace(",", " ").replace(".", " ").split())
    dots = not words.isdisjoint(_DOT_WORDS) or "@" in text and bool(_LOOSE_AT.search(text))
    return len(words & _DIGIT_WORDS) > 0, dots or any(c in text for c in "[({<") and bool(_BRACKETED.search(text))


def normalised(text: str) -> Mapped | None:
    """The rewritten text with the source span of each of its characters; None if nothing looks disguised."""
    strange = not text.isascii() and bool(_STRANGE.search(text))
    mapped = _characters(text) if strange else (text, None)
    digits, dots = _signs(mapped[0])
    if not (strange or digits or dots):
        return None
    if mapped[1] is None:
        mapped = text, [(i, i + 1) for i in range(len(text))]
    if digits:
        mapped = _rewrite(mapped, _SPELLED, _spelled)
    if dots:
        mapped = _rewrite(mapped, _ADDRESS, _address)
    return None if mapped[0] == text else mapped


def detect_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(plain spans, all spans), each sorted by start, then kind."""
    base = plain(text)
    mapped = normalised(text)
    if mapped is None:
        return base, base
    # plain spans, overlapping ones joined: starts and ends both ascend
    starts, ends, more = [], [], []
    for _, s, e in base:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for kind, start, end in plain(mapped[0]):
        source = (mapped[1][start][0], mapped[1][end - 1][1])
        if bisect_left(starts, source[1]) == bisect_right(ends, source[0]):
            more.append((kind, *source))
    return base, sorted({*base, *more}, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): the counts and the digest are of plain spans."""
    names = [key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for x in batch.column(1).to_pylist():
            base, every = detect_spans(x or "")
            kinds = [k for k, _, _ in base]
            rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(every), len(every) - len(base)))
        types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows), types))], names)

    return map_slices(df, [key, text], f"{key} {dict(df.dtypes)[key]}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", run)


def redact_text(text: str) -> str:
    """The text with each span, overlapping ones joined, replaced by the kind of its first, as in "[EMAIL]"."""
    out, at, merged = [], 0, []
    for kind, start, end in detect_spans(text)[1]:
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with personal data in the text replaced; n_chars, if there is one, follows."""
    names = df.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = names.index(text)
        new = pa.array([None if x is None else redact_text(x) for x in batch.column(at).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([new if i == at else batch.column(i) for i in range(len(names))], names)

    out = map_slices(df, names, ", ".join(f"`{c}` {t}" for c, t in df.dtypes), run)
    return out.withColumn("n_chars", F.length(text).cast(dict(df.dtypes)["n_chars"])) if "n_chars" in names else out


def op7(spark, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
