"""Text normalisation and tokenisation as Column expressions; Python only where Spark has no builtin (NFKC, stemming)."""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from rankloom.functions.porter import stem

TOKEN = r"[\p{L}\p{N}]+(?:[./:+\-][\p{L}\p{N}]+)*"
URL = r"https?://\S+|www\.\S+"
TAG = r"<[^>]+>"
NEGATIONS = ("no", "not", "nor", "never", "neither", "without")
# English function words. Another list is a parameter of the profile.
STOP_WORDS = (
    "a about above across after again against all almost alone along already also although always am among an and another any "
    "anyhow anyone anything anyway are around as at be became because become been before behind being below beside besides between "
    "beyond both but by can cannot could do done down during each either else elsewhere enough etc even ever every everyone "
    "everything everywhere except few for former from further had has have he hence her here hers herself him himself his how "
    "however i if in indeed into is it its itself last least less many may me meanwhile might mine more moreover most mostly much "
    "must my myself next nobody none nor not nothing now of off often on once one only onto or other others our ours out over own "
    "per perhaps rather same several she should since so some someone something still such than that the their them then there "
    "therefore these they this those though through thus to together too toward under until up upon us very was we were what when "
    "where whether which while who whom whose why will with within without would yet you your yours"
).split()


@dataclass(frozen=True)
class Profile:
    """How a data set's text is cut into terms."""

    stem: bool = True
    least: int = 2
    stop_words: tuple = tuple(w for w in STOP_WORDS if w not in NEGATIONS)


#: Profiles by data set; other keys, null and blank ones get the default.
PROFILES = {"sample_dataset": Profile(), "quora": Profile(), "clinical_trials": Profile(stem=False, least=1)}


def profile_of(dataset: str | None) -> Profile:
    return PROFILES.get((dataset or "").strip().lower() or "sample_dataset", Profile())


#: What repair may change: anything but these ranges of plain letters, digits and signs; few ranges, as each is tried for each
#: character. "&" and the letters that broken UTF-8 begins with are not among them.
TOUCHED = r"[^\t\n\r -%'-~\u00a1-\u00a7\u00a9\u00ab\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u00c1\u00c4-\u00e1\u00e3-\u00ef\u00f1-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0391-\u03c9\u0400-\u045f\u2013\u2014\u2018-\u201e\u20ac]"
#: The same for Java, whose tables tell plain ASCII at once while it tries range after range for others: only these are tried.
_TOUCHED_JAVA = rf"[^\t\n\r -%'-~](?<={TOUCHED})"
_BROKEN = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]{1,3}")
_CONTROLS = re.compile("[\x00-\x08\x0b\x0e-\x1f\x7f-\x9f\ufeff\ufffd]")


def _reread(m: re.Match) -> str:
    """Characters that are UTF-8 read as Windows-1252 (or Latin-1) read anew; others stay."""
    raw = b""
    for c in m[0]:
        try:
            raw += c.encode("cp1252")
        except UnicodeEncodeError:
            if ord(c) > 0xFF:
                return m[0]
            raw += bytes([ord(c)])
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return m[0]


def repair(text: str) -> str:
    """Broken encodings and HTML entities mended, control characters out, compatibility forms folded (NFKC)."""
    if "&" in text and "<" not in text:
        text = html.unescape(text)
    return unicodedata.normalize("NFKC", _CONTROLS.sub("", _BROKEN.sub(_reread, text)))


@F.pandas_udf(StringType())
def _repair(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else repair(x))


def repaired(text: Column) -> Column:
    """The text after ``repair``; only texts that it may change go to Python, the others stay in the JVM."""
    return F.coalesce(_repair(F.when(text.rlike(_TOUCHED_JAVA), text)), text)


def normalise(text: Column) -> Column:
    """Quotes and dashes folded, negations spelled out, lower-cased, URLs, tags and underscores blanked, white space collapsed.

    The text is to be ``repaired`` first where it may hold broken encodings or compatibility forms.
    """
    x = F.translate(F.coalesce(text, F.lit("")), "’‘–—−", "''---")
    x = F.regexp_replace(x, r"(?i)\bwon't\b", "will not")
    x = F.regexp_replace(x, r"(?i)\bcan't\b", "can not")
    x = F.lower(F.regexp_replace(x, r"(?i)n't\b", " not"))
    x = F.regexp_replace(F.regexp_replace(x, URL, " "), TAG, " ")
    return F.trim(F.regexp_replace(F.translate(x, "_", " "), r"\s+", " "))


def tokens(text: Column, profile: Profile) -> Column:
    """Terms of a text before stemming: runs of letters and digits, long enough and no stop words."""
    found = F.regexp_extract_all(normalise(text), F.lit(TOKEN), F.lit(0))
    stop = profile.stop_words or ("",)
    if profile.least <= 1:  # each match holds a letter or digit
        return F.filter(found, lambda t: ~t.isin(*stop))
    return F.filter(found, lambda t: (F.length(F.translate(t, "./:+-", "")) >= profile.least) & ~t.isin(*stop))


_TOUCHED = re.compile(TOUCHED)
_WONT, _CANT, _NT = (re.compile(x, re.ASCII | re.IGNORECASE) for x in (r"\bwon't\b", r"\bcan't\b", r"n't\b"))
_URL, _TAG = re.compile(URL, re.ASCII), re.compile(TAG)
#: TOKEN in the words of ``re``, for texts without underscores: its alphanumeric characters are those of the categories L and N.
_TOKEN = re.compile(r"\w+(?:[./:+\-]\w+)*")
_SIGNS = str.maketrans("", "", "./:+-")


@cache
def _stop(profile: Profile) -> frozenset[str]:
    return frozenset(profile.stop_words)


def cut(text: str | None, profile: Profile) -> list[str]:
    """The terms of ``tokens(repaired(text))``, in one pass over a text; steps that find nothing to do are left out."""
    if not text:
        return []
    if _TOUCHED.search(text):
        text = repair(text)
    if not text.isascii():
        for old, new in zip("’‘–—−", "''---"):
            text = text.replace(old, new)
    if "'t" in text or "'T" in text:
        text = _NT.sub(" not", _CANT.sub("can not", _WONT.sub("will not", text)))
    text = text.lower()
    if "http" in text or "www." in text:
        text = _URL.sub(" ", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = text.replace("_", " ")
    stop, found = _stop(profile), _TOKEN.findall(text)
    if profile.least <= 1:
        return [t for t in found if t not in stop]
    return [t for t in found if t not in stop and len(t.translate(_SIGNS)) >= profile.least]


def terms(text: Column, profile: Profile) -> Column:
    """``tokens(repaired(text))`` for whole tables of texts: Java's expressions take many times the time of ``cut``."""

    @F.arrow_udf(ArrayType(StringType()))
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([cut(x, profile) for x in texts.to_pylist()], pa.list_(pa.string()))

    return made(text)


@F.pandas_udf(StringType())
def stemmed(words: pd.Series) -> pd.Series:
    return words.map(lambda w: stem(w) if w and w.isalpha() else w)


def stem_terms(counts: DataFrame) -> DataFrame:
    """Replace column term by its stem; each distinct term is stemmed once."""
    table = counts.select("term").distinct().withColumn("stem", stemmed("term"))
    return counts.join(table, "term").drop("term").withColumnRenamed("stem", "term")


def snippet(text: Column, size: int = 250) -> Column:
    return F.substring(text, 1, size)


def sentences(text: Column) -> Column:
    """Sentences of the text with white space collapsed; the whole text if nothing parts it."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.filter(F.split(flat, r"(?<=[.!?])\s+"), lambda s: s != "")


def sentence_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def content_words(text: Column) -> Column:
    """Distinct lower-case ASCII words of two letters or more that are no stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)))


def surface_words(text: Column) -> Column:
    """Lower-case ASCII words of three letters or more, repeats included."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 3)


def is_arabic(text: Column) -> Column:
    return F.coalesce(text.rlike("[\\u0600-\\u06FF]"), F.lit(False))


def clean_text(text: Column) -> Column:
    """No-break spaces and carriage returns folded, ends trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), " ", " "), "\r\n?", "\n"))


def tsv_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(clean_text(text), r"[\t\n]+", " "))
