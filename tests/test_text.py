import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.functions.porter import stem
from rankloom.operators import rewrite


@pytest.mark.parametrize(
    "word, expected",
    [("caresses", "caress"), ("ponies", "poni"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("causes", "caus"), ("nightmares", "nightmar"), ("electrical", "electr"), ("adjustment", "adjust"), ("controlling", "control"), ("sky", "sky")],
)
def test_stem(word, expected):
    assert stem(word) == expected


def terms(spark, text, profile):
    return spark.createDataFrame([(text,)], "x string").select(T.tokens(F.col("x"), profile)).first()[0]


def test_tokens_keep_compounds_and_negations(spark):
    clinical = T.PROFILES["clinical_trials"]
    assert terms(spark, "HER2-positive 64-year-old took 5 mg/kg/day", clinical) == ["her2-positive", "64-year-old", "took", "5", "mg/kg/day"]
    assert terms(spark, "She can’t stop, he won't <b>go</b> http://x.y/z", T.Profile()) == ["not", "stop", "not", "go"]


def test_null_and_empty_text(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",)], "x string")
    assert [r[0] for r in df.select(T.tokens(F.col("x"), T.Profile())).collect()] == [[], [], []]


def test_spelling(spark):
    vocab = spark.createDataFrame([("diabetes", 50), ("insulin", 40), ("treatment", 60)], "term string, freq long")
    queries = spark.createDataFrame([(1, "diabtes inslin tretment BRAF V600E")], "query_id int, query string")
    assert rewrite.correct_queries(queries, vocab).first()["query"] == "diabetes insulin treatment BRAF V600E"


def test_agent(spark):
    rows = [("quora", "short one"), ("quora", "a longer question than that"), ("clinical_trials", "x"), ("other", "x"), ("quora", "ما هو")]
    df = spark.createDataFrame(rows, "d string, q string").select(rewrite.chosen_model(F.col("d"), F.col("q")))
    assert [r[0] for r in df.collect()] == ["hybrid_serial", "embedding", "bm25", "bm25", "embedding"]


def test_texts_that_repair_leaves_alone_stay_in_the_jvm():
    """Whatever the pattern doesn't match is its own compatibility form, alone and in any order."""
    plain = re.compile(T.TOUCHED)
    rest = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and not plain.match(chr(c))]
    assert len(rest) > 400 and all(not unicodedata.combining(c) for c in rest)
    assert T.repair("".join(rest)) == "".join(rest) and T.repair("".join(reversed(rest))) == "".join(reversed(rest))


def test_repair(spark):
    texts = ["cafÃ© â€œquotedâ€\x9d", "ﬁne Ｆｕｌｌ １２", "a &amp; b", "a < b &amp; c", "é", "plain Ünï", None, "", "x\x00y﻿"]
    want = ["café “quoted”", "fine Full 12", "a & b", "a < b &amp; c", "é", "plain Ünï", None, "", "xy"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.repaired(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in rows] == want
