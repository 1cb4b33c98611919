"""The queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import ann, bpe, media, mixing, passages, pii, quality, simhash, tokenbin, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": passages.op1,
    "op2_media_columns": media.op2,
    "op3_byte_bpe": bpe.op3,
    "op4_quality": quality.op4,
    "op5_token_planes": tokenbin.op5,
    "op6_nearest_neighbours": ann.op6,
    "op7_personal_data": pii.op7,
    "op8_simhash": simhash.op8,
    "op9_source_mix": mixing.op9,
    "op10_toxicity": toxicity.op10,
}

#: Hashes, trees, machines and tokenizers have no counterpart in SQL: these are tested against brute force, round trips and held-out labels.
ORACLE_SQL: dict[str, str] = {}
