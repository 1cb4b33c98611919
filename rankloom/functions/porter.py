"""The suffix-stripping algorithm of M. F. Porter, 1980, written from the published paper."""

from __future__ import annotations

import functools
import re


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out: list[str] = []
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _cvc(word: str) -> bool:
    return len(word) >= 3 and _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _swap(word: str, rules: str, least: int) -> str:
    """The first rule "old:new" whose suffix fits; applied if the rest measures more than ``least``."""
    for rule in rules.split():
        old, new = rule.split(":")
        if word.endswith(old):
            rest = word[: len(word) - len(old)]
            return rest + new if _measure(rest) > least else word
    return word


# The suffix rules of steps 2, 3 and 4 of the paper.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic ou"


@functools.lru_cache(100_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        rest = word[:-2] if word.endswith("ed") else word[:-3] if word.endswith("ing") else None
        if rest is not None and "v" in _shape(rest):
            if rest.endswith(("at", "bl", "iz")):
                word = rest + "e"
            elif len(rest) > 1 and rest[-1] == rest[-2] and _shape(rest)[-1] == "c" and rest[-1] not in "lsz":
                word = rest[:-1]
            else:
                word = rest + "e" if _measure(rest) == 1 and _cvc(rest) else rest
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2, 0), _STEP3, 0)
    for suffix in _STEP4.split():
        if word.endswith(suffix):
            word = word[: -len(suffix)] if _measure(word[: -len(suffix)]) > 1 else word
            break
    else:
        if word.endswith(("sion", "tion")) and _measure(word[:-3]) > 1:
            word = word[:-3]
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _cvc(rest)):
            word = rest
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
