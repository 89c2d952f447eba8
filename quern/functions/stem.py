"""Porter's suffix stripping (1980), applied to distinct words and joined back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEP2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble".split()
_STEP3 = "icate ic ative - alize al iciti ic ical ic ful - ness -".split()
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(stem: str) -> str:
    """The stem as runs of consonants (C) and vowels (V)."""
    out: list[str] = []
    for k, c in enumerate(stem):
        vowel = c in "aeiou" or (c == "y" and k > 0 and out[-1] == "C")
        out.append("V" if vowel else "C")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("V+C+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem).endswith("CVC") and stem[-1] not in "wxy"


def porter(word: str) -> str:
    """The stem of a lower-case word."""
    w = word
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and "V" in _shape(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "V" in _shape(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and _shape(cut)[-1] == "C" and cut[-1] not in "lsz":
            w = cut[:-1]
        else:
            w = cut + "e" if _measure(cut) == 1 and _short(cut) else cut
    if w.endswith("y") and "V" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, new in sorted(zip(table[::2], table[1::2]), key=lambda p: -len(p[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new.replace("-", "")
                break
    for end in sorted(_STEP4, key=lambda e: -len(e)):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def with_stems(toks: DataFrame, column: str = "word") -> DataFrame:
    """toks with `stem`; each distinct word is stemmed once, in Arrow batches, and joined back."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["stem"] = [porter(w) for w in part[column]]
            yield part

    stems = toks.select(column).distinct().mapInPandas(run, f"{column} string, stem string")
    return toks.join(stems, column)


def stem_column():
    """The same as a vectorised function of a column, for small inputs."""

    @F.pandas_udf("string")
    def stem(words: pd.Series) -> pd.Series:
        return words.map(porter)

    return stem
