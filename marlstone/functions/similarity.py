"""ROUGE and chrF++ by their published definitions, in Arrow batches."""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens_of

ROUGE = "rouge1_f double, rouge2_f double, rougeLsum_f double, rougeLsum_p double, rougeLsum_r double"


def _prf(hit: float, predicted: float, wanted: float) -> tuple[float, float, float]:
    p, r = hit / predicted if predicted else 0.0, hit / wanted if wanted else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def _overlap(a: list[str], b: list[str], n: int) -> tuple[float, float, float]:
    """Clipped n-gram overlap of a prediction with a reference."""
    x, y = (Counter(zip(*[t[k:] for k in range(n)])) for t in (a, b))
    return _prf(sum((x & y).values()), sum(x.values()), sum(y.values()))


def _sentences(text: str) -> list[list[str]]:
    import re

    parts = re.split(r"(?<=[.!?。！？…])[\s​]+|\n+", unicodedata.normalize("NFC", text).strip())
    return [tokens_of(p) for p in parts if p.strip()]


def _common_positions(reference: list[str], candidate: list[str]) -> set[int]:
    """Positions in the reference of one longest common subsequence."""
    n, m = len(reference), len(candidate)
    if not n or not m:
        return set()
    table = np.zeros((n + 1, m + 1), dtype=np.int32)
    codes = {w: k for k, w in enumerate(dict.fromkeys(reference + candidate))}
    other = np.array([codes[w] for w in candidate])
    for i, w in enumerate(reference, 1):
        row = np.maximum(table[i - 1, 1:], np.where(other == codes[w], table[i - 1, :-1] + 1, 0))
        table[i, 1:] = np.maximum.accumulate(row)
    out, i, j = set(), n, m
    while i and j:
        if reference[i - 1] == candidate[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif table[i, j - 1] > table[i - 1, j]:
            j -= 1
        else:
            i -= 1
    return out


def rouge_of(reference: str | None, prediction: str | None) -> dict[str, float]:
    """ROUGE-1, ROUGE-2 and summary-level ROUGE-L; all zero for a blank prediction.

    For the last, each reference sentence's words that some prediction
    sentence has in common with it, in order, are united; a word counts at
    most as often as either side holds it.
    """
    names = [x.split()[0] for x in ROUGE.split(", ")]
    if not (prediction or "").strip():
        return dict.fromkeys(names, 0.0)
    wanted, given = _sentences(reference or ""), _sentences(prediction)
    a, b = [w for s in given for w in s], [w for s in wanted for w in s]
    left_a, left_b, hits = Counter(a), Counter(b), 0
    for sentence in wanted:
        union = set().union(*(_common_positions(sentence, s) for s in given)) if given else set()
        for k in sorted(union):
            if left_a[sentence[k]] > 0 and left_b[sentence[k]] > 0:
                hits += 1
                left_a[sentence[k]] -= 1
                left_b[sentence[k]] -= 1
    p, r, f = _prf(hits, len(a), len(b))
    return dict(zip(names, (_overlap(a, b, 1)[2], _overlap(a, b, 2)[2], f, p, r)))


def rouge(reference: Column, prediction: Column) -> Column:
    @F.pandas_udf(ROUGE)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rouge_of(x, y) for x, y in zip(a, b)], columns=[x.split()[0] for x in ROUGE.split(", ")])

    return run(reference, prediction)


_PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _words(text: str) -> list[str]:
    """Words with one punctuation mark at the end, or else at the beginning, taken off."""
    out: list[str] = []
    for w in text.split():
        if len(w) > 1 and w[-1] in _PUNCTUATION:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in _PUNCTUATION:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def chrf_of(reference: str | None, prediction: str | None, chars: int = 6, words: int = 2, beta: float = 2.0) -> float:
    """chrF++ of one sentence, 0 to 100: mean precision and recall over the n-gram orders that both sides have, then F-beta."""
    if not (prediction or "").strip():
        return 0.0
    sides = []
    for text in (prediction, reference or ""):
        letters, own = "".join(text.split()), _words(text)
        sides.append([Counter(letters[k : k + n] for k in range(len(letters) - n + 1)) for n in range(1, chars + 1)] + [Counter(zip(*[own[k:] for k in range(n)])) for n in range(1, words + 1)])
    p = r = orders = 0
    for x, y in zip(*sides):
        given, wanted, hit = sum(x.values()), sum(y.values()), sum((x & y).values())
        if given and wanted:
            p, r, orders = p + hit / given, r + hit / wanted, orders + 1
    if not orders or not p + r:
        return 0.0
    p, r = p / orders, r / orders
    return 100 * (1 + beta**2) * p * r / (beta**2 * p + r)


def chrf(reference: Column, prediction: Column, chars: int = 6, words: int = 2, beta: float = 2.0) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([chrf_of(x, y, chars, words, beta) for x, y in zip(a, b)], dtype=float)

    return run(reference, prediction)
