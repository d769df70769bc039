"""Similarity functions over vectors, token bags and words."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once and not at each place or each step where body names it."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, failed: float = 0.0) -> Column:
    """Cosine of two vectors; 0 if one is zero, `failed` for null or unequal lengths."""
    n = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)), failed).otherwise(F.when(n == 0, 0.0).otherwise(dot(a, b) / n))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def keyword_dice(a: Column, b: Column) -> Column:
    """Share of token positions of both keywords that also occur in the other."""
    x, y = F.split(a, " "), F.split(b, " ")
    shared = F.size(F.filter(x, lambda t: F.array_contains(y, t))) + F.size(F.filter(y, lambda t: F.array_contains(x, t)))
    return shared / (F.size(x) + F.size(y))


def best_of(values: Column) -> Column:
    return F.array_max(values)


def average(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def _pairwise(f: Callable[[str, str], float]):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        return pd.Series([None if x is None or y is None else known.setdefault((x, y), f(x, y)) for x, y in zip(a, b)], dtype="float64")

    return run


def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _close(term: str, word: str) -> float:
    m = SequenceMatcher(None, term, word)
    return m.ratio() if m.real_quick_ratio() >= 0.6 and m.quick_ratio() >= 0.6 else 0.0


def _letters(values: list[str], slots: int = 64) -> np.ndarray:
    """Counts of characters, dealt over slots by their codes, one row per string."""
    coded = [v.encode("utf-32-le", "surrogatepass") for v in values]
    at = np.repeat(np.arange(len(values)), [len(c) // 4 for c in coded])
    codes = np.frombuffer(b"".join(coded), dtype="uint32") % slots
    return np.bincount(at * slots + codes, minlength=len(values) * slots).reshape(-1, slots)


def close_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratios of pairs, 0 below 0.6; only pairs with enough characters in common, which bounds the ratio, are matched."""
    out = np.full(len(a), np.nan)
    both = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    x, y = a.iloc[both].tolist(), b.iloc[both].tolist()
    m, n = _letters(x), _letters(y)
    out[both] = 0.0
    known: dict[tuple[str, str], float] = {}
    for i in np.flatnonzero(2.0 * np.minimum(m, n).sum(axis=1) >= 0.6 * (m.sum(axis=1) + n.sum(axis=1)) - 1e-6):
        pair = (x[i], y[i])
        if pair not in known:
            known[pair] = _close(*pair)
        out[both[i]] = known[pair]
    return pd.Series(out)  # NaN where a string is null, which Arrow takes as null


def _fuzzy(a: str, b: str, threshold: float = 0.8) -> float:
    x, y = a.split(" "), b.split(" ")
    hits = [(i, j) for i, s in enumerate(x) for j, t in enumerate(y) if _ratio(s, t) >= threshold]
    return (len({i for i, _ in hits}) + len({j for _, j in hits})) / (len(x) + len(y))


def word_ratio() -> Callable[[Column, Column], Column]:
    """Ratcliff-Obershelp ratio of (term word, entity word): no built-in gives it, so an Arrow function does."""
    return _pairwise(_ratio)


def close_ratio() -> Callable[[Column, Column], Column]:
    """The same ratio of whole terms, 0 where cheap upper bounds rule out 0.6."""
    return F.pandas_udf(close_ratios, "double")


def fuzzy_terms() -> Callable[[Column, Column], Column]:
    """Share of words of both terms that have a match of ratio 0.8 or more in the other."""
    return _pairwise(_fuzzy)


def length_bound(a: Column, b: Column, least: float = 0.6) -> Column:
    """True wherever the ratio can reach `least`: 2 * min / (sum of lengths) bounds it."""
    return 2 * F.least(F.length(a), F.length(b)) >= F.lit(least) * (F.length(a) + F.length(b))
