"""Column functions: scaling, kernels, vectors and text helpers of the inventory (NUM, ARR, STR)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def number(text: Column, fill: float = 0.0) -> Column:
    """NUM01: text as a number, `fill` where it is none."""
    return F.coalesce(text.try_cast("double"), F.lit(fill))


def blend(first: Column, second: Column, w1: float, w2: float) -> Column:
    """NUM03: weighted mean with the weights normalised."""
    return first * (w1 / (w1 + w2)) + second * (w2 / (w1 + w2))


def freeman_tukey(x: Column) -> Column:
    """NUM05; zeros become one."""
    return F.sqrt(x) + F.sqrt(x + 1)


def clip(x: Column, low: float, high: float) -> Column:
    """NUM19"""
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column, centre: Column, slope: Column) -> Column:
    """NUM13: logistic gate."""
    return 1 / (1 + F.exp(-slope * (x - centre)))


def saturation(x: Column, tau: Column) -> Column:
    """NUM09: x / (x + tau); an infinite tau gives zero."""
    return F.when(tau.isNull(), F.lit(0.0)).otherwise(x / (x + tau))


def translation_efficiency(bound: Column, other: Column, eps: float = 1e-6) -> Column:
    """NUM08: bound / (other + eps); `other` is the total, or bound plus free."""
    return bound / (other + eps)


def filter_gain(kind: str, lam: Column, largest: Column, t: float = 1.0, order: int = 2, centre: float = 0.5, width: float = 0.2) -> Column:
    """NUM21: graph filter g(lambda), before division by its maximum."""
    x = lam / largest
    gains = {
        "heat": F.exp(-t * lam),
        "tikhonov": 1 / (1 + t * lam),
        "exponential": F.exp(-t * x),
        "wavelet": x * F.exp(1 - x),
        "bandpass": F.exp(-F.pow((x - centre) / width, 2)),
        "ideal": F.when(x <= centre, 1.0).otherwise(0.0),
        "butterworth": 1 / F.sqrt(1 + F.pow(x / centre, 2 * order)),
    }
    if kind not in gains:
        raise ValueError(f"no filter {kind!r}; there are {sorted(gains)}")
    return gains[kind]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """ARR06"""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    """ARR06"""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def l2_normalised(a: Column, eps: float = 1e-6) -> Column:
    """ARR01, NUM15: every element over (norm + eps)."""
    length = norm(a) + eps
    return F.transform(a, lambda x: x / length)


def min_max(x: Column, *keys: str) -> Column:
    """NUM02: scaled to [0, 1] over all rows or within keys; a constant gives 0.

    Without keys use expression.scaled(), which aggregates instead of sorting all rows in one task.
    """
    w = W.partitionBy(*keys)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high > low, (x - low) / (high - low)).otherwise(0.0)


def clean_name(s: Column) -> Column:
    """STR01: without a byte-order mark in front, trimmed."""
    return F.trim(F.regexp_replace(s, "^\\uFEFF", ""))


def without_suffix(s: Column) -> Column:
    """STR02: without _ntRNA or _rbRNA."""
    return F.regexp_replace(s, "_(nt|rb)RNA$", "")


def file_name(s: Column) -> Column:
    """STR03"""
    return F.regexp_replace(s, "[^A-Za-z0-9_.-]+", "_")


def first_integer(s: Column) -> Column:
    """STR05, SRT05: the first run of digits; null where there is none."""
    return F.nullif(F.regexp_extract(s, r"(\d+)", 1), F.lit("")).try_cast("long")
