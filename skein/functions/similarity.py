"""Signals of name similarity, and the score that they make up."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Executors get the functions themselves, so this package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Weights of the signals, and the default threshold and length gap of fuzzy matching.
WEIGHTS = {"jaro_winkler": 0.30, "levenshtein": 0.20, "token_overlap": 0.20, "abbreviation": 0.05, "digit_match": 0.25}
FUZZY_THRESHOLD = 0.85
MAX_LENGTH_GAP = 4


def jaro(a: str, b: str) -> float:
    """Jaro similarity with half transpositions counted as fractions."""
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = list(b)
    left = []
    taken = [False] * len(b)
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and free[j] == c:
                taken[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by up to four equal first characters from 0.7 on."""
    j = jaro(a, b)
    if j < 0.7:
        return j
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return j + same * 0.1 * (1 - j)


@F.pandas_udf(DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x or "", y or "") for x, y in zip(a, b, strict=True)])


#: Once per row: Spark would evaluate it anew wherever it is referred to.
jaro_winkler_column = _jaro_winkler.asNondeterministic()


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longer)


def tokens(raw: Column) -> Column:
    """Runs of letters, or of decimal digits, in lower case."""
    return F.transform(F.regexp_extract_all(raw, F.lit(r"\p{Nd}+|\p{L}+"), F.lit(0)), F.lower)


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token lists; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def has_initial(t: Column) -> Column:
    return (F.size(t) >= 2) & F.exists(t, lambda x: F.char_length(x) == 1)


def abbreviation(a: Column, b: Column) -> Column:
    """1 if token by token the lists are equal or one is the other's initial, with one initial at least; else 0."""
    initial = lambda x, y: ((F.char_length(x) == 1) & y.startswith(x)) | ((F.char_length(y) == 1) & x.startswith(y))
    kinds = F.zip_with(a, b, lambda x, y: F.when(x == y, F.lit(0)).when(initial(x, y), F.lit(1)).otherwise(F.lit(2)))
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & ~F.array_contains(kinds, 2) & F.array_contains(kinds, 1)
    return F.when(fits, F.lit(1.0)).otherwise(F.lit(0.0))


def digits(key: Column) -> Column:
    return F.regexp_replace(key, r"[^\p{Nd}]+", "")


def digit_match(a: Column, b: Column) -> Column:
    """Agreement of the digits in two keys: 1 equal or none, 0.5 on one side only, 0 different."""
    x, y = digits(a), digits(b)
    return F.when(x == y, F.lit(1.0)).when((x == "") | (y == ""), F.lit(0.5)).otherwise(F.lit(0.0))


def composite(signals: dict[str, Column], with_tokens: Column, with_initials: Column) -> Column:
    """Weighted mean of the signals that apply.

    A signal of 0.9 or more lifts the score to 0.8 times the greatest; 1
    is the most.
    """
    w = WEIGHTS
    on = {"token_overlap": with_tokens, "abbreviation": with_initials}
    use = lambda name, x: F.when(on[name], x).otherwise(F.lit(0.0)) if name in on else x
    order = ("jaro_winkler", "levenshtein", "digit_match", "token_overlap", "abbreviation")
    total, weight, most = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for name in order:
        total = total + use(name, signals[name] * F.lit(w[name]))
        weight = weight + use(name, F.lit(w[name]))
        most = F.greatest(most, use(name, signals[name]))
    score = total / weight
    score = F.when((most >= 0.9) & (score < most * 0.8), most * 0.8).otherwise(score)
    return F.least(score, F.lit(1.0))
