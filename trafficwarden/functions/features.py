"""Twelve structural features of a query text: native column expressions, but for the two entropies,
which are found in Arrow batches. A null text gives nulls."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Special signs and keywords that are counted.
SPECIAL = "'\";#-=<>()*|%"
KEYWORDS = ["select", "union", "insert", "update", "delete", "drop", "where", "from", "and", "or", "exec", "extractvalue", "sleep", "waitfor", "benchmark", "concat", "case", "cast", "convert", "having", "group by", "order by"]


def length(text: Column) -> Column:
    return F.length(text)


def special_char_ratio(text: Column) -> Column:
    """Share of special signs; 0 for an empty text."""
    rest = F.length(F.translate(text, SPECIAL, ""))
    return F.coalesce((F.length(text) - rest) / F.nullif(F.length(text), F.lit(0)), F.when(text.isNotNull(), 0.0))


def sql_keyword_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?iU)\b(" + "|".join(KEYWORDS) + r")\b"))


#: Characters whose entropy is found at once.
_CHARACTERS = 1 << 20


def _entropies(texts: pd.Series, width: int) -> pd.Series:
    """Shannon entropy in bits of the runs of ``width`` characters of each text; null for null, 0 without runs."""
    points = [("" if t is None else t).encode("utf-32-le", "replace") for t in texts]
    lengths = np.array([len(p) >> 2 for p in points], np.int64)
    out = np.zeros(len(points))
    ends = np.cumsum(lengths)
    begin = 0
    while begin < len(points):  # rows of about _CHARACTERS together; each row is whole
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _CHARACTERS, "right")))
        codes = np.frombuffer(b"".join(points[begin:stop]), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(stop - begin), lengths[begin:stop])
        if width == 2:
            codes, inside = (codes[:-1] << 21) | codes[1:], row[1:] == row[:-1]
            codes, row = codes[inside], row[1:][inside]
        if len(codes):
            order = np.lexsort((codes, row)) if stop - begin >= 1 << 20 else None
            if order is None:  # row and codes in one number: 20 and 42 bits
                both = np.sort((row << 42) | codes)
                row = both >> 42
            else:
                row, both = row[order], codes[order]
            first = np.flatnonzero(np.append(True, (both[1:] != both[:-1]) | (row[1:] != row[:-1])))
            n = np.diff(np.append(first, len(both))).astype(float)
            total = np.bincount(row, minlength=stop - begin)
            inner = np.bincount(row[first], n * np.log2(n), stop - begin)
            some = total > 0
            out[begin:stop][some] = np.maximum(np.log2(total[some]) - inner[some] / total[some], 0.0)
        begin = stop
    return pd.Series(out).where(~texts.isna().to_numpy())


# Counts of repeated items need a map for each row, which the built-in functions build an element at a
# time; an Arrow batch sorts all characters of its rows at once.
@F.pandas_udf(T.DoubleType())
def _character_entropy(texts: pd.Series) -> pd.Series:
    return _entropies(texts, 1)


@F.pandas_udf(T.DoubleType())
def _bigram_entropy(texts: pd.Series) -> pd.Series:
    return _entropies(texts, 2)


def entropy(text: Column) -> Column:
    """Bits per character; 0 for an empty text."""
    return _character_entropy(text)


def bigram_entropy(text: Column) -> Column:
    """Bits per pair of neighbouring characters; 0 below two characters."""
    return _bigram_entropy(text)


def _odd(text: Column, sign: str) -> Column:
    return F.pmod(F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit(""))), F.lit(2))


def quote_imbalance(text: Column) -> Column:
    return (_odd(text, "'") + _odd(text, '"')).cast("double")


def paren_imbalance(text: Column) -> Column:
    return (_odd(text, "(") + _odd(text, ")")).cast("double")


def same_type_run_ratio(text: Column) -> Column:
    """Share of neighbouring characters of one class: space, digit, ASCII letter, or anything else."""
    runs = F.regexp_count(text, F.lit(r"(?U)\s+|(?-U:[0-9]+)|(?-U:[A-Za-z]+)|[^A-Za-z0-9\s]+"))
    n = F.length(text)
    return F.when(n > 1, (n - runs) / (n - 1)).when(text.isNotNull(), 0.0)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def max_token_length(text: Column) -> Column:
    return F.when(text.isNotNull(), F.coalesce(F.array_max(F.transform(tokens(text), F.length)), F.lit(0)))


def token_count(text: Column) -> Column:
    return F.when(text.isNotNull(), F.size(tokens(text)))


def _longest(text: Column, pattern: str) -> Column:
    return F.when(text.isNotNull(), F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)), F.lit(0)))


def max_special_run(text: Column) -> Column:
    return _longest(text, r"(?U)[^A-Za-z0-9\s]+")


def max_digit_run(text: Column) -> Column:
    return _longest(text, "[0-9]+")


#: New features are appended, never inserted; consumers choose by name.
FEATURES: dict[str, Callable[[Column], Column]] = {
    f.__name__: f
    for f in (length, special_char_ratio, sql_keyword_count, entropy, bigram_entropy, quote_imbalance, same_type_run_ratio, max_token_length, token_count, max_special_run, max_digit_run, paren_imbalance)
}


def with_features(df: DataFrame, text: str = "query_canonical", names: list[str] | None = None, digits: int | None = 6) -> DataFrame:
    """df with the features, rounded to so many digits; those that df has already are kept."""
    wanted = [n for n in names or FEATURES if n not in df.columns]
    value = lambda n: FEATURES[n](F.col(text))
    rounds = {"special_char_ratio", "entropy", "bigram_entropy", "same_type_run_ratio"}
    return df.withColumns({n: F.round(value(n), digits) if digits is not None and n in rounds else value(n) for n in wanted})


def feature_vector(df: DataFrame, names: list[str] | None = None, out: str = "features") -> DataFrame:
    """df with an ML vector of the named feature columns."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(names or FEATURES), outputCol=out).transform(df)


def columns_by_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def probability_columns(labels: list[str], prefix: str = "branch1_prob_") -> list[str]:
    return [prefix + x for x in labels]
