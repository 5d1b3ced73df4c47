"""Tails and quantiles of test statistics as columns: the one thing about a test that no built-in expression gives.

They run on aggregates (one row a test), in Arrow functions over the distributions of ``functions.stats``. A null
argument or an undefined value gives null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from phrasemill.functions import stats


def _tail(function: Callable[..., float | None], *columns: str | Column) -> Column:
    """``function`` of numeric columns, row by row."""

    @F.pandas_udf("double")
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([None if any(math.isnan(v) for v in r) else function(*r) for r in rows.itertuples(index=False, name=None)], dtype="float64")

    return run(F.struct(*[(F.col(c) if isinstance(c, str) else c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))


def mann_whitney_p(u: str, n1: str, n2: str, ties: str) -> Column:
    return _tail(lambda u, a, b, t: stats.mann_whitney_p(u, int(a), int(b), t), u, n1, n2, ties)


def wilcoxon_p(w: str, n: str, ties: str) -> Column:
    return _tail(lambda w, n, t: stats.wilcoxon_p(w, int(n), t), w, n, ties)


def chi2_p(statistic: str | Column, df: str | Column) -> Column:
    return _tail(lambda x, k: stats.chi2_sf(x, int(k)), statistic, df)


def t_p(t: str | Column, df: str | Column) -> Column:
    """Two-sided."""
    return _tail(lambda t, k: min(1.0, 2 * stats.t_sf(abs(t), k)), t, df)


def f_p(f: str | Column, df1: str | Column, df2: str | Column) -> Column:
    return _tail(stats.f_sf, f, df1, df2)


def normal_p(z: str | Column) -> Column:
    """Two-sided."""
    return _tail(lambda z: min(1.0, 2 * stats.norm_sf(abs(z))), z)


def t_quantile(df: str | Column, level: float = stats.LEVEL) -> Column:
    return _tail(lambda k: stats.t_ppf((1 + level) / 2, k) if k > 0 else None, df)


def exact_p(statistic: Callable[[list, list], float | None], x: str, y: str) -> Column:
    """p of a correlation over all orders of a few systems, from arrays of at most ``EXACT_SYSTEMS`` values."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else statistic(list(a), list(b)) for a, b in zip(x, y, strict=True)], dtype="float64")

    return run(x, y)
