"""Resampling as aggregates: no group has to fit into one task.

Values are counted first. In a replicate of the Poisson bootstrap a value that n rows share weighs as a Poisson
variable of mean n, which for large samples is Efron's bootstrap and needs no group size beforehand; in a replicate of
the sign-flip test the n differences of one size add up to that size times a binomial surplus. The draws of a value are
seeded by the value, so equal data give equal results however rows are dealt to tasks. Every task sums its
values' draws, ``RESAMPLES`` numbers a group, and the partial sums are added up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.functions.stats import LEVEL, LIMIT_N, MIN_N, RESAMPLES
from phrasemill.operators import tails

Draw = Callable[[np.random.Generator, int, int], np.ndarray]


def _poisson(rng: np.random.Generator, n: int, size: int) -> np.ndarray:
    return rng.poisson(n, size)


def _surplus(rng: np.random.Generator, n: int, size: int) -> np.ndarray:
    """Heads less tails of n coins."""
    return 2 * rng.binomial(n, 0.5, size) - n


def _replicates(df: DataFrame, value: str | Column, by: Sequence[str], draw: Draw, resamples: int) -> DataFrame:
    """``by, r, w, wx``: the weights and weighted values of each replicate summed; replicate 0 is what was observed."""
    counted = df.select(*by, (F.col(value) if isinstance(value, str) else value).cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")
    counted = counted.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n")).withColumn("__seed", F.xxhash64("__v"))
    keys = list(by)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            groups = batch.groupby(keys, dropna=False, sort=False) if keys else [((), batch)]
            for key, rows in groups:
                w, wx = np.zeros(resamples + 1), np.zeros(resamples + 1)
                for v, n, seed in zip(rows["__v"], rows["__n"], rows["__seed"], strict=True):
                    drawn = draw(np.random.Generator(np.random.PCG64(int(seed) & (2**63 - 1))), int(n), resamples)
                    w[0], w[1:] = w[0] + n, w[1:] + drawn
                    wx[0], wx[1:] = wx[0] + n * v, wx[1:] + drawn * v
                yield pd.DataFrame([[*key, w, wx]], columns=[*keys, "w", "wx"])

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "w array<double>", "wx array<double>"])
    parts = counted.mapInPandas(sums, schema).select(*keys, F.posexplode(F.arrays_zip("w", "wx")).alias("r", "z"))
    return parts.groupBy(*keys, "r").agg(F.sum("z.w").alias("w"), F.sum("z.wx").alias("wx"))


def _summary(replicates: DataFrame, by: Sequence[str], m: Column, n: Column, level: float, resamples: int) -> DataFrame:
    """``by, n, mean, p, lo, hi`` of replicate means: percentile interval, and p of the distribution moved to zero."""
    rows = replicates.withColumn("m", m)
    ends = F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))
    drawn = F.when(F.col("r") > 0, F.col("m"))
    out = rows.groupBy(*by).agg(
        F.max(F.when(F.col("r") == 0, n)).alias("n"), F.max(F.when(F.col("r") == 0, F.col("m"))).alias("mean"), F.percentile(drawn, ends).alias("ends"), F.collect_list(drawn).alias("all")
    )  # resamples + 1 numbers a group
    far = F.size(F.filter("all", lambda x: F.abs(x - F.col("mean")) >= F.abs("mean") - 1e-12))
    enough = F.col("n") >= MIN_N
    return out.select(
        *by, F.col("n").cast("long").alias("n"), "mean", F.when(enough, (far + 1) / F.lit(resamples + 1.0)).alias("p"),
        F.when(F.col("n") > 1, F.col("ends")[0]).alias("lo"), F.when(F.col("n") > 1, F.col("ends")[1]).alias("hi"),
    )


def bootstrap(df: DataFrame, value: str | Column, by: Sequence[str] = (), level: float = LEVEL, resamples: int = RESAMPLES) -> DataFrame:
    """``by, n, mean, p, lo, hi``: mean, p of a zero mean and interval. Null and NaN values are left out."""
    return _summary(_replicates(df, value, by, _poisson, resamples), by, F.try_divide("wx", "w"), F.col("w"), level, resamples)


def paired_bootstrap(pairs: DataFrame, by: Sequence[str] = (), level: float = LEVEL, resamples: int = RESAMPLES) -> DataFrame:
    """``bootstrap`` of the differences of ``pairs(x, y)``: documents are drawn, both scores together."""
    return bootstrap(pairs, F.col("x") - F.col("y"), by, level, resamples)


def two_sample_bootstrap(df: DataFrame, value: str, group: str, by: Sequence[str] = (), level: float = LEVEL, resamples: int = RESAMPLES) -> DataFrame:
    """``by, n1, n2, mean, p, lo, hi`` of the difference of the means of a boolean group; from ``LIMIT_N`` rows a side p is the normal limit."""
    sides = _replicates(df.where(F.col(group).isNotNull()), value, [*by, group], _poisson, resamples)
    one, two = F.col(group), ~F.col(group)
    both = sides.groupBy(*by, "r").agg(*[F.max(F.when(side, x)).alias(name) for side, k in ((one, "1"), (two, "2")) for name, x in ((f"w{k}", F.col("w")), (f"m{k}", F.try_divide("wx", "w")))])
    # Replicates carry the smaller side's size as theirs, which decides whether there is a test.
    out = _summary(both, by, F.col("m1") - F.col("m2"), F.least("w1", "w2"), level, resamples).drop("n")
    first, second = F.when(F.col(group), F.col(value)), F.when(~F.col(group), F.col(value))
    moments = df.groupBy(*by).agg(F.count(first).alias("n1"), F.count(second).alias("n2"), (F.var_samp(first) / F.count(first) + F.var_samp(second) / F.count(second)).alias("__v"))
    joined = moments.join(out, list(by)) if by else moments.crossJoin(F.broadcast(out))  # one row
    limit = F.when(F.col("__v") > 0, tails.normal_p(F.col("mean") / F.sqrt("__v"))).otherwise((F.col("mean") == 0).cast("double"))
    return joined.select(*by, "n1", "n2", "mean", F.when(F.least("n1", "n2") >= LIMIT_N, limit).otherwise(F.col("p")).alias("p"), "lo", "hi")


def sign_flip(pairs: DataFrame, by: Sequence[str] = (), resamples: int = RESAMPLES) -> DataFrame:
    """``by, n, mean, p``: two-sided test of the mean difference of ``pairs(x, y)`` by random signs; from ``LIMIT_N`` pairs the normal limit."""
    d = pairs.withColumn("__d", F.col("x") - F.col("y")).where("__d IS NOT NULL AND NOT isnan(__d)")
    flips = _replicates(d, F.abs("__d"), by, _surplus, resamples).where("r > 0").groupBy(*by).agg(F.collect_list("wx").alias("all"))
    sums = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("__d").alias("s"), F.sum(F.col("__d") * F.col("__d")).alias("ss"))
    both = sums.join(flips, list(by)) if by else sums.crossJoin(F.broadcast(flips))  # one row
    far = F.size(F.filter("all", lambda x: F.abs(x) >= F.abs("s") * (1 - 1e-9)))
    limit = tails.normal_p(F.try_divide("s", F.sqrt("ss")))
    p = F.when(F.col("n") < MIN_N, None).when(F.col("ss") == 0, F.lit(1.0)).when(F.col("n") >= LIMIT_N, limit).otherwise((far + 1) / F.lit(resamples + 1.0))
    return both.select(*by, "n", (F.col("s") / F.col("n")).alias("mean"), p.alias("p"))
