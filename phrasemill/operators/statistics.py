"""Test statistics as windows and aggregates. Only their tails leave the JVM (``functions.stats``).

Groups are partitioned by the analysed condition; where ranks are needed they come from counts of distinct values, so
that ties and large samples cost an aggregate and a window over values, not over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), rank: str = "rank", ties: str = "ties") -> DataFrame:
    """Adds the rank from 1 (ties share their mean) and the size of the row's tie group; for groups of few rows.

    Large groups are ranked by ``value_ranks``, which counts before its window.
    """
    own = Window.partitionBy(*by, value)
    return df.withColumn(ties, F.count(F.lit(1)).over(own)).withColumn(rank, F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.col(ties) - 1) / 2)


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, value, n, rank``: the average rank of each distinct value. Rows are counted before the window."""
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counted.withColumn("rank", before - (F.col("n") - 1) / 2)


def mann_whitney(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, n1, n2, u, ties, u1``: the smaller U of ``group`` (boolean: true is the first sample), and that sample's."""
    counted = df.groupBy(*by, value).agg(F.count_if(group).alias("n1"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counted.withColumn("rank", before - (F.col("n") - 1) / 2)
    n = F.col("n").cast("double")
    sums = ranked.groupBy(*by).agg(F.sum("n1").alias("n1"), (F.sum("n") - F.sum("n1")).alias("n2"), F.sum(F.col("n1") * F.col("rank")).alias("r1"), F.sum(n * n * n - n).alias("ties"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    return sums.select(*by, "n1", "n2", F.least(u, F.col("n1") * F.col("n2") - u).alias("u"), "ties", u.alias("u1"))


def wilcoxon(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, n, w_plus, w_minus, w, ties`` of ``pairs(x, y)``; equal pairs are dropped."""
    d = pairs.withColumn("d", F.round(F.col("x") - F.col("y"), 12)).where("d <> 0")
    counted = d.groupBy(*by, F.abs("d").alias("size")).agg(F.count_if(F.col("d") > 0).alias("up"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counted.withColumn("rank", before - (F.col("n") - 1) / 2)
    n = F.col("n").cast("double")
    out = ranked.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w_plus"), F.sum((F.col("n") - F.col("up")) * F.col("rank")).alias("w_minus"), F.sum(n * n * n - n).alias("ties")
    )
    return out.withColumn("w", F.least("w_plus", "w_minus"))


def friedman(scores: DataFrame, block: str, condition: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, n, k, chi2`` over blocks that every condition has scored, ties corrected."""
    scores = scores.select(*by, block, condition, value)
    # Few conditions per block: the ranks inside a block are a window of k rows.
    k = scores.groupBy(*by).agg(F.count_distinct(condition).alias("k"))
    complete = scores.withColumn("own", F.count(F.lit(1)).over(Window.partitionBy(*by, block)))
    complete = complete.join(k, list(by)) if by else complete.crossJoin(F.broadcast(k))  # one row
    ranked = average_ranks(complete.where("own = k"), value, [*by, block])
    t = F.col("ties").cast("double")
    sums = ranked.groupBy(*by, "k", condition).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"), F.sum(t * t - 1).alias("t"))
    agg = sums.groupBy(*by, "k").agg(F.max("n").alias("n"), F.sum(F.pow(F.col("r") - F.col("n") * (F.col("k") + 1) / 2, F.lit(2.0))).alias("s"), F.sum("t").alias("t"))
    k_, n_ = F.col("k"), F.col("n")
    fix = 1 - F.col("t") / (n_ * k_ * (k_ * k_ - 1))
    return agg.select(*by, "n", "k", F.when(fix > 0, 12 * F.col("s") / (n_ * k_ * (k_ + 1)) / fix).alias("chi2"))


def paired_t(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, n, mean, sd, t, d_z`` of the differences of ``pairs(x, y)``."""
    d = F.col("x") - F.col("y")
    out = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    return out.withColumn("t", F.try_divide("mean", F.col("sd") / F.sqrt("n"))).withColumn("d_z", F.try_divide("mean", "sd"))


def welch_t(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, n1, n2, t, df, g``: Welch's t, its degrees of freedom and Hedges' g of a boolean group."""
    first, second = F.when(F.col(group), F.col(value)), F.when(~F.col(group), F.col(value))
    out = df.groupBy(*by).agg(
        F.count(first).alias("n1"), F.count(second).alias("n2"), F.avg(first).alias("m1"), F.avg(second).alias("m2"), F.var_samp(first).alias("v1"), F.var_samp(second).alias("v2")
    )
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    n1, n2, diff = F.col("n1"), F.col("n2"), F.col("m1") - F.col("m2")
    pooled = F.sqrt(F.try_divide((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2"), n1 + n2 - 2))
    return out.select(
        *by, "n1", "n2",
        F.try_divide(diff, F.sqrt(a + b)).alias("t"),
        F.try_divide((a + b) * (a + b), F.try_divide(a * a, n1 - 1) + F.try_divide(b * b, n2 - 1)).alias("df"),
        (F.try_divide(diff, pooled) * (1 - F.lit(3.0) / (4 * (n1 + n2) - 9))).alias("g"),
    )


def rm_anova(scores: DataFrame, block: str, condition: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, n, k, f, eta2`` of a one-way repeated-measures analysis over blocks that every condition has."""
    scores = scores.select(*by, block, condition, value)
    k = scores.groupBy(*by).agg(F.count_distinct(condition).alias("k"))
    blocks = Window.partitionBy(*by, block)
    rows = scores.withColumn("own", F.count(F.lit(1)).over(blocks)).withColumn("of_block", F.avg(value).over(blocks))
    rows = (rows.join(k, list(by)) if by else rows.crossJoin(F.broadcast(k))).where("own = k")  # one row
    # Sums of squares from conditions' sums of values and of block-centred values: one pass and no second join.
    per = rows.groupBy(*by, "k", condition).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(value) - F.col("of_block")).alias("effect"), F.sum(F.pow(F.col(value) - F.col("of_block"), F.lit(2.0))).alias("ss")
    )
    agg = per.groupBy(*by, "k").agg(F.max("n").alias("n"), F.sum(F.pow("effect", F.lit(2.0))).alias("e"), F.sum("ss").alias("ss"))
    out = agg.withColumn("cond", F.col("n") * F.col("e")).withColumn("err", F.greatest(F.col("ss") - F.col("cond"), F.lit(0.0)))
    # Without residual variation F is undefined: null.
    out = out.withColumn("err", F.when(F.col("err") > 1e-12 * F.col("ss"), F.col("err")).otherwise(0.0))
    return out.select(
        *by, "n", "k",
        F.try_divide(F.col("cond") / (F.col("k") - 1), F.col("err") / ((F.col("k") - 1) * (F.col("n") - 1))).alias("f"),
        F.try_divide("cond", F.col("cond") + F.col("err")).alias("eta2"),
    )


def sphericity(scores: DataFrame, block: str, condition: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, k, eps``: Greenhouse and Geisser's epsilon from the covariances of conditions over complete blocks.

    A block gives the square of its conditions in pairs; conditions are few.
    """
    scores = scores.select(*by, block, condition, value)
    k = scores.groupBy(*by).agg(F.count_distinct(condition).alias("k"))
    rows = scores.withColumn("own", F.count(F.lit(1)).over(Window.partitionBy(*by, block)))
    rows = (rows.join(k, list(by)) if by else rows.crossJoin(F.broadcast(k))).where("own = k")  # one row
    a, b = (rows.select(*by, "k", block, F.col(condition).alias(f"c{i}"), F.col(value).alias(f"v{i}")) for i in "12")
    cov = a.join(b, [*by, "k", block]).groupBy(*by, "k", "c1", "c2").agg(F.covar_samp("v1", "v2").alias("c"))
    # Centred both ways, the matrix has rows and columns that sum to zero.
    centred = F.col("c") - F.avg("c").over(Window.partitionBy(*by, "c1")) - F.avg("c").over(Window.partitionBy(*by, "c2")) + F.avg("c").over(Window.partitionBy(*by))
    sums = cov.withColumn("s", centred).groupBy(*by, "k").agg(F.sum(F.when(F.col("c1") == F.col("c2"), F.col("s"))).alias("trace"), F.sum(F.col("s") * F.col("s")).alias("square"))
    eps = F.try_divide(F.col("trace") * F.col("trace"), (F.col("k") - 1) * F.col("square"))
    return sums.select(*by, "k", F.when((F.col("k") > 2) & (F.col("square") > 0), F.least(F.lit(1.0), F.greatest(1 / (F.col("k") - 1), eps))).otherwise(1.0).alias("eps"))


def adjusted(df: DataFrame, p: str = "p", by: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Adds ``bonferroni``, ``holm`` and ``bh`` inside each family; null p-values stay null and do not count."""
    family = Window.partitionBy(*by)
    up = Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last(), *order)
    running = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    df = df.withColumn("__m", F.count(p).over(family)).withColumn("__k", F.row_number().over(up))
    steps = {
        "bonferroni": F.least(F.lit(1.0), F.col(p) * F.col("__m")),
        "holm": F.max(F.least(F.lit(1.0), F.col(p) * (F.col("__m") - F.col("__k") + 1))).over(running),
        "bh": F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__k")).over(rest)),
    }
    for name, value in steps.items():
        df = df.withColumn(name, F.when(F.col(p).isNotNull(), F.when(F.col("__m") <= 1, F.col(p)).otherwise(value)))
    return df.drop("__m", "__k")


def pareto(df: DataFrame, cost: str, value: str, by: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Adds ``on_front``: strictly better than everything at most as expensive. Unknown costs are never on it."""
    usable = F.col(cost).isNotNull() & ~F.isnan(cost) & (F.abs(cost) != float("inf")) & F.col(value).isNotNull() & ~F.isnan(value)
    w = Window.partitionBy(*by, usable).orderBy(cost, F.desc(value), *order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(value).over(w)
    return df.withColumn("on_front", usable & (best.isNull() | (F.col(value) > best)))


def pearson_matrix(means: DataFrame, system: str, group: str, value: str) -> DataFrame:
    """``a, b, n, r``: correlation of every two groups over the systems that both have."""
    x = means.select(system, F.col(group).alias("a"), F.col(value).alias("x"))
    y = means.select(system, F.col(group).alias("b"), F.col(value).alias("y"))
    pairs = x.join(y, system).where("a < b").groupBy("a", "b")
    spread = (F.stddev_pop("x") > 1e-12) & (F.stddev_pop("y") > 1e-12)
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.when(spread, F.covar_pop("x", "y") / (F.stddev_pop("x") * F.stddev_pop("y"))).alias("r"))


def kendall_pairs(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, concordant, discordant, ties_x, ties_y, tau``.

    Items are counted by ``(x, y)`` first; pairs are made of distinct cells, weighed by their counts, so that the work
    grows with the square of the distinct cells of a group: it is meant for systems, or scores on few steps.
    """
    key = [*by, "__all"]
    cells = df.withColumn("__all", F.lit(0)).groupBy(*key, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    a, b = (cells.select(*key, *(F.col(c).alias(c + side) for c in ("x", "y", "n"))) for side in "12")
    # Each unordered pair of different cells once.
    pairs = a.join(b, key).where("x1 < x2 OR x1 = x2 AND y1 < y2")
    s, t, w = F.signum(F.col("x1") - F.col("x2")), F.signum(F.col("y1") - F.col("y2")), F.col("n1") * F.col("n2")

    def total(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, w)), F.lit(0))

    counts = pairs.groupBy(*key).agg(
        total(s * t > 0).alias("concordant"), total(s * t < 0).alias("discordant"), total((s == 0) & (t != 0)).alias("ties_x"), total((s != 0) & (t == 0)).alias("ties_y")
    )
    # Groups with pairs of equal items only have no pair of cells.
    groups = cells.groupBy(*key).agg(F.sum("n").alias("items")).where("items > 1").drop("items")
    out = groups.join(counts, key, "left").fillna(0, ["concordant", "discordant", "ties_x", "ties_y"]).drop("__all")
    both = F.col("concordant") + F.col("discordant")
    return out.withColumn("tau", F.try_divide((F.col("concordant") - F.col("discordant")).cast("double"), F.sqrt((both + F.col("ties_x")) * (both + F.col("ties_y")))))


def best_per(df: DataFrame, key: Sequence[str], value: str, order: Sequence[str | Column]) -> DataFrame:
    """The row of the largest value of each key; nulls lose, ties go by ``order``."""
    w = Window.partitionBy(*key).orderBy(F.desc_nulls_last(value), *order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
