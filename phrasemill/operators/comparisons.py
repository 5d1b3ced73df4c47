"""Tests with p-values, effect sizes and intervals for whole tables of comparisons.

Statistics are windows and aggregates (``operators.statistics``), tails Arrow functions on one row a test
(``operators.tails``), resampling partial sums (``operators.resampling``). A group of fewer than ``MIN_N`` items has
null p and effect; an undefined statistic has too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.functions import stats
from phrasemill.functions.stats import EXACT_SYSTEMS, LEVEL, MIN_N
from phrasemill.operators import resampling, statistics, tails


def matched_rank_biserial(w_plus: str = "w_plus", w_minus: str = "w_minus") -> Column:
    """The share of the rank sum that speaks for the first condition less the share against it; 0 without a difference."""
    return F.coalesce(F.try_divide(F.col(w_plus) - F.col(w_minus), F.col(w_plus) + F.col(w_minus)), F.lit(0.0))


def concordance(chi2: str = "chi2", n: str = "n", k: str = "k") -> Column:
    """Kendall's coefficient of concordance: Friedman's statistic as a part of the largest it can be."""
    most = F.col(n) * (F.col(k) - 1)
    return F.try_divide(F.col(chi2), F.when(most > 0, most))


def fisher_interval(r: str | Column, variance: Column, level: float = LEVEL) -> tuple[Column, Column]:
    """Interval of a correlation from the variance of its inverse hyperbolic tangent; null where there is none."""
    r = F.col(r) if isinstance(r, str) else r
    z, half = F.atanh(F.when(F.abs(r) < 1, r)), F.lit(stats.norm_ppf((1 + level) / 2)) * F.sqrt(F.when(variance > 0, variance))
    return F.tanh(z - half), F.tanh(z + half)


@dataclass(frozen=True)
class Tests:
    """Family of tests (``rank``, ``mean`` or ``resample``), correction of a family of p-values and significance level."""

    family: str = "rank"
    correction: str = "holm"
    alpha: float = 0.05

    def paired(self, pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """``by, n, p, effect`` of two conditions on the same documents, ``pairs(x, y)``; n is the number of pairs."""
        n = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        if self.family == "mean":
            t = statistics.paired_t(pairs, by)
            flat = F.when(F.col("sd") == 0, F.when(F.col("mean") == 0, 1.0).otherwise(0.0))
            return t.select(*by, "n", F.when(F.col("n") >= MIN_N, F.coalesce(flat, tails.t_p("t", F.col("n") - 1))).alias("p"), F.when(F.col("n") >= MIN_N, F.col("d_z")).alias("effect"))
        ranks = statistics.wilcoxon(pairs, by)
        ranks = ranks.select(*by, tails.wilcoxon_p("w", "n", "ties").alias("p"), matched_rank_biserial().alias("effect"))
        if self.family == "resample":
            ranks = _beside(ranks.drop("p"), resampling.sign_flip(pairs, by).select(*by, "p"), by, "right")
        return _beside(n, ranks, by, "left").withColumn("effect", F.when(F.col("n") >= MIN_N, F.coalesce("effect", F.lit(0.0)))).select(*by, "n", "p", "effect")

    def independent(self, df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
        """``by, n1, n2, p, effect`` of a boolean group."""
        enough = F.least("n1", "n2") >= MIN_N
        if self.family == "mean":
            t = statistics.welch_t(df, value, group, by)
            return t.select(*by, "n1", "n2", F.when(enough, tails.t_p("t", "df")).alias("p"), F.when(enough, F.col("g")).alias("effect"))
        ranks = statistics.mann_whitney(df.where(F.col(value).isNotNull() & F.col(group).isNotNull()), value, group, by)
        out = ranks.select(*by, "n1", "n2", tails.mann_whitney_p("u", "n1", "n2", "ties").alias("p"), F.when(enough, 2 * F.try_divide("u1", F.col("n1") * F.col("n2")) - 1).alias("effect"))
        if self.family == "resample":
            out = _beside(out.drop("p"), resampling.two_sample_bootstrap(df, value, group, by).select(*by, "p"), by, "left")
        return out.select(*by, "n1", "n2", "p", "effect")

    def several(self, scores: DataFrame, block: str, condition: str, value: str, by: Sequence[str] = ()) -> DataFrame:
        """``by, n, k, p, effect`` of conditions on the blocks that all of them have."""
        enough = (F.col("n") >= MIN_N) & (F.col("k") >= (2 if self.family == "mean" else 3))
        if self.family == "mean":
            f = _beside(statistics.rm_anova(scores, block, condition, value, by), statistics.sphericity(scores, block, condition, value, by).select(*by, "eps"), by, "left")
            e = F.coalesce("eps", F.lit(1.0))
            p = tails.f_p("f", (F.col("k") - 1) * e, (F.col("k") - 1) * (F.col("n") - 1) * e)
            return f.select(*by, "n", "k", F.when(enough, p).alias("p"), F.when(enough, F.col("eta2")).alias("effect"))
        chi = statistics.friedman(scores, block, condition, value, by)
        return chi.select(*by, "n", "k", F.when(enough, tails.chi2_p("chi2", F.col("k") - 1)).alias("p"), F.when(enough, concordance()).alias("effect"))

    def interval(self, df: DataFrame, value: str, by: Sequence[str] = (), level: float = LEVEL) -> DataFrame:
        """``by, n, mean, lo, hi`` of a mean: Student's t, or the bootstrap's percentiles."""
        if self.family != "mean":
            return resampling.bootstrap(df, value, by, level).drop("p")
        out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
        half = tails.t_quantile(F.col("n") - 1, level) * F.col("sd") / F.sqrt("n")
        return out.select(*by, "n", "mean", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))

    def macro_interval(self, df: DataFrame, value: str, over: str, by: Sequence[str] = ()) -> DataFrame:
        """``by, n, mean, lo, hi`` of the mean of the means of ``over`` (datasets): its standard error adds theirs."""
        each = df.groupBy(*by, over).agg(F.avg(value).alias("m"), F.count(value).alias("c"), F.var_samp(value).alias("v"))
        out = each.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean"), F.sum(F.when(F.col("c") > 1, F.col("v") / F.col("c"))).alias("v"), F.min("c").alias("least"))
        half = F.lit(stats.norm_ppf((1 + LEVEL) / 2)) * F.sqrt("v") / F.col("n")
        half = F.when(F.col("least") > 1, half)
        return out.select(*by, "n", "mean", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))

    def adjusted(self, df: DataFrame, p: str = "p", by: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
        """Adds ``p_adjusted`` inside each family ``by``, and ``marked``: whether it lies below the level."""
        if self.correction == "none":
            out = df.withColumn("p_adjusted", F.col(p))
        else:
            out = statistics.adjusted(df, p, by, order)
            out = out.withColumn("p_adjusted", F.col(self.correction)).drop("bonferroni", "holm", "bh")
        return out.withColumn("marked", F.coalesce(F.col("p_adjusted") < self.alpha, F.lit(False)))


def _beside(a: DataFrame, b: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    return a.join(b, list(by), how) if by else a.crossJoin(F.broadcast(b))  # one row each


def correlations(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, n, pearson, pearson_p, pearson_lo, pearson_hi, spearman.., kendall..`` of ``pairs(x, y)``, one row a system.

    Ranks share ties. For at most ``EXACT_SYSTEMS`` systems the p of rank correlations is over all their orders.
    Fewer than three systems, or no spread on a side, give nulls.
    """
    rows = pairs.where("x IS NOT NULL AND y IS NOT NULL").select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    for c in ("x", "y"):
        rows = statistics.average_ranks(rows, c, by, f"r{c}", f"t{c}")
    few = F.when(F.col("n") <= EXACT_SYSTEMS, F.struct("x", "y", "rx", "ry"))
    # At most EXACT_SYSTEMS structs are listed for a group, none for a larger one.
    from pyspark.sql import Window

    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    spread = (F.stddev_pop("x") > 1e-12) & (F.stddev_pop("y") > 1e-12)

    def r(a: str, b: str) -> Column:
        return F.when(spread, F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))

    t = [F.col("tx").cast("double"), F.col("ty").cast("double")]
    ties = [F.sum(x).alias(f"{name}{i}") for i, c in enumerate(t) for name, x in (("a", (c - 1) * (2 * c + 5)), ("b", c - 1), ("c", (c - 1) * (c - 2)))]
    out = rows.groupBy(*by).agg(F.max("n").alias("n"), r("x", "y").alias("pearson"), r("rx", "ry").alias("spearman"), F.collect_list(few).alias("few"), *ties)
    taus = statistics.kendall_pairs(rows.select(*by, "x", "y"), "x", "y", by)
    out = out.join(taus.select(*by, F.col("tau").alias("kendall"), (F.col("concordant") - F.col("discordant")).alias("s")), list(by), "left")
    n = F.col("n").cast("double")
    usable = (F.col("n") >= 3) & F.col("pearson").isNotNull()
    var = (n * (n - 1) * (2 * n + 5) - F.col("a0") - F.col("a1")) / 18 + F.col("b0") * F.col("b1") / (2 * n * (n - 1)) + F.when(n > 2, F.col("c0") * F.col("c1") / (9 * n * (n - 1) * (n - 2))).otherwise(0.0)

    def by_t(c: str) -> Column:
        inside = F.when(F.abs(c) < 1 - 1e-15, F.abs(c))
        return F.coalesce(tails.t_p(inside * F.sqrt((n - 2) / (1 - inside * inside)), n - 2), F.when(F.abs(c) >= 1 - 1e-15, F.lit(0.0)))

    exact = F.col("n") <= EXACT_SYSTEMS
    arrays = {c: F.when(exact, F.col(f"few.{c}")) for c in ("x", "y", "rx", "ry")}
    out = out.withColumns({f"__{c}": a for c, a in arrays.items()})
    spearman_p = F.when(exact, tails.exact_p(stats.exact_correlation_p, "__rx", "__ry")).otherwise(by_t("spearman"))
    kendall_p = F.when(exact, tails.exact_p(stats.exact_tau_p, "__x", "__y")).otherwise(tails.normal_p(F.try_divide(F.col("s").cast("double"), F.sqrt(F.when(var > 0, var)))))
    columns = {"pearson": (by_t("pearson"), 1 / (n - 3), F.col("n") > 3), "spearman": (spearman_p, 1.06 / (n - 3), F.col("n") > 3), "kendall": (kendall_p, 0.437 / (n - 4), F.col("n") > 4)}
    picked = []
    for name, (p, variance, when) in columns.items():
        lo, hi = fisher_interval(name, F.when(when, variance))
        picked += [F.when(usable, x).alias(alias) for alias, x in ((name, F.col(name)), (f"{name}_p", p), (f"{name}_lo", lo), (f"{name}_hi", hi))]
    return out.select(*by, "n", *picked)
