import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasemill.functions import stats
from phrasemill.operators import comparisons, resampling, statistics

RNG = np.random.default_rng(5)


def test_distributions():
    assert stats.t_sf(2.0, 10) == pytest.approx(0.036694017385, abs=1e-10)
    assert stats.t_sf(-2.0, 10) == pytest.approx(1 - 0.036694017385, abs=1e-10)
    assert stats.t_ppf(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert stats.chi2_sf(5.991464547, 2) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_sf(7.814727903, 3) == pytest.approx(0.05, abs=1e-9)
    assert stats.f_sf(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert stats.norm_ppf(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert stats.t_sf(1.96, 1e5) == pytest.approx(stats.norm_sf(1.96), abs=1e-5)


def test_exact_rank_tests():
    assert stats.mann_whitney([1, 2, 3, 4, 5, 6], [7, 8, 9, 10, 11, 12]) == (0.0, pytest.approx(2 / math.comb(12, 6)))
    assert stats.wilcoxon([1, 2, 3, 4, 5, 6], [0] * 6) == (0.0, pytest.approx(2 / 2**6))
    assert sum(stats.rank_sum_counts(4, 5)) == math.comb(9, 4)
    assert stats.wilcoxon([1, 2], [2, 1]) == (None, None)
    with pytest.raises(stats.Unaligned):
        stats.wilcoxon([1], [1, 2])


def test_corrections():
    assert stats.adjust([0.01, None, 0.04, 0.03]) == [pytest.approx(0.03), None, pytest.approx(0.06), pytest.approx(0.06)]
    assert stats.adjust([0.01, 0.04, 0.03], "bh") == pytest.approx([0.03, 0.04, 0.04])
    assert stats.adjust([0.5, 0.9], "bonferroni") == [1.0, 1.0]
    assert stats.adjust([0.5], "holm") == [0.5]


def test_correlations():
    assert stats.kendall([1, 2, 3, 4, 5], [3, 4, 1, 2, 5])[0] == pytest.approx(0.2)
    assert stats.spearman([1, 2, 3], [1, 2, 3])[1] == pytest.approx(1 / 3)
    r, p, lo, hi = stats.pearson([1, 2, 3, 4, 5, 6], [2, 1, 4, 3, 6, 5])
    assert r == pytest.approx(0.8285714) and lo < r < hi and 0 < p < 0.1
    assert stats.pearson([1, 1, 1], [1, 2, 3]) == (None,) * 4


def _frame(spark, x, y):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")


def test_resampling_is_reproducible_and_sane(spark):
    x, y = RNG.normal(0.3, 1, 60), RNG.normal(0, 1, 60)
    pairs = _frame(spark, x, y)
    assert tuple(resampling.sign_flip(pairs).first()) == pytest.approx(tuple(resampling.sign_flip(pairs.repartition(5)).first()))
    assert resampling.sign_flip(_frame(spark, x + 5, y)).first().p == pytest.approx(1 / 1001)
    assert resampling.sign_flip(_frame(spark, x, x)).first().p == 1.0 and resampling.sign_flip(_frame(spark, x[:5], y[:5])).first().p is None
    b = resampling.bootstrap(pairs, "x").first()
    half = 1.96 * x.std(ddof=1) / math.sqrt(60)
    assert b.n == 60 and b.mean == pytest.approx(x.mean()) and b.lo == pytest.approx(x.mean() - half, abs=half / 4) and b.hi == pytest.approx(x.mean() + half, abs=half / 4)
    same = resampling.bootstrap(pairs.repartition(3), "x").first()
    assert (same.p, same.lo) == (pytest.approx(b.p), pytest.approx(b.lo))
    assert resampling.paired_bootstrap(_frame(spark, x, x)).first().p == 1.0
    # p of the sampled tests against the t-test, on the same differences
    assert resampling.paired_bootstrap(pairs).first().p == pytest.approx(stats.paired_t(x, y)[1], abs=0.06)
    assert resampling.sign_flip(pairs).first().p == pytest.approx(stats.paired_t(x, y)[1], abs=0.06)
    big = np.round(RNG.normal(0.1, 1, 400), 2)
    assert resampling.sign_flip(_frame(spark, big, 0 * big)).first().p == pytest.approx(2 * stats.norm_sf(abs(big.sum()) / math.sqrt(big @ big)))
    two = spark.createDataFrame([(float(v), g, k) for k in "ab" for g, vs in ((True, x + (9 if k == "a" else 0)), (False, y)) for v in vs] + [(None, True, "a"), (1.0, None, "a")], "v double, g boolean, k string")
    got = {r.k: r for r in resampling.two_sample_bootstrap(two, "v", "g", ["k"]).collect()}
    assert got["a"].p < 0.01 and got["b"].p == pytest.approx(stats.welch_t(x, y)[1], abs=0.06) and got["b"].lo < (x.mean() - y.mean()) < got["b"].hi
    assert resampling.bootstrap(pairs.where("false"), "x", []).count() in (0, 1)


@pytest.mark.parametrize("family", ["rank", "mean", "resample"])
def test_families_of_tests(spark, family):
    x, y, z = (np.round(RNG.normal(m, 1, 40), 2) for m in (0, 0.4, 0.1))
    t = comparisons.Tests(family)
    pairs = _frame(spark, x, y).withColumn("k", F.lit("a")).unionByName(_frame(spark, x, x).withColumn("k", F.lit("b"))).unionByName(_frame(spark, x[:4], y[:4]).withColumn("k", F.lit("c")))
    got = {r.k: r for r in t.paired(pairs, ["k"]).collect()}
    want = stats.paired_t(x, y)[1] if family == "mean" else stats.wilcoxon(np.round(x - y, 12), 0 * x)[1]
    assert got["a"].p == pytest.approx(want, abs=0.06 if family == "resample" else 1e-9) and got["a"].n == 40
    assert got["b"].p in (None, 1.0) and got["b"].effect in (None, 0.0) and (got["c"].p, got["c"].effect) == (None, None)
    rows = spark.createDataFrame([(float(v), g) for g, vs in ((True, x), (False, y)) for v in vs], "v double, g boolean")
    one = t.independent(rows, "v", "g").first()
    want = stats.welch_t(x, y)[1:] if family == "mean" else (stats.mann_whitney(x, y)[1], stats.rank_biserial(x, y))
    assert one.p == pytest.approx(want[0], abs=0.06 if family == "resample" else 1e-9) and one.effect == pytest.approx(want[1])
    long = spark.createDataFrame([(i, c, float(v[i])) for c, v in (("x", x), ("y", y), ("z", z)) for i in range(40)], "doc int, c string, v double")
    s = t.several(long, "doc", "c", "v").first()
    if family == "mean":
        assert (s.p, s.effect) == (pytest.approx(stats.rm_anova([x, y, z])[1]), pytest.approx(stats.rm_anova([x, y, z])[2]))
    else:
        chi2, p = stats.friedman([x, y, z])
        assert (s.p, s.effect) == (pytest.approx(p), pytest.approx(chi2 / 80))
    ends = t.interval(rows.where("g"), "v").first()
    lo, hi = stats.t_interval(x)
    assert (ends.lo, ends.hi) == (pytest.approx(lo, abs=0.1), pytest.approx(hi, abs=0.1))


def test_adjusted_and_macro_interval(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, None, 0.04, 0.03])], "fam string, i int, p double")
    for method in ("holm", "bh", "bonferroni", "none"):
        got = {r.i: (r.p_adjusted, r.marked) for r in comparisons.Tests(correction=method).adjusted(df, "p", ["fam"], ["i"]).collect()}
        want = stats.adjust([0.01, None, 0.04, 0.03], method)
        assert {i: v[0] for i, v in got.items()} == {i: pytest.approx(w) if w is not None else None for i, w in enumerate(want)}
        assert got[1][1] is False and got[0][1] == (want[0] < 0.05)
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 5.0), ("b", 8.0)], "d string, v double")
    m = comparisons.Tests().macro_interval(rows, "v", "d").first()
    half = 1.959963985 * math.sqrt(2 / 2 + 3 / 3) / 2
    assert m.n == 2 and m.mean == pytest.approx(4.0) and m.lo == pytest.approx(4 - half)


@pytest.mark.parametrize("n", [2, 3, 7, 30])
def test_correlations_as_frames(spark, n):
    x, y = np.round(RNG.normal(size=n), 1), np.round(RNG.normal(size=n), 1)
    pairs = _frame(spark, x, y).withColumn("k", F.lit("a")).unionByName(_frame(spark, 0 * x, y).withColumn("k", F.lit("flat")))
    got = {r.k: r for r in comparisons.correlations(pairs, ["k"]).collect()}
    r = got["a"]
    assert got["flat"].pearson is None and got["flat"].kendall_p is None and r.n == n

    def near(*values):
        return tuple(pytest.approx(v, abs=1e-9) if v is not None else None for v in values)

    assert (r.pearson, r.pearson_p, r.pearson_lo, r.pearson_hi) == near(*stats.pearson(x, y))
    assert (r.spearman, r.spearman_p, r.spearman_lo, r.spearman_hi) == near(*stats.spearman(x, y))
    tau, p = stats.kendall(x, y) if n >= 3 else (None, None)
    assert (r.kendall, r.kendall_p) == near(tau, p) and (r.kendall_lo, r.kendall_hi) == near(*stats.kendall_interval(tau, n))


def test_two_condition_anova_is_paired_t():
    x, y = RNG.normal(size=20), RNG.normal(size=20)
    f, p, _ = stats.rm_anova([x, y])
    t, q, _ = stats.paired_t(x, y)
    assert f == pytest.approx(t * t) and p == pytest.approx(q)


def test_frames_agree_with_vectors(spark):
    x, y, z = (np.round(RNG.uniform(size=40), 1) for _ in range(3))
    pairs = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    w = statistics.wilcoxon(pairs).first()
    assert w.w == pytest.approx(stats.wilcoxon(np.round(x - y, 12), np.zeros(40))[0])
    groups = spark.createDataFrame([(float(a), True) for a in x] + [(float(b), False) for b in y], "v double, g boolean")
    u = statistics.mann_whitney(groups, "v", "g").first()
    assert u.u == pytest.approx(stats.mann_whitney(x, y)[0])
    t = statistics.welch_t(groups, "v", "g").first()
    assert (t.t, t.g) == (pytest.approx(stats.welch_t(x, y)[0]), pytest.approx(stats.welch_t(x, y)[2]))
    long = spark.createDataFrame([(i, c, float(v[i])) for c, v in (("x", x), ("y", y), ("z", z)) for i in range(40)], "doc int, c string, v double")
    assert statistics.friedman(long, "doc", "c", "v").first().chi2 == pytest.approx(stats.friedman([x, y, z])[0])
    assert statistics.rm_anova(long, "doc", "c", "v").first().f == pytest.approx(stats.rm_anova([x, y, z])[0])
    k = statistics.kendall_pairs(long.groupBy("doc").pivot("c", ["x", "y"]).sum("v"), "x", "y").first()
    assert k.tau == pytest.approx(stats.kendall(x, y)[0])


def test_pareto(spark):
    rows = [("a", 1.0, 0.2), ("b", 2.0, 0.5), ("c", 2.0, 0.4), ("d", 3.0, 0.5), ("e", float("nan"), 0.9), ("f", None, 0.9), ("g", 4.0, 0.6)]
    got = statistics.pareto(spark.createDataFrame(rows, "i string, c double, v double"), "c", "v", order=["i"])
    assert sorted(r.i for r in got.where("on_front").collect()) == ["a", "b", "g"]
