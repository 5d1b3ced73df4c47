"""Queries behind pages and workbenches, each with its DuckDB counterpart where SQL has one.

Tests carry p-values, which DuckDB's functions can't give (no error function, no incomplete beta); their statistics and
effect sizes have SQL of their own, and unit tests hold the tails to the distributions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phrasemill.operators import browse, comparisons, facts, scoring, statistics
from phrasemill.plans import bridge
from phrasemill.plans.bridge import BASE, table
from phrasemill.plans.catalog import _COMPLETE, _SC, _XY, _ten, _xy, query, scored_sql

_FLAGGED = (
    "fd AS (SELECT source AS dataset, doc_id, 'doc-' || (doc_id % 13) || '-' || doc_id AS id, lang, n_chars, list_filter([CASE WHEN n_chars < 300 THEN 'short:' || lang END, CASE WHEN n_chars > 5000 THEN 'long:' || lang END, "
    "CASE WHEN doc_id % 7 = 0 THEN 'odd' END], lambda x: x IS NOT NULL) AS flags FROM documents)"
)


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    flags = F.filter(
        F.array(F.when(F.col("n_chars") < 300, F.concat(F.lit("short:"), "lang")), F.when(F.col("n_chars") > 5000, F.concat(F.lit("long:"), "lang")), F.when(F.col("doc_id") % 7 == 0, "odd")), lambda x: x.isNotNull()
    )
    return table(spark, d, "documents").select(F.col("source").alias("dataset"), "doc_id", F.expr("concat('doc-', doc_id % 13, '-', doc_id)").alias("id"), "lang", "n_chars", flags.alias("flags"))


# Documents ---------------------------------------------------------------------------------------------------


@query(f"WITH {_FLAGGED} SELECT dataset, doc_id FROM fd WHERE list_contains(flags, 'odd') AND list_contains(flags, 'short:en')")
def docs_with_flags(spark: SparkSession, d: str) -> DataFrame:
    return browse.with_flags(_flagged(spark, d), ["odd", "short:en"]).select("dataset", "doc_id")


@query(f"WITH {_FLAGGED} SELECT id FROM fd WHERE id ILIKE '%OC-1_-%'")
def docs_by_id_part(spark: SparkSession, d: str) -> DataFrame:
    return browse.id_like(_flagged(spark, d), "OC-1_-", "id").select("id")


@query(f"WITH {_FLAGGED}, u AS (SELECT dataset, doc_id, unnest(flags) AS fl FROM fd) SELECT dataset, count(DISTINCT doc_id) AS n FROM u WHERE fl LIKE 'short:%' GROUP BY 1")
def docs_flagged_like(spark: SparkSession, d: str) -> DataFrame:
    return _flagged(spark, d).where(browse.flagged_like("flags", "short:")).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source AS dataset, string_agg(lang || '=' || n, ',' ORDER BY lang) AS langs FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL) GROUP BY 1")
def languages_map(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "documents").where("lang IS NOT NULL").groupBy(F.col("source").alias("dataset"), "lang").agg(F.count(F.lit(1)).alias("n"))
    entries = F.transform(F.map_entries("map"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return browse.map_of(counts, ["dataset"], "lang", "n").select("dataset", F.array_join(entries, ",").alias("langs"))


@query(f"WITH {BASE} SELECT dataset, doc_id, any_value(split) AS split, count(*) AS n_gold FROM gold GROUP BY ALL")
def split_of_documents(spark: SparkSession, d: str) -> DataFrame:
    return bridge.gold(spark, d).groupBy("dataset", "doc_id").agg(F.any_value("split", True).alias("split"), F.count(F.lit(1)).alias("n_gold"))


@query(f"WITH {BASE} SELECT dataset, count(*) AS n, avg(len(toks)) AS mean, coalesce(stddev_samp(len(toks)), 0) AS sd FROM docs GROUP BY 1")
def length_mean_sd(spark: SparkSession, d: str) -> DataFrame:
    return browse.mean_and_spread(bridge.documents(spark, d).select("dataset", F.size("toks").alias("n")), "n", ["dataset"])


@query(f"WITH {BASE}, t AS (SELECT d.dataset, d.doc_id, g.tok_end, g.doc_id IS NOT NULL AND len(d.toks) % 2 = 0 AS approx FROM docs d LEFT JOIN (SELECT * FROM tokpos WHERE ann_key = 'author' AND kp_idx = 0) g ON g.dataset = d.dataset AND g.doc_id = d.doc_id) "
       "SELECT dataset, count(*) AS n, count(tok_end) AS n_located, coalesce(bool_or(approx), false) AS any_approx FROM t GROUP BY 1")  # fmt: skip
def token_coverage(spark: SparkSession, d: str) -> DataFrame:
    first = bridge.gold(spark, d).where("ann_key = 'author' AND kp_idx = 0 AND tok_end IS NOT NULL").select("dataset", "doc_id", "tok_end")
    docs = bridge.documents(spark, d).select("dataset", "doc_id", F.size("toks").alias("n_words")).join(first, ["dataset", "doc_id"], "left")
    approx = F.col("tok_end").isNotNull() & (F.col("n_words") % 2 == 0)
    return docs.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count("tok_end").alias("n_located"), F.coalesce(F.bool_or(approx), F.lit(False)).alias("any_approx"))


@query(f"WITH {BASE}, k AS (SELECT DISTINCT kp, length(kp) % 7 AS pos FROM gold WHERE length(kp) % 2 = 0) SELECT g.dataset, count(*) AS n, count(k.pos) AS n_tagged, sum(coalesce(k.pos, -1))::BIGINT AS s FROM gold g LEFT JOIN k ON k.kp = g.kp GROUP BY 1")
def gold_left_keyphrases(spark: SparkSession, d: str) -> DataFrame:
    gold = bridge.gold(spark, d).select("dataset", "kp")
    known = gold.select("kp").distinct().where(F.length("kp") % 2 == 0).withColumn("pos", F.length("kp") % 7)
    return gold.join(known, "kp", "left").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count("pos").alias("n_tagged"), F.sum(F.coalesce("pos", F.lit(-1))).alias("s"))


@query("WITH old AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'old' || p_size END AS pos FROM part), new AS (SELECT p_partkey AS k, 'new' || p_size AS pos FROM part WHERE p_partkey % 5 = 0) SELECT old.k, coalesce(new.pos, old.pos) AS pos FROM old LEFT JOIN new ON new.k = old.k")
def tags_updated(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    old = part.select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("old"), "p_size")).alias("pos"))
    new = part.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("k"), F.concat(F.lit("new"), "p_size").alias("pos"))
    return facts.updated(old, new, ["k"], ["pos"])


@query(f"WITH {BASE}, r AS (SELECT DISTINCT dataset FROM preds) SELECT dataset, count(*) AS n_docs FROM docs WHERE EXISTS (SELECT 1 FROM r WHERE r.dataset = docs.dataset) GROUP BY 1")
def datasets_with_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = bridge.predictions(spark, d).select("dataset")
    return bridge.documents(spark, d).join(runs, "dataset", "left_semi").groupBy("dataset").agg(F.count(F.lit(1)).alias("n_docs"))


@query(f"WITH {BASE} SELECT dataset, count(DISTINCT (model, arch, run_id)) AS n_runs FROM nu GROUP BY 1")
def datasets_by_runs(spark: SparkSession, d: str) -> DataFrame:
    return bridge.predictions(spark, d).groupBy("dataset").agg(F.count_distinct(F.struct("model", "arch", "run_id")).alias("n_runs"))


@query(f"WITH {_FLAGGED} SELECT dataset, sum(len(flags))::BIGINT AS n FROM fd GROUP BY 1 ORDER BY n DESC, dataset LIMIT 1")
def default_dataset(spark: SparkSession, d: str) -> DataFrame:
    return _flagged(spark, d).groupBy("dataset").agg(F.sum(F.size("flags")).alias("n")).orderBy(F.desc("n"), "dataset").limit(1)


@query(f"WITH {BASE} SELECT dataset, avg(len(toks)) AS words FROM docs GROUP BY 1 ORDER BY words DESC, dataset LIMIT 1")
def longest_dataset(spark: SparkSession, d: str) -> DataFrame:
    return bridge.documents(spark, d).groupBy("dataset").agg(F.avg(F.size("toks")).alias("words")).orderBy(F.desc("words"), "dataset").limit(1)


@query("SELECT s_name, row_number() OVER (ORDER BY lower(regexp_extract(n, '^([^0-9]*)', 1)), try_cast(regexp_extract(n, '^[^0-9]*([0-9]+)', 1) AS DOUBLE) NULLS FIRST, lower(regexp_extract(n, '^[^0-9]*[0-9]+(.*)$', 1)), s_name) AS place "
       "FROM (SELECT s_name, CASE s_suppkey % 3 WHEN 0 THEN 'Beams=' || s_suppkey || 'x' WHEN 1 THEN 'beams=' || s_suppkey ELSE 'top' END AS n FROM supplier)")  # fmt: skip
def natural_places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    names = table(spark, d, "supplier").select("s_name", F.when(k % 3 == 0, F.concat(F.lit("Beams="), k, F.lit("x"))).when(k % 3 == 1, F.concat(F.lit("beams="), k)).otherwise("top").alias("n"))
    # Labels, few whatever the input.
    return names.select("s_name", F.row_number().over(Window.orderBy(browse.natural_key("n"), "s_name")).alias("place"))


@query(f"WITH {BASE} SELECT DISTINCT split, CASE lower(trim(coalesce(split, ''))) WHEN 'train' THEN 0 WHEN 'training' THEN 0 WHEN 'valid' THEN 1 WHEN 'test' THEN 2 ELSE 9 END AS place FROM docs")
def split_order(spark: SparkSession, d: str) -> DataFrame:
    return bridge.documents(spark, d).select("split").distinct().withColumn("place", browse.split_rank("split"))


@query("SELECT value, row_number() OVER (ORDER BY CASE WHEN try_cast(value AS DOUBLE) IS NOT NULL THEN 0 WHEN value IN ('true', 'false') THEN 1 ELSE 2 END, try_cast(value AS DOUBLE), value) AS place FROM (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'true' WHEN 1 THEN '\"beam\"' ELSE (p_size / 2)::DECIMAL(10,1)::VARCHAR END AS value FROM part)")
def parameter_values_in_order(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    half = (size / 2).cast("decimal(10,1)").cast("string")
    value = F.when(size % 4 == 0, "true").when(size % 4 == 1, '"beam"').otherwise(half)
    return table(spark, d, "part").select(value.alias("value")).distinct().withColumn("place", F.row_number().over(Window.orderBy(*browse.value_rank("value"))))  # distinct values


@query("WITH a AS (SELECT source, lang FROM documents WHERE lang IS NOT NULL), s AS (SELECT lang, count(DISTINCT source) AS n FROM a GROUP BY 1) SELECT lang FROM s WHERE n = (SELECT count(DISTINCT source) FROM a)")
def annotations_in_common(spark: SparkSession, d: str) -> DataFrame:
    return browse.common_values(table(spark, d, "documents").where("lang IS NOT NULL"), "lang", "source")


@query(f"WITH {BASE}, s AS (SELECT DISTINCT dataset, ann_key FROM gold UNION SELECT DISTINCT dataset, '@combined' FROM docs WHERE dataset < 'src5') SELECT dataset, first(ann_key ORDER BY ann_key <> '@combined', ann_key) AS ann_key FROM s GROUP BY 1")
def annotation_chosen(spark: SparkSession, d: str) -> DataFrame:
    sets = bridge.gold(spark, d).select("dataset", "ann_key")
    united = bridge.documents(spark, d).where("dataset < 'src5'").select("dataset", F.lit("@combined").alias("ann_key"))
    return browse.chosen_annotations(sets.unionByName(united))


@query(f"WITH {BASE}, e AS (SELECT DISTINCT dataset, model, arch, run_id FROM nu), p AS (SELECT * FROM e WHERE model IN ('model1', 'model9')) SELECT e.* FROM e WHERE (model, arch, run_id) IN (SELECT model, arch, run_id FROM p) OR NOT EXISTS (SELECT 1 FROM p)")
def runs_in_effect(spark: SparkSession, d: str) -> DataFrame:
    runs = bridge.predictions(spark, d).select(*scoring.RUN).distinct()
    return browse.effective_runs(runs, runs.where("model IN ('model1', 'model9')"))


@query(f"WITH {_FLAGGED}, a AS (SELECT doc_id FROM fd WHERE len(flags) > 0), b AS (SELECT doc_id FROM fd WHERE n_chars % 3 = 0) SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS n_union, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n_both, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS n_first")
def document_sets(spark: SparkSession, d: str) -> DataFrame:
    docs = _flagged(spark, d)
    a, b = docs.where(F.size("flags") > 0).select("doc_id"), docs.where("n_chars % 3 = 0").select("doc_id")
    counts = [x.agg(F.count(F.lit(1)).alias(name)) for name, x in (("n_union", a.union(b).distinct()), ("n_both", a.intersect(b)), ("n_first", a.join(b, "doc_id", "left_anti").distinct()))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each


@query(f"WITH {BASE} SELECT g.dataset, g.doc_id, coalesce(len(d.toks), -1) AS n_words FROM (SELECT DISTINCT dataset, doc_id FROM gold UNION SELECT dataset, -doc_id FROM gold WHERE doc_id % 50 = 1) g LEFT JOIN docs d ON d.dataset = g.dataset AND d.doc_id = g.doc_id")
def lengths_on_index(spark: SparkSession, d: str) -> DataFrame:
    gold = bridge.gold(spark, d).select("dataset", "doc_id").distinct()
    index = gold.unionByName(gold.where("doc_id % 50 = 1").select("dataset", (-F.col("doc_id")).alias("doc_id")))
    words = bridge.documents(spark, d).select("dataset", "doc_id", F.size("toks").alias("n_words"))
    return index.join(words, ["dataset", "doc_id"], "left").fillna(-1, ["n_words"])


@query("SELECT 'a' AS param, count(DISTINCT p_size % 4) AS n_values, 1 AS place FROM part UNION ALL SELECT 'b', count(DISTINCT p_partkey % 3), 2 FROM part")
def parameters_of_labels(spark: SparkSession, d: str) -> DataFrame:
    params = F.create_map(F.lit("a"), (F.col("p_size") % 4).cast("string"), F.lit("b"), (F.col("p_partkey") % 3).cast("string"), F.lit("same"), F.lit("1"))
    return browse.label_parameters(table(spark, d, "part").select(params.alias("params")), "params")


# Scores ------------------------------------------------------------------------------------------------------


@query(f"WITH {BASE}, r0 AS (SELECT p.dataset, p.model, p.arch, p.run_id, p.doc_id, p.kp, p.rank FROM preds p), x AS (SELECT r0.*, m.ann_key, h.kp_idx FROM r0 JOIN matches m ON m.dataset = r0.dataset AND m.run_id = r0.run_id AND m.doc_id = r0.doc_id "
       "LEFT JOIN hits h ON h.dataset = r0.dataset AND h.run_id = r0.run_id AND h.doc_id = r0.doc_id AND h.ann_key = m.ann_key AND h.rank = r0.rank), "
       "y AS (SELECT dataset, model, ann_key, CASE WHEN kp_idx IS NOT NULL THEN 'hit' ELSE 'miss' END AS label, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT dataset, model, ann_key, 'duplicate', count(*) FROM (SELECT * FROM x WHERE rank = 0) GROUP BY ALL "
       "UNION ALL SELECT dataset, model, ann_key, 'empty', count(*) FROM matches GROUP BY ALL) SELECT * FROM y")  # fmt: skip
def labels_of_predictions(spark: SparkSession, d: str) -> DataFrame:
    # Raw predictions repeat their first phrase and hold an empty one.
    preds = bridge.predictions(spark, d).withColumn("stems", F.concat("stems", F.slice("stems", 1, 1), F.array(F.lit(""))))
    rows = browse.explained(preds.withColumn("phrases", F.col("stems")), bridge.matches(spark, d))
    return rows.groupBy("dataset", "model", "ann_key", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_SC}, k AS (SELECT dataset, arch, count(DISTINCT model) AS need FROM s GROUP BY ALL), e AS (SELECT dataset, arch, doc_id, count(DISTINCT model) AS own, avg(f1) AS mean FROM s GROUP BY ALL) SELECT e.dataset, e.arch, e.doc_id, e.mean FROM e JOIN k ON k.dataset = e.dataset AND k.arch = e.arch WHERE own = need")
def means_of_replicates(spark: SparkSession, d: str) -> DataFrame:
    return browse.replicate_means(_ten(spark, d), "arch", "model", "f1")


@query(f"WITH {scored_sql()}, o AS (SELECT dataset, model, arch, run_id, avg(f1) AS f1_o, count(*) AS n FROM scored WHERE k = 'O' AND ann_key = 'author' GROUP BY ALL) SELECT o.*, rank() OVER (PARTITION BY dataset ORDER BY round(f1_o, 9) DESC) AS place FROM o")
def model_page(spark: SparkSession, d: str) -> DataFrame:
    runs = scoring.run_metrics(bridge.matches(spark, d).where("ann_key = 'author'"), ["O"]).select(*scoring.RUN, F.col("f1_mean").alias("f1_o"), "n")
    return runs.withColumn("place", F.rank().over(Window.partitionBy("dataset").orderBy(F.round("f1_o", 9).desc())))


_COSTED = (
    "obs AS (SELECT nu.dataset, nu.model, nu.arch, nu.run_id, n_uniq * 0.5 AS t, CASE WHEN nu.doc_id % 10 = 0 AND nu.model = 'model2' THEN NULL ELSE d.n_chars END AS c FROM nu JOIN docs d ON d.dataset = nu.dataset AND d.doc_id = nu.doc_id), "
    "rt(arch, unit, variable, rate) AS (VALUES ('arch0', 'usd', 'time', 2.0), ('arch0', 'usd', 'chars', 0.001), ('arch1', 'usd', 'time', 1.0), ('arch1', 'usd', 'chars', 0.002), ('arch0', 'co2', 'time', 1.0), ('arch1', 'co2', 'gpu', 1.0)), "
    "tv AS (SELECT dataset, model, arch, run_id, 'time' AS variable, sum(t) AS total, count(t) AS n, count(*) AS n_docs FROM obs GROUP BY ALL UNION ALL SELECT dataset, model, arch, run_id, 'chars', sum(c), count(c), count(*) FROM obs GROUP BY ALL), "
    "rn AS (SELECT dataset, model, arch, run_id, count(*) AS n_docs FROM obs GROUP BY ALL), "
    "pc AS (SELECT rn.dataset, rn.model, rn.arch, rn.run_id, rt.unit, rn.n_docs, sum(rate::DOUBLE * total) AS s, count(*) FILTER (total IS NULL) AS missing, count(*) FILTER (n / tv.n_docs < 0.999) AS partials FROM rn JOIN rt ON rt.arch = rn.arch LEFT JOIN tv ON tv.dataset = rn.dataset AND tv.run_id = rn.run_id AND tv.variable = rt.variable GROUP BY ALL), "
    "cs AS (SELECT dataset, model, arch, run_id, unit, n_docs, CASE WHEN missing = 0 THEN s END AS total, CASE WHEN missing = 0 THEN s / n_docs END AS per_doc, missing = 0 AS known, missing = 0 AND partials = 0 AS complete FROM pc)"
)


def _costs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    preds = bridge.predictions(spark, d).select(*scoring.RUN, "doc_id", F.size("stems").alias("n_uniq"))
    obs = preds.join(bridge.documents(spark, d).select("dataset", "doc_id", "n_chars"), ["dataset", "doc_id"])
    chars = F.when(~((F.col("doc_id") % 10 == 0) & (F.col("model") == "model2")), F.col("n_chars"))
    obs = obs.select(*scoring.RUN, F.to_json(F.struct((F.col("n_uniq") * 0.5).alias("time"), chars.alias("chars"))).alias("costs"))
    counts = obs.groupBy(*scoring.RUN).agg(F.count(F.lit(1)).alias("n_docs"), F.lit(0).alias("n_batches"))
    sums = facts.cost_sums(obs, "costs", scoring.RUN)
    declared = spark.createDataFrame([("time", "document"), ("chars", "document")], "variable string, level string")
    totals = facts.resolved_totals(sums, sums.where("false"), counts, declared)
    rates = [("arch0", "usd", "time", 2.0), ("arch0", "usd", "chars", 0.001), ("arch1", "usd", "time", 1.0), ("arch1", "usd", "chars", 0.002), ("arch0", "co2", "time", 1.0), ("arch1", "co2", "gpu", 1.0)]
    rates = spark.createDataFrame(rates, "arch string, unit string, variable string, rate double")
    return facts.priced(totals, rates, counts.drop("n_batches")), counts


@query(f"{_SC}, {_COSTED}, q AS (SELECT dataset, model, arch, run_id, avg(f1) AS m FROM s GROUP BY ALL), j AS (SELECT q.model, q.arch, q.run_id, unit, avg(m) AS quality, CASE WHEN bool_and(coalesce(known, false)) THEN avg(per_doc) END AS cost, count(*) AS n_datasets, NOT bool_and(coalesce(complete, false)) AS provisional "
       "FROM q LEFT JOIN cs ON cs.dataset = q.dataset AND cs.run_id = q.run_id GROUP BY ALL) SELECT j.*, 'per document' AS basis, cost IS NOT NULL AND NOT EXISTS (SELECT 1 FROM j o WHERE o.unit IS NOT DISTINCT FROM j.unit AND o.cost IS NOT NULL AND o.run_id <> j.run_id AND o.cost <= j.cost AND o.quality >= j.quality "
       "AND (o.cost < j.cost OR o.quality > j.quality OR o.run_id < j.run_id)) AS on_front FROM j")  # fmt: skip
def rq4_quality_cost(spark: SparkSession, d: str) -> DataFrame:
    return browse.quality_and_cost(_ten(spark, d), _costs(spark, d)[0])


@query(f"WITH {BASE}, {_COSTED} SELECT arch, unit, sum(total) AS total, count(*) FILTER (known) AS n_known, count(*) AS n_runs, first(run_id || '@' || dataset ORDER BY n_docs DESC, run_id DESC, dataset DESC) AS example FROM cs GROUP BY ALL")
def architecture_page(spark: SparkSession, d: str) -> DataFrame:
    priced, counts = _costs(spark, d)
    rows = priced.join(counts.drop("n_batches"), scoring.RUN)
    example = F.max(F.struct("n_docs", "run_id", "dataset"))
    out = rows.groupBy("arch", "unit").agg(F.sum("total").alias("total"), F.count_if("known").alias("n_known"), F.count(F.lit(1)).alias("n_runs"), example.alias("e"))
    return out.select("arch", "unit", "total", "n_known", "n_runs", F.concat("e.run_id", F.lit("@"), "e.dataset").alias("example"))


# Tests -------------------------------------------------------------------------------------------------------


@query(f"{_SC}, {_XY}, d AS (SELECT dataset, round(x - y, 12) AS d FROM xy WHERE round(x - y, 12) <> 0), k AS (SELECT dataset, d, rank() OVER (PARTITION BY dataset ORDER BY abs(d)) + (count(*) OVER (PARTITION BY dataset, abs(d)) - 1) / 2 AS rk FROM d) "
       "SELECT dataset, (coalesce(sum(rk) FILTER (d > 0), 0) - coalesce(sum(rk) FILTER (d < 0), 0)) / sum(rk) AS effect FROM k GROUP BY 1")  # fmt: skip
def effect_paired(spark: SparkSession, d: str) -> DataFrame:
    return statistics.wilcoxon(_xy(spark, d), ["dataset"]).select("dataset", comparisons.matched_rank_biserial().alias("effect"))


@query(f"{_SC}, {_COMPLETE}, k AS (SELECT *, count(*) OVER (PARTITION BY dataset, doc_id, f1) AS t, rank() OVER (PARTITION BY dataset, doc_id ORDER BY f1) + (count(*) OVER (PARTITION BY dataset, doc_id, f1) - 1) / 2 AS rk FROM cc), "
       "m AS (SELECT dataset, model, k, sum(rk) AS r, count(*) AS n, sum(t * t - 1) AS t FROM k GROUP BY ALL), a AS (SELECT dataset, max(n) AS n, k, sum((r - n * (k + 1) / 2) * (r - n * (k + 1) / 2)) AS s, sum(t)::DOUBLE AS t FROM m GROUP BY dataset, k) "
       "SELECT dataset, CASE WHEN k > 1 AND 1 - t / (n * k * (k * k - 1)) > 0 THEN 12 * s / (n * k * (k + 1)) / (1 - t / (n * k * (k * k - 1))) / (n * (k - 1)) END AS w FROM a")  # fmt: skip
def effect_concordance(spark: SparkSession, d: str) -> DataFrame:
    return statistics.friedman(_ten(spark, d), "doc_id", "model", "f1", ["dataset"]).select("dataset", comparisons.concordance().alias("w"))


@query(f"{_SC}, {_COMPLETE}, cv AS (SELECT a.dataset, a.k, a.model AS m1, b.model AS m2, covar_samp(a.f1, b.f1) AS c FROM cc a JOIN cc b ON b.dataset = a.dataset AND b.doc_id = a.doc_id GROUP BY ALL), "
       "z AS (SELECT *, c - avg(c) OVER (PARTITION BY dataset, m1) - avg(c) OVER (PARTITION BY dataset, m2) + avg(c) OVER (PARTITION BY dataset) AS s FROM cv), zt AS (SELECT dataset, k, sum(s) FILTER (m1 = m2) AS tr, sum(s * s) AS sq FROM z GROUP BY ALL) "
       "SELECT dataset, k, round(CASE WHEN k > 2 AND sq > 1e-18 THEN least(1.0, greatest(1 / (k - 1), tr * tr / ((k - 1) * sq))) ELSE 1.0 END, 6) AS eps FROM zt")  # fmt: skip
def sphericity(spark: SparkSession, d: str) -> DataFrame:
    return statistics.sphericity(_ten(spark, d), "doc_id", "model", "f1", ["dataset"]).withColumn("eps", F.round("eps", 6))


@query()
def rq1_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How far two datasets order models alike: three correlations with p, interval and p adjusted over all pairs."""
    means = _ten(spark, d).groupBy("dataset", "model").agg(F.avg("f1").alias("v"))
    x, y = means.select("model", F.col("dataset").alias("a"), F.col("v").alias("x")), means.select("model", F.col("dataset").alias("b"), F.col("v").alias("y"))
    found = comparisons.correlations(x.join(y, "model").where("a < b"), ["a", "b"])
    return comparisons.Tests().adjusted(found, "spearman_p", [], ["a", "b"])


@query()
def rq2_quality_test(spark: SparkSession, d: str) -> DataFrame:
    """Whether flagged documents score otherwise: an independent test per dataset and model, adjusted inside each dataset."""
    docs = bridge.documents(spark, d)
    flagged = facts.sided_leakage(bridge.similar_pairs(spark, d), docs, 0.7).unionByName(docs.where("n_chars < 400").select("dataset", "doc_id")).distinct()
    marked = _ten(spark, d).join(flagged.withColumn("bad", F.lit(True)), ["dataset", "doc_id"], "left").fillna({"bad": False})
    tests = comparisons.Tests()
    return tests.adjusted(tests.independent(marked, "f1", "bad", ["dataset", "model"]), "p", ["dataset"], ["model"])


@query()
def rq3_window_test(spark: SparkSession, d: str) -> DataFrame:
    """Recall of all gold against gold inside the window, on the same documents: a paired test per run."""
    m = bridge.matches(spark, d).where("ann_key = 'author'")
    rows = scoring.per_document(m.withColumn("every", F.expr("size(filter(hits, h -> h.rank < 10)) / n_gold")), ["10"], allowed=scoring.allowed_of("of", token_limit=128))
    tests = comparisons.Tests()
    found = tests.paired(rows.select("dataset", "run_id", F.col("every").alias("x"), F.col("r").alias("y")), ["dataset", "run_id"])
    return tests.adjusted(found, "p", ["dataset"], ["run_id"])


@query()
def rq5_parameter_test(spark: SparkSession, d: str) -> DataFrame:
    """Whether conditions differ on the documents that all of them scored, by ranks and by means."""
    tests = {family: comparisons.Tests(family).several(_ten(spark, d), "doc_id", "model", "f1", ["dataset"]) for family in ("rank", "mean")}
    both = [comparisons.Tests().adjusted(t.withColumn("family", F.lit(f)), "p", ["family"], ["dataset"]) for f, t in tests.items()]
    return both[0].unionByName(both[1])


@query()
def score_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Macro means of every run with bootstrap intervals."""
    return comparisons.Tests("resample").interval(_ten(spark, d), "f1", ["dataset", "run_id"])

