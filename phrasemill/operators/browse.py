"""What pages ask for: filters on documents, orders of names, choices of runs and annotation sets, labels of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phrasemill.operators.scoring import CLASSES, RUN

#: The place of split names in the order of a pipeline; other names follow.
SPLIT_ORDER = {"training": 0, "train": 0, "validation": 1, "valid": 1, "val": 1, "dev": 1, "development": 1, "testing": 2, "test": 2, "eval": 2}
COMBINED = "@combined"


def with_flags(docs: DataFrame, flags: Sequence[str], column: str = "flags") -> DataFrame:
    """Documents that have all of the flags."""
    for flag in flags:
        docs = docs.where(F.array_contains(column, flag))
    return docs


def flagged_like(column: str, prefix: str) -> Column:
    """Whether a flag begins with ``prefix``."""
    return F.exists(column, lambda f: f.startswith(prefix))


def id_like(docs: DataFrame, part: str, column: str = "doc_id") -> DataFrame:
    """Documents whose id holds ``part`` in any case; ``%`` and ``_`` stand for any text and any character."""
    return docs.where(F.col(column).ilike(f"%{part}%"))


def natural_key(name: str | Column) -> Column:
    """Sort key of a name: its runs of text in lower case and of digits by turns, digits as numbers before text."""
    name = (F.col(name) if isinstance(name, str) else name).cast("string")
    parts = F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    # A text part is before a number part where names begin differently, so every key starts with text.
    parts = F.when(name.rlike("^[0-9]"), F.concat(F.array(F.lit("")), parts)).otherwise(parts)
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike("^[0-9]"), p.cast("double")).alias("number"), F.when(~p.rlike("^[0-9]"), F.lower(p)).alias("text")))


def value_rank(value: str | Column) -> list[Column]:
    """Sort columns of parameter values as JSON: numbers by size, then booleans, then names in natural order."""
    value = F.col(value) if isinstance(value, str) else value
    number = F.when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), value.cast("double"))
    return [F.when(number.isNotNull(), 0).when(value.isin("true", "false"), 1).otherwise(2), number, natural_key(value)]


def split_rank(split: str | Column) -> Column:
    split = F.lower(F.trim(F.coalesce(F.col(split) if isinstance(split, str) else split, F.lit(""))))
    known = F.create_map(*[F.lit(x) for kv in SPLIT_ORDER.items() for x in kv])
    return F.coalesce(known[split], F.lit(9))


def common_values(df: DataFrame, value: str, over: str) -> DataFrame:
    """Values that occur with every value of ``over`` that the table holds."""
    need = df.agg(F.count_distinct(over).alias("need"))
    seen = df.groupBy(value).agg(F.count_distinct(over).alias("seen"))
    return seen.crossJoin(F.broadcast(need)).where("seen = need").select(value)  # one row


def chosen_annotations(sets: DataFrame, chosen: str = "auto") -> DataFrame:
    """``dataset, ann_key``: the annotation set of each dataset; auto takes the united one, else the first by name."""
    own = sets.select("dataset", "ann_key").distinct()
    if chosen != "auto":
        return own.where(F.col("ann_key") == chosen)
    return own.groupBy("dataset").agg(F.min_by("ann_key", F.struct(F.when(F.col("ann_key") == COMBINED, 0).otherwise(1), "ann_key")).alias("ann_key"))


def effective_runs(eligible: DataFrame, picked: DataFrame, key: Sequence[str] = tuple(RUN[1:])) -> DataFrame:
    """Picked runs that are eligible; all eligible ones if none is left."""
    own = eligible.join(picked.select(*key).distinct(), list(key), "left_semi")
    any_ = own.agg((F.count(F.lit(1)) > 0).alias("__any"))  # one row
    marked = eligible.join(picked.select(*key).distinct().withColumn("__in", F.lit(True)), list(key), "left").crossJoin(F.broadcast(any_))
    return marked.where("NOT __any OR __in").drop("__any", "__in")


def class_filter(classes: Sequence[str] | None) -> list[str] | None:
    """The presence classes to filter by: none for no choice or all of them; an empty choice keeps nothing."""
    if classes is None or set(classes) >= set(CLASSES):
        return None
    return [c for c in CLASSES if c in classes]


def explained(predictions: DataFrame, matches: DataFrame) -> DataFrame:
    """``run, doc_id, ann_key, place, phrase, rank, gold, label`` of every raw prediction.

    ``predictions(run, doc_id, phrases, stems)``, stems beside the phrases; labels: hit, miss, duplicate (an earlier one
    has its stems) or empty (it has none).
    """
    rows = predictions.select(*RUN, "doc_id", F.array_distinct(F.filter("stems", lambda s: s != "")).alias("unique"), F.posexplode_outer(F.arrays_zip("phrases", "stems")).alias("place", "p"), "stems")
    rows = rows.where("place IS NOT NULL").withColumn("first", F.array_position("stems", F.col("p.stems")) - 1 == F.col("place"))
    rows = rows.select(*RUN, "doc_id", "place", F.col("p.phrases").alias("phrase"), F.col("p.stems").alias("stem"), F.when(F.col("first") & (F.col("p.stems") != ""), F.array_position("unique", F.col("p.stems")).cast("int") - 1).alias("rank"))
    out = rows.join(matches.select(*RUN, "doc_id", "ann_key", "hits"), [*RUN, "doc_id"])
    gold = F.get(F.filter("hits", lambda h: h["rank"] == F.col("rank")), F.lit(0))["gold"]
    label = F.when(F.col("stem") == "", "empty").when(F.col("rank").isNull(), "duplicate").when(gold.isNotNull(), "hit").otherwise("miss")
    return out.select(*RUN, "doc_id", "ann_key", "place", "phrase", "rank", gold.alias("gold"), label.alias("label"))


def mean_and_spread(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """``by, n, mean, sd``: the sample deviation, 0 for one value."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))


def map_of(df: DataFrame, by: Sequence[str], key: str, value: Column | str) -> DataFrame:
    """``by, map``: one entry per key; keys are few (sections, annotation sets)."""
    entry = F.struct(F.col(key).alias("key"), (F.col(value) if isinstance(value, str) else value).alias("value"))
    return df.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("map"))


def replicate_means(scores: DataFrame, condition: str, replicate: str, value: str, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """``by, condition, doc_id, mean``: a document's mean over the replicates of a condition that all of them scored."""
    need = scores.groupBy(*by, condition).agg(F.count_distinct(replicate).alias("need"))
    each = scores.groupBy(*by, condition, "doc_id").agg(F.count_distinct(replicate).alias("own"), F.avg(value).alias("mean"))
    return each.join(need, [*by, condition]).where("own = need").select(*by, condition, "doc_id", "mean")


def label_parameters(runs: DataFrame, params: str) -> DataFrame:
    """``param, n_values, place``: parameters that tell runs apart, those of most values first."""
    values = runs.select(F.explode(params).alias("param", "value")).groupBy("param").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")
    return values.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_values"), "param")))  # one row a parameter name


def value_cell(value: Column, lo: Column, hi: Column, n: Column, marked: Column) -> Column:
    """A table's cell as a struct."""
    return F.struct(value.alias("v"), lo.alias("lo"), hi.alias("hi"), n.alias("n"), marked.alias("marked"))


def quality_and_cost(scores: DataFrame, costs: DataFrame, value: str = "f1", system: Sequence[str] = ("model", "arch", "run_id")) -> DataFrame:
    """``system, unit, quality, cost, n_datasets, basis, provisional, on_front``.

    ``scores(dataset, system, value)``: one row a document; ``costs(dataset, system, unit, per_doc, known, complete)``. Both are
    macro means over the datasets that have them; an unknown cost on any dataset makes the system's unknown, an
    incomplete one provisional. Nothing at most as expensive is as good as a system on the front.
    """
    from phrasemill.operators import statistics

    quality = scores.groupBy("dataset", *system).agg(F.avg(value).alias("m"))
    both = quality.join(costs, ["dataset", *system], "left")
    out = both.groupBy(*system, "unit").agg(
        F.avg("m").alias("quality"), F.when(F.min(F.coalesce("known", F.lit(False))), F.avg("per_doc")).alias("cost"), F.count(F.lit(1)).alias("n_datasets"), (~F.min(F.coalesce("complete", F.lit(False)))).alias("provisional")
    )
    return statistics.pareto(out.withColumn("basis", F.lit("per document")), "cost", "quality", ["unit"], list(system))
