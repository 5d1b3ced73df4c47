"""Precision, recall and F1 at any cut-off, under any gold or document filter.

``matches(dataset, model, arch, run_id, doc_id, ann_key, n_uniq, n_gold, hits)`` holds one row per run, document
and annotation set; ``hits`` is an array of ``(rank, gold)`` structs in rank order. Scores are row-wise
expressions over it, so a whole scoring is a scan and one grouped aggregate. A gold filter joins one row per
document and annotation set: the allowed gold indices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = ["dataset", "model", "arch", "run_id"]
DOC = ["dataset", "doc_id", "ann_key"]
CUTOFFS = ("5", "10", "O", "M")
CLASSES = ("P", "R", "M", "U")
#: Fixed value: split names that do not count as evaluation data.
TRAIN_SPLIT = r"^train(ing)?([_-].*)?$"
#: Ids to include or exclude are broadcast up to this many; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def is_eval_split(split: str | Column) -> Column:
    """Whether a split is evaluated: anything, null included, but names of training splits."""
    split = F.col(split) if isinstance(split, str) else split
    return ~F.lower(F.trim(F.coalesce(split, F.lit("")))).rlike(TRAIN_SPLIT)


def _cut(k: str | Column, n_gold: Column, n_uniq: Column) -> Column:
    k = F.lit(k) if isinstance(k, str) else k
    return F.when(k == "O", n_gold).when(k == "M", F.greatest(n_uniq, F.lit(1))).otherwise(F.expr("try_cast(k AS INT)") if not isinstance(k, str) else k.cast("int"))


def _scored(df: DataFrame, allowed: Column | None) -> DataFrame:
    """Adds p, r and f1 to rows with ``k``, ``n_al``, ``n_uniq`` and ``hits``."""
    df = df.withColumn("cut", _cut(F.col("k"), F.col("n_al"), F.col("n_uniq")))

    def counts(hit: Column) -> Column:
        inside = hit["rank"] < F.col("cut")
        return inside if allowed is None else inside & F.array_contains(allowed, hit["gold"])

    tp = F.size(F.filter("hits", counts)).cast("double")
    dp = F.when(F.col("n_uniq") > 0, F.least("cut", "n_uniq")).otherwise(0)
    df = df.withColumn("tp", tp).withColumn("dp", dp)
    df = df.withColumn("p", F.when(F.col("dp") > 0, F.col("tp") / F.col("dp")).otherwise(0.0)).withColumn("r", F.col("tp") / F.col("n_al"))
    return df.withColumn("f1", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))


def per_document(
    matches: DataFrame,
    cutoffs: Sequence[str] = CUTOFFS,
    allowed: DataFrame | Column | None = None,
    include: DataFrame | None = None,
    exclude: DataFrame | None = None,
) -> DataFrame:
    """Scores of every run, document, annotation set and cut-off that has gold left.

    ``allowed(dataset, doc_id, ann_key, allowed)`` restricts the gold (see ``allowed_gold``), or a column of the row's
    own (see ``allowed_of``), which needs no join; ``include`` and ``exclude`` hold ``(dataset, doc_id)``. An empty include list means no document, not no filter.
    """
    base = _base(matches, allowed, include, exclude).where("n_al > 0")
    return _scored(base.withColumn("k", F.explode(F.array(*map(F.lit, cutoffs)))), F.col("allowed") if allowed is not None else None)


def skipped(matches: DataFrame, allowed: DataFrame | Column | None = None, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Documents per run and annotation set that have no gold left."""
    base = _base(matches, allowed, include, exclude)
    return base.groupBy(*RUN, "ann_key").agg(F.count_if(F.col("n_al") <= 0).alias("n_skipped"))


def allowed_of(gold: str, classes: Sequence[str] | None = None, require_position: bool = False, token_limit: int | None = None) -> Column:
    """As ``allowed_gold`` for rows that hold their gold: indices of ``gold``, an array of ``(prmu, end_char, tok_end)`` structs."""
    tests = ["true"]
    if classes is not None:
        tests.append("coalesce(g.prmu, 'U') IN ({})".format(", ".join(f"'{c}'" for c in classes)) if classes else "false")
    if require_position:
        tests.append("coalesce(g.end_char, -1) >= 0")
    if token_limit is not None:
        tests.append(f"coalesce(g.tok_end <= {int(token_limit)}, false)")
    return F.expr(f"filter(transform({gold}, (g, i) -> CASE WHEN {' AND '.join(tests)} THEN i END), i -> i IS NOT NULL)")


def _base(matches: DataFrame, allowed: DataFrame | Column | None, include: DataFrame | None, exclude: DataFrame | None) -> DataFrame:
    for ids, how in ((include, "left_semi"), (exclude, "left_anti")):
        if ids is not None:
            few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
            matches = matches.join(F.broadcast(ids) if few else ids, ["dataset", "doc_id"], how)
    if allowed is None:
        return matches.withColumn("n_al", F.col("n_gold"))
    if isinstance(allowed, Column):
        return matches.withColumn("allowed", allowed).withColumn("n_al", F.size("allowed"))
    return matches.join(allowed, DOC, "left").withColumn("n_al", F.coalesce(F.size("allowed"), F.lit(0)))


def allowed_gold(
    gold: DataFrame,
    classes: Sequence[str] | None = None,
    require_position: bool = False,
    positions: DataFrame | None = None,
    token_limit: int | None = None,
) -> DataFrame:
    """Gold indices that a filter keeps, one row per document and annotation set.

    ``classes``: presence classes, an unknown one counting as U; ``require_position``: the phrase was located;
    ``positions(dataset, doc_id, ann_key, kp_idx, tok_end)`` with ``token_limit``: it ends inside the window.
    """
    if classes is not None:
        gold = gold.where(F.coalesce("prmu", F.lit("U")).isin(*classes))
    if require_position:
        gold = gold.where(F.coalesce("end_char", F.lit(-1)) >= 0)
    if positions is not None:
        gold = gold.join(positions.where(F.col("tok_end") <= token_limit).select(*DOC, "kp_idx"), [*DOC, "kp_idx"])
    return gold.groupBy(*DOC).agg(F.collect_set("kp_idx").alias("allowed"))


def run_metrics(matches: DataFrame, cutoffs: Sequence[str] = CUTOFFS, **filters) -> DataFrame:
    """Macro averages of every run, annotation set and cut-off."""
    return per_document(matches, cutoffs, **filters).groupBy(*RUN, "ann_key", "k").agg(
        F.avg("f1").alias("f1_mean"), F.avg("p").alias("p_mean"), F.avg("r").alias("r_mean"), F.count(F.lit(1)).alias("n")
    )


def document_ordinals(gold: DataFrame) -> DataFrame:
    """0-based position of every document of a dataset by id. Joins on ids scale; this is for ordered output."""
    from pyspark.sql import Window

    return gold.select("dataset", "doc_id").distinct().withColumn("ord", F.row_number().over(Window.partitionBy("dataset").orderBy("doc_id")) - 1)


def paired(scores: DataFrame, first: Column, second: Column, value: str = "f1") -> DataFrame:
    """``dataset, doc_id, x, y``: a value of two conditions on the documents that both have."""
    x = scores.where(first).select("dataset", "doc_id", F.col(value).alias("x"))
    y = scores.where(second).select("dataset", "doc_id", F.col(value).alias("y"))
    return x.join(y, ["dataset", "doc_id"])


def common_documents(scores: DataFrame, condition: str, n_conditions: int) -> DataFrame:
    """Documents that every one of ``n_conditions`` conditions has scored."""
    seen = scores.groupBy("dataset", "doc_id").agg(F.count_distinct(condition).alias("n"))
    return seen.where(F.col("n") == n_conditions).select("dataset", "doc_id")
