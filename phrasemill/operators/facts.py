"""Facts about runs: coverage, costs, parameters, aliases, tags, issues, quality flags, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phrasemill.operators.scoring import RUN, is_eval_split

#: Fixed value: a level of observations is complete from this coverage on.
COMPLETE = 0.999
#: Tokens that name no architecture.
UNKNOWN = ("n.a", "na", "n/a", "none", "unknown", "null", "-", "")


def first_line_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def duplicate_groups(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Keys of several rows: the first place and the number of rows beyond it."""
    return df.groupBy(*key).agg(F.min(order).alias("first_at"), (F.count(F.lit(1)) - 1).alias("n_extra")).where("n_extra > 0")


def majority_split(predictions: DataFrame, documents: DataFrame) -> DataFrame:
    """Per run: scored documents by split, the split of most of them (ties: the smaller name), its size and coverage.

    ``predictions(dataset, model, arch, run_id, doc_id)``, ``documents(dataset, doc_id, split)``; training
    splits do not count.
    """
    evaluated = documents.where(is_eval_split("split")).select("dataset", "doc_id", F.coalesce("split", F.lit("")).alias("split"))
    sizes = evaluated.groupBy("dataset", "split").agg(F.count_distinct("doc_id").alias("expected"))
    per = predictions.select(*RUN, "doc_id").distinct().join(evaluated, ["dataset", "doc_id"]).groupBy(*RUN, "split").agg(F.count(F.lit(1)).alias("c"))
    top = per.groupBy(*RUN).agg(F.min(F.struct((-F.col("c")).alias("c"), "split")).alias("top"), F.count(F.lit(1)).alias("n_splits"))
    out = top.select(*RUN, F.col("top.split").alias("split"), (-F.col("top.c")).alias("covered"), "n_splits")
    return out.join(sizes, ["dataset", "split"], "left").withColumn("coverage", F.try_divide("covered", "expected"))


def id_counts(predictions: DataFrame, documents: DataFrame, matches: DataFrame) -> DataFrame:
    """Per run: lines, documents, ids that no document has, documents with matches, and those left unscored."""
    ids = documents.select("dataset", "doc_id").distinct().withColumn("known", F.lit(True))
    seen = predictions.join(ids, ["dataset", "doc_id"], "left").groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct(F.when(F.col("known").isNull(), F.col("doc_id"))).alias("n_unknown")
    )
    scored = matches.groupBy(*RUN).agg(F.count_distinct("doc_id").alias("n_scored"))
    out = seen.join(scored, RUN, "left").fillna({"n_scored": 0})
    return out.withColumn("n_unscored", F.greatest(F.col("n_docs") - F.col("n_unknown") - F.col("n_scored"), F.lit(0)))


def cost_sums(observations: DataFrame, costs: str, by: Sequence[str]) -> DataFrame:
    """``by, variable, total, n``: sums and counts of the numbers in a JSON object column, whatever its keys."""
    pairs = observations.select(*by, F.explode(F.from_json(costs, "map<string,string>")).alias("variable", "value"))
    number = F.expr("try_cast(value AS DOUBLE)")
    return pairs.groupBy(*by, "variable").agg(F.sum(number).alias("total"), F.count(number).alias("n"))


def resolved_totals(doc_sums: DataFrame, batch_sums: DataFrame, counts: DataFrame, declared: DataFrame, wall: DataFrame | None = None) -> DataFrame:
    """One total per run and variable.

    ``doc_sums`` and ``batch_sums`` ``(run, variable, total, n)``, ``counts(run, n_docs, n_batches)``,
    ``declared(variable, level)``. The declared level counts if it is complete, else the other one if it is, else
    the better covered one, flagged partial; a level other than the declared one is flagged. ``wall(run, wall_s)``
    stands in for ``time`` where nothing was observed.
    """
    run = [c for c in counts.columns if c not in ("n_docs", "n_batches")]
    both = doc_sums.select(*run, "variable", F.col("total").alias("ds"), F.col("n").alias("dn")).join(
        batch_sums.select(*run, "variable", F.col("total").alias("bs"), F.col("n").alias("bn")), [*run, "variable"], "full"
    )
    if wall is not None:
        names = wall.select(*run, F.lit("time").alias("variable"))
        both = both.join(names, [*run, "variable"], "full")
    both = both.join(counts, run).join(F.broadcast(declared), "variable", "left").fillna({"dn": 0, "bn": 0})
    both = both.join(wall, run, "left") if wall is not None else both.withColumn("wall_s", F.lit(None).cast("double"))
    dc = F.coalesce(F.try_divide("dn", "n_docs"), F.lit(0.0))
    bc = F.coalesce(F.try_divide("bn", "n_batches"), F.lit(0.0))
    doc_first = F.when(F.col("level").isNotNull(), F.col("level") == "document").otherwise(F.col("dn") > 0)
    doc_full, batch_full = (F.col("dn") > 0) & (dc >= COMPLETE), (F.col("bn") > 0) & (bc >= COMPLETE)
    pick = (
        F.when(doc_first & doc_full, "document").when(~doc_first & batch_full, "batch").when(doc_full, "document").when(batch_full, "batch")
        .when((F.col("dn") > 0) & ((F.col("bn") == 0) | (dc > bc) | ((dc == bc) & doc_first)), "document").when(F.col("bn") > 0, "batch")
    )
    out = both.withColumn("used", pick).withColumn("dc", F.bround(dc, 4)).withColumn("bc", F.bround(bc, 4))
    derived = F.col("used").isNull() & (F.col("variable") == "time") & (F.coalesce("wall_s", F.lit(0.0)) > 0)
    partial = F.when(F.col("used") == "document", dc).when(F.col("used") == "batch", bc) < COMPLETE
    return out.select(
        *run, "variable",
        F.when(F.col("used") == "document", F.col("ds")).when(F.col("used") == "batch", F.col("bs")).when(derived, F.col("wall_s")).alias("total"),
        F.coalesce("used", F.when(derived, "batch")).alias("level"), F.col("dc").alias("doc_cov"), F.col("bc").alias("batch_cov"),
        F.coalesce(F.col("used") != F.col("level"), F.lit(False)).alias("level_fallback"), F.coalesce(partial, F.lit(False)).alias("partial"), derived.alias("derived"),
    ).where("total IS NOT NULL")


def priced(totals: DataFrame, rates: DataFrame, runs: DataFrame) -> DataFrame:
    """``run, unit, total, per_doc, known, complete``: linear rates over variable totals.

    ``rates(arch, unit, variable, rate)``, ``runs(run..., n_docs)`` with ``arch``. A missing variable makes the
    total unknown, never zero; a zero rate needs nothing.
    """
    run = [c for c in runs.columns if c != "n_docs"]
    needed = runs.join(F.broadcast(rates.where("rate <> 0")), "arch").join(totals.select(*run, "variable", F.col("total").alias("v"), "partial"), [*run, "variable"], "left")
    out = needed.groupBy(*run, "unit", "n_docs").agg(F.sum(F.col("rate") * F.col("v")).alias("s"), F.count_if(F.col("v").isNull()).alias("missing"), F.count_if("partial").alias("partials"))
    total = F.when(F.col("missing") == 0, F.col("s"))
    return out.select(*run, "unit", total.alias("total"), F.try_divide(total, F.col("n_docs")).alias("per_doc"), (F.col("missing") == 0).alias("known"), ((F.col("missing") == 0) & (F.col("partials") == 0)).alias("complete"))


def resolved_parameters(runs: DataFrame, specs: DataFrame) -> DataFrame:
    """``model, run_id, param, value, source, problem`` of every declared and every given parameter.

    ``runs(model, run_id, params map<string,string>)``, values as JSON; ``specs(model, param, type, allowed
    array<string>, lo, hi, fallback)``. Sources: given, default, missing. An unknown type can't be checked and is
    a problem; so is a parameter that the card does not declare.
    """
    given = runs.select("model", "run_id", F.explode_outer("params").alias("param", "given")).where("param IS NOT NULL")
    declared = runs.select("model", "run_id").join(F.broadcast(specs), "model")
    out = declared.withColumn("declared", F.lit(True)).join(given, ["model", "run_id", "param"], "full")
    value = F.coalesce("given", "fallback")
    out = out.withColumn("value", value)
    is_int, is_num = F.col("value").rlike(r"^-?[0-9]+$"), F.col("value").rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$")
    is_str, is_list, is_bool = F.col("value").rlike('^".*"$'), F.col("value").rlike(r"^\[.*\]$"), F.col("value").isin("true", "false")
    number = F.expr("try_cast(value AS DOUBLE)")
    listed = F.coalesce(F.array_contains("allowed", F.col("value")), F.lit(True))
    members = F.from_json("value", "array<string>")
    wrong = (
        F.when(~F.coalesce("declared", F.lit(False)), "undeclared").when(F.col("value").isNull(), None)
        .when(~F.col("type").isin("int", "float", "context_window", "bool", "str", "set"), "unknown type")
        .when(F.col("type").isin("int", "context_window") & ~is_int, "type").when((F.col("type") == "float") & ~is_num, "type")
        .when((F.col("type") == "bool") & ~is_bool, "type").when((F.col("type") == "str") & ~is_str, "type").when((F.col("type") == "set") & ~is_list, "type")
        .when((F.col("type") == "set") & F.col("allowed").isNotNull() & (F.size(F.array_except(members, "allowed")) > 0), "value")
        .when((F.col("type") != "set") & ~listed, "value").when(number < F.col("lo"), "min").when(number > F.col("hi"), "max")
    )
    source = F.when(F.col("given").isNotNull(), "given").when(F.col("fallback").isNotNull(), "default").otherwise("missing")
    return out.select("model", "run_id", "param", "value", source.alias("source"), wrong.alias("problem"))


def resolved_names(tokens: DataFrame, cards: DataFrame) -> DataFrame:
    """``token, card``: exact name, else the one card whose normalised name or alias fits; null for none.

    ``tokens(token)``, ``cards(card, aliases array<string>)``; several fits go to the smaller name.
    """
    def plain(c: str | Column) -> Column:
        return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")

    names = cards.select("card", F.explode(F.concat(F.array("card"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    loose = names.groupBy(plain("alias").alias("key")).agg(F.min("card").alias("loose")).where("key <> ''")
    out = tokens.select("token").distinct().join(F.broadcast(cards.select(F.col("card").alias("token"), F.col("card").alias("exact"))), "token", "left")
    return out.join(F.broadcast(loose), plain("token") == F.col("key"), "left").select("token", F.coalesce("exact", F.when(~F.lower(F.trim("token")).isin(*UNKNOWN), F.col("loose"))).alias("card"))


def run_tags(facts: DataFrame) -> DataFrame:
    """``run, tags``: what is wrong with each run, from its facts (coverage, unknown ids, unscored, splits, parameters)."""
    tags = F.array(
        F.when(~F.col("has_card"), "missing:run"),
        F.when(F.lower("arch").isin(*UNKNOWN), "missing:architecture"),
        F.when(F.col("coverage") < COMPLETE, F.concat(F.lit("incomplete:"), F.bround(100 * F.col("coverage"), 0).cast("int").cast("string"), F.lit("%"))),
        F.when(F.col("n_unknown") > 0, F.concat(F.lit("unresolved_ids:"), F.col("n_unknown").cast("string"))),
        F.when(F.col("n_unscored") > 0, F.concat(F.lit("unscored:"), F.col("n_unscored").cast("string"))),
        F.when(F.col("n_splits") > 1, F.concat(F.lit("multi_split:"), F.col("n_splits").cast("string"))),
        *([F.when(F.col("n_repeated") > 0, F.concat(F.lit("duplicate_docs:"), F.col("n_repeated").cast("string")))] if "n_repeated" in facts.columns else []),
    )
    return facts.select(*RUN, F.filter(tags, lambda t: t.isNotNull()).alias("tags"))


def issue_rollup(tags: DataFrame) -> DataFrame:
    """``kind, n_runs, n_datasets, lo, hi``: one row per kind of tag, with the span of its number."""
    one = tags.select(*RUN, F.explode("tags").alias("tag")).withColumn("kind", F.split("tag", ":", 2)[0])
    number = F.expr("try_cast(regexp_extract(tag, '([0-9]+)%?$', 1) AS INT)")
    return one.groupBy("kind").agg(F.count_distinct(F.struct(*RUN)).alias("n_runs"), F.count_distinct("dataset").alias("n_datasets"), F.min(number).alias("lo"), F.max(number).alias("hi"))


def timestamp(text: str | Column) -> Column:
    """ISO (with Z, offset or fraction) or ``YYYY/MM/DD hh:mm:ss`` as a naive UTC time; null if it is neither."""
    return F.try_to_timestamp(F.regexp_replace(text, r"^(\d{4})/(\d{2})/(\d{2})", "$1-$2-$3")).cast("timestamp_ntz")


def batch_rollup(batches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Batches, first start, last end and summed seconds of ``batches(t_start, t_end)``."""
    seconds = F.col("t_end").cast("double") - F.col("t_start").cast("double")
    return batches.groupBy(*by).agg(F.count(F.lit(1)).alias("n_batches"), F.sum(seconds).alias("wall_s"), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"))


def sided_leakage(pairs: DataFrame, documents: DataFrame, least: float, label: str | None = None) -> DataFrame:
    """Documents with a counterpart in a training split: both sides of ``pairs``, at least so similar."""
    if label is not None:
        pairs = pairs.where(F.coalesce("label", F.lit("(unlabelled)")) == label)
    near = pairs.where(F.col("score") >= least)
    one, two = (("a", "b"), ("b", "a"))
    sides = [near.select(*[F.col(f"{c}_{s[0]}").alias(c) for c in ("dataset", "doc_id")], *[F.col(f"{c}_{s[1]}").alias(f"other_{c}") for c in ("dataset", "doc_id")]) for s in (one, two)]
    train = documents.where(~is_eval_split("split")).select(F.col("dataset").alias("other_dataset"), F.col("doc_id").alias("other_doc_id"))
    return sides[0].unionByName(sides[1]).join(train, ["other_dataset", "other_doc_id"], "left_semi").select("dataset", "doc_id").distinct()


def flag_delta(scores: DataFrame, flagged: DataFrame, by: Sequence[str], value: str = "f1") -> DataFrame:
    """Means over all, unflagged and flagged documents, and their numbers."""
    marked = scores.join(flagged.select("dataset", "doc_id").distinct().withColumn("bad", F.lit(True)), ["dataset", "doc_id"], "left").fillna({"bad": False})
    good, bad = F.when(~F.col("bad"), F.col(value)), F.when(F.col("bad"), F.col(value))
    return marked.groupBy(*by).agg(F.avg(value).alias("all_mean"), F.avg(good).alias("clean_mean"), F.avg(bad).alias("flagged_mean"), F.count(good).alias("n_clean"), F.count(bad).alias("n_flagged"))


def gold_aggregates(gold: DataFrame) -> DataFrame:
    """Counts and word sums of gold by dataset, split, annotation set, class and length (6 and more together)."""
    return gold.groupBy("dataset", "split", "ann_key", "prmu", F.least("n_words", F.lit(6)).alias("n_words_b")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words_sum"))


def shares(df: DataFrame, by: Sequence[str], kind: str, n: str = "n") -> DataFrame:
    """``by, kind, n, share``: sums and their parts of the group's total."""
    sums = df.groupBy(*by, kind).agg(F.sum(n).alias("n"))
    return sums.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def histogram(df: DataFrame, value: str, by: Sequence[str], bins: int = 20, upper: float = 0.995) -> DataFrame:
    """Counts in at most ``bins`` bins of whole width up to a quantile; the last bin holds what is beyond."""
    span = df.groupBy(*by).agg(F.min(value).alias("lo"), F.percentile(value, F.lit(upper)).alias("hi"))
    width = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / bins))
    rows = df.join(span, list(by)).withColumn("width", width)
    at = F.least(F.floor((F.col(value) - F.col("lo")) / F.col("width")), F.floor((F.col("hi") - F.col("lo")) / F.col("width")))
    return rows.groupBy(*by, "lo", "width", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top_and_other(df: DataFrame, kind: str, by: Sequence[str], k: int = 4) -> DataFrame:
    """Counts by kind, all but the ``k`` most frequent kinds (ties: by name) folded into Other."""
    counted = df.groupBy(*by, kind).agg(F.count(F.lit(1)).alias("n")).where(F.col(kind).isNotNull())
    top = counted.groupBy(kind).agg(F.sum("n").alias("t")).orderBy(F.desc("t"), kind).limit(k).select(F.col(kind).alias("top"))
    named = counted.join(F.broadcast(top), F.col(kind) == F.col("top"), "left")
    return named.groupBy(*by, F.coalesce("top", F.lit("Other")).alias(kind)).agg(F.sum("n").alias("n"))


def natural_page(df: DataFrame, key: str, size: int = 15, page: int = 0) -> DataFrame:
    """One page in natural order: text before a trailing number, then the number, then the whole."""
    text = F.col(key).cast("string")
    number = F.expr(f"try_cast(regexp_extract(cast(`{key}` AS string), '([0-9]+)$', 1) AS BIGINT)")
    return df.orderBy(F.regexp_replace(text, "[0-9]+$", ""), number.asc_nulls_first(), text).offset(size * page).limit(size)


def updated(table: DataFrame, changes: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A table with the columns of matching rows replaced; rows without a change, and null changes, keep theirs."""
    new = changes.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    return table.join(new, list(key), "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def on_every(df: DataFrame, key: Sequence[str], over: str, among: DataFrame | None = None) -> DataFrame:
    """Relational division: keys that occur with every value of ``over`` (or every value that ``among`` holds)."""
    if among is not None:
        df = df.join(among.select(over).distinct(), over, "left_semi")
    need = (df if among is None else among).agg(F.count_distinct(over).alias("need"))
    return df.groupBy(*key).agg(F.count_distinct(over).alias("seen")).crossJoin(F.broadcast(need)).where("seen = need").select(*key)  # one row


def length_curve(df: DataFrame, x: str, value: str, by: Sequence[str], most: int = 8, least: int = 3, each: int = 12) -> DataFrame:
    """``by, bin, n, lo, hi, mean``: means of ``value`` in bins of about equal counts along ``x``.

    A bin ends where ``x`` changes, so that equal lengths share one; a last bin of less than half the aim joins the
    one before it. Rows are counted by ``x`` before any window.
    """
    group = Window.partitionBy(*by)
    upto = group.orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = df.groupBy(*by, x).agg(F.count(F.lit(1)).alias("c"), F.sum(value).alias("t"))
    v = v.withColumn("n", F.sum("c").over(group)).withColumn("before", F.sum("c").over(upto) - F.col("c"))
    v = v.withColumn("bins", F.least(F.lit(most), F.greatest(F.lit(least), F.floor(F.col("n") / each))).cast("int"))
    places = F.transform(F.sequence(F.lit(1), F.col("bins") - 1), lambda b: F.least(F.bround(b * (F.col("n") / F.col("bins")), 0), F.col("n") - 1))
    opens = (F.col("before") > 0) & F.exists(places, lambda at: (at >= F.col("before")) & (at < F.col("before") + F.col("c")))
    v = v.withColumn("bin", F.sum(opens.cast("int")).over(upto))
    bins = v.groupBy(*by, "bin", "n", "bins").agg(F.sum("c").alias("c"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.sum("t").alias("t"))
    short = (F.col("bin") == F.max("bin").over(group)) & (F.col("bin") > 0) & (F.col("c") < F.greatest(F.lit(2), F.floor(F.col("n") / F.col("bins") / 2)))
    bins = bins.withColumn("bin", F.when(short, F.col("bin") - 1).otherwise(F.col("bin")).cast("int"))
    return bins.groupBy(*by, "bin").agg(F.sum("c").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum("t") / F.sum("c")).alias("mean"))


def controlled_sweeps(runs: DataFrame, params: str, by: Sequence[str]) -> DataFrame:
    """``by, param, rest, n_values, runs``: groups in which one parameter varies and all others are equal."""
    entries = F.array_sort(F.map_entries(params))
    one = runs.select(*by, "run_id", entries.alias("all"), F.explode(entries).alias("own"))
    rest = F.to_json(F.filter("all", lambda e: e["key"] != F.col("own.key")))
    out = one.groupBy(*by, F.col("own.key").alias("param"), rest.alias("rest")).agg(F.count_distinct("own.value").alias("n_values"), F.array_join(F.array_sort(F.collect_set("run_id")), ",").alias("runs"))
    return out.where("n_values > 1")


def merged(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Upsert: new rows, and old ones whose key is not replaced."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-independent content hash of a table: row count and sum of row hashes."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("hash"))
