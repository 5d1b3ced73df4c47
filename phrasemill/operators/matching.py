"""One-to-one matching of ranked predictions to gold keyphrases by stem.

If no stem belongs to two gold phrases of a document, a prediction fits one gold phrase at most and each gold
phrase takes the smallest rank that fits: a row-wise expression on the joined stem arrays. Documents where
variants overlap need a maximum matching and go through an Arrow function; the split is decided per row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HITS = "array<struct<rank:int,gold:int>>"


def unique_in_order(stems: str | Column) -> Column:
    """Non-empty stems, each at its first place."""
    return F.array_distinct(F.filter(stems, lambda s: s != ""))


def variants_overlap(gold: str | Column) -> Column:
    """Whether a stem belongs to two of the gold phrases (arrays of variant stems)."""
    flat = F.flatten(F.transform(gold, F.array_distinct))
    return F.size(flat) > F.size(F.array_distinct(flat))


def disjoint_hits(preds: str, gold: str) -> Column:
    """Hits of unique predicted stems on gold whose variants do not overlap, in rank order.

    Each gold phrase takes the smallest rank of its variants.
    """
    rank = "array_min(filter(transform(g, s -> array_position({preds}, s)), p -> p > 0)) - 1".format(preds=preds)
    each = f"transform({gold}, (g, i) -> named_struct('rank', cast({rank} AS int), 'gold', i))"
    return F.expr(f"cast(array_sort(filter({each}, h -> h.rank IS NOT NULL)) AS {HITS})")


def maximum_matching(preds: Sequence[str], gold: Sequence[Sequence[str]]) -> list[tuple[int, int]]:
    """Maximum one-to-one matching with the earliest ranks: pairs ``(rank, gold index)`` by rank.

    Ranks enter one after the other. Each goes depth first through the gold phrases that list its stem, in their
    order: a free one is taken, the holder of a taken one looks for another place first. A phrase is tried once a
    rank, and a rank once matched stays matched. The search keeps its own stack, as chains can be long.
    """
    fits = [[i for i, variants in enumerate(gold) if stem in variants] for stem in preds]
    holder: dict[int, int] = {}
    for rank in range(len(preds)):
        tried: set[int] = set()
        path = [(rank, iter(fits[rank]))]
        wants: list[int] = []  # the phrase that each rank of the path is after
        while path:
            at, choices = path[-1]
            place = next((g for g in choices if g not in tried), None)
            if place is None:
                path.pop()
                if wants:
                    wants.pop()
                continue
            tried.add(place)
            wants.append(place)
            if place not in holder:
                for (owner, _), g in zip(path, wants, strict=True):
                    holder[g] = owner
                break
            path.append((holder[place], iter(fits[holder[place]])))
    return sorted((r, g) for g, r in holder.items())


@F.pandas_udf(T.ArrayType(T.StructType().add("rank", T.IntegerType()).add("gold", T.IntegerType())))
def _overlapping_hits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for preds, gold in batches:
        yield pd.Series([None if gs is None else [{"rank": r, "gold": g} for r, g in maximum_matching(list(p), [list(v) for v in gs])] for p, gs in zip(preds, gold, strict=True)])


def hits(preds: str, gold: str, overlap: Column) -> Column:
    """Hits of unique predicted stems on gold: an expression, and a maximum matching where variants ``overlap``.

    Rows whose variants are disjoint hand nulls to the Arrow function.
    """
    mixed = _overlapping_hits(F.when(overlap, F.col(preds)), F.when(overlap, F.col(gold)))
    return F.when(overlap, mixed).otherwise(disjoint_hits(preds, gold))


def match(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Matches of ``predictions(dataset, model, arch, run_id, doc_id, stems)`` with
    ``gold(dataset, doc_id, ann_key, stems, ...)``, whose stems are one array of variants per phrase.

    One join on the document; then row-wise. Documents without gold are left out; gold's other columns stay.
    """
    gold = gold.withColumnRenamed("stems", "gold").withColumn("__overlap", variants_overlap("gold"))
    others = [c for c in gold.columns if c not in ("dataset", "doc_id", "ann_key", "gold", "__overlap")]
    both = predictions.select("dataset", "model", "arch", "run_id", "doc_id", unique_in_order("stems").alias("preds")).join(gold, ["dataset", "doc_id"])
    return both.select("dataset", "model", "arch", "run_id", "doc_id", "ann_key", F.size("preds").alias("n_uniq"), F.size("gold").alias("n_gold"), hits("preds", "gold", F.col("__overlap")).alias("hits"), *others)


def multilingual_hits(ranked: Sequence[dict[str, str]], gold: Sequence[tuple[str, Sequence[str]]]) -> list[tuple[int, int]]:
    """Greedy hits when gold phrases are of several languages: ``ranked`` has each prediction's stem by language,
    ``gold`` each phrase's language and variants; a prediction takes the first free phrase that fits."""
    free, hits = dict(enumerate(gold)), []
    for rank, stems in enumerate(ranked):
        at = next((i for i, (lang, variants) in free.items() if stems.get(lang) and stems[lang] in variants), None)
        if at is not None:
            del free[at]
            hits.append((rank, at))
    return hits
