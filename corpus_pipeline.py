"""Corpus pipeline over ``documents``: language, near duplicates, benchmark leaks, personal data, pieces.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; all but the last
return the columns of documents. ``run`` writes each stage's result to the cluster's shared folder and reads it
again, so that a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.llm import decontaminate, language_id, ngram_join, pieces, pii
from phrasemill.llm.common import discard, sized, stored, table

#: A document is rejected below this score of its language; texts without letters have none.
MIN_LANGUAGE_SCORE = 0.5
#: Near duplicates: five-word shingles, Jaccard similarity of 0.8 or more.
SHINGLE, P, Q = 5, 80, 100


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the labelled rows teach; undetermined and doubtful ones go."""
    found = language_id.predict(docs, language_id.learned(docs), "__lang", "__score")
    return found.where((F.col("__lang") != "und") & (F.col("__score") >= MIN_LANGUAGE_SCORE)).drop("__lang", "__score")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest id, one row of each id; documents without an id stay."""
    groups = stored(ngram_join.jaccard_components(docs, SHINGLE, P, Q))
    spare = stored(groups.where("component_id <> doc_id").select("doc_id"))
    kept = docs.join(sized(spare), "doc_id", "left_anti").select(docs.columns)
    # Rows that repeat an id are one document: the one of the smallest text stays, whatever order they come in.
    repeated = stored(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    single = kept.join(sized(repeated), "doc_id", "left_anti").select(docs.columns)
    whole = F.struct(*docs.columns)
    first = kept.join(sized(repeated), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.struct(F.col("text").isNull(), "text", F.to_json(whole))).alias("row"))
    return single.unionByName(first.select("row.*").select(docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaked = stored(decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return docs.join(sized(leaked), "doc_id", "left_anti").select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` brought up to date."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, pieces, n_pieces, lossless``: sampled pieces, checked by decoding them."""
    out = pieces.encode(docs, check="lossless")
    return out.select("doc_id", "lang", "source", "pieces", F.size("pieces").cast("long").alias("n_pieces"), "lossless")


STAGES = [
    ("language_id", keep_known_language),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("decontamination", drop_leaks),
    ("pii", redact),
    ("sentencepiece", encode),
]

#: The sampled pieces can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = []
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        # What the stage before has written is read by nothing any more.
        discard(spark, *before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
