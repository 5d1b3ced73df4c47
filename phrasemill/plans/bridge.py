"""The engine's tables derived from the driver's: keyphrases, runs and costs made of documents and events.

Everything is integer arithmetic on ids and positions, so that another engine derives the same rows. Phrases
live in arrays of the document's row: building, de-duplicating and matching them needs no shuffle.
``BASE`` is the same derivation in DuckDB's SQL, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.functions import text
from phrasemill.operators import matching, scoring

N_MODELS, N_GOLD, N_PREDS = 4, 6, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dataset, doc_id, lang, n_chars, split, toks``: documents of at least two words."""
    split = F.expr("CASE doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN NULL WHEN 2 THEN 'valid' WHEN 3 THEN 'Training_large' ELSE ' train ' END")
    # Asked of the text, not of its words: a filter on a derived column would derive it twice.
    docs = table(spark, sf_dir, "documents").where(F.lower("text").rlike(rf"{text.WORD}[^\p{{L}}\p{{N}}]+{text.WORD}"))
    return docs.select(
        F.col("source").alias("dataset"), "doc_id", "lang", "n_chars", split.alias("split"), F.regexp_extract_all(F.lower("text"), F.lit(text.WORD), F.lit(0)).alias("toks")
    )


def _at(i: str) -> str:
    return f"int((doc_id * 7 + ({i}) * 13) % (size(toks) - 1)) + 1"


def gold_arrays(docs: DataFrame) -> DataFrame:
    """Adds ``gold``: distinct phrases, three present, one reversed, one half unseen, one unseen; each a struct of
    ``kp, n_words, prmu, end_word, end_char, tok_end``, classified beside the document's words."""
    p = _at("i")
    phrases = (
        f"array_distinct(transform(sequence(0, {N_GOLD - 1}), i -> CASE WHEN i < 3 THEN concat_ws(' ', toks[{p} - 1], toks[{p}]) "
        f"WHEN i = 3 THEN concat_ws(' ', toks[{p}], toks[{p} - 1]) WHEN i = 4 THEN concat_ws(' ', toks[{p} - 1], 'zzunseen') ELSE 'zzabsent zzunseen' END))"
    )
    docs = docs.withColumn("phrases", F.expr(phrases)).withColumn("pad", text.padded("toks"))
    one = f"transform(phrases, k -> named_struct('kp', k, 'n_words', size(split(k, ' ')), 'c', {text.prmu_sql("array(split(k, ' '))", 'pad')}))"
    docs = docs.withColumn("classified", F.expr(one)).drop("phrases", "pad")
    def described(x: Column) -> Column:
        end = x["c"]["end_word"]
        tokens = F.when(end >= 0, text.approximate_tokens(end + 1))
        return F.struct(x["kp"].alias("kp"), x["n_words"].alias("n_words"), x["c"]["class"].alias("prmu"), end.alias("end_word"), end.alias("end_char"), tokens.alias("tok_end"))

    return docs.withColumn("gold", F.transform("classified", described)).drop("classified")


def gold_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dataset, doc_id, split, lang, ann_key, gold``: one row per document and annotation set; reader has every second phrase."""
    docs = gold_arrays(documents(spark, sf_dir)).select("dataset", "doc_id", "split", "lang", "gold")
    sets = F.array(F.struct(F.lit("author").alias("k"), F.col("gold").alias("g")), F.struct(F.lit("reader").alias("k"), F.filter("gold", lambda g, i: i % 2 == 0).alias("g")))
    # The outer generators keep Spark from evaluating the arrays once more for a filter on their size.
    return docs.select("dataset", "doc_id", "split", "lang", F.explode_outer(sets).alias("s")).select("dataset", "doc_id", "split", "lang", F.col("s.k").alias("ann_key"), F.col("s.g").alias("gold"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dataset, doc_id, split, lang, ann_key, kp_idx, kp, n_words, prmu, end_word, end_char, tok_end``."""
    one = gold_sets(spark, sf_dir).select("dataset", "doc_id", "split", "lang", "ann_key", F.posexplode_outer("gold").alias("kp_idx", "g"))
    return one.where("kp_idx IS NOT NULL").select("dataset", "doc_id", "split", "lang", "ann_key", "kp_idx", "g.*")


def token_positions(gold_: DataFrame) -> DataFrame:
    """Approximate model-token position at which each located phrase ends."""
    return gold_.where("tok_end IS NOT NULL").select("dataset", "doc_id", "ann_key", "kp_idx", "tok_end")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dataset, model, arch, run_id, doc_id, stems``: ranked distinct phrases of every model for evaluation documents."""
    docs = documents(spark, sf_dir).where(scoring.is_eval_split("split"))
    p = _at(f"(j * (m + 1) + m) % {N_PREDS}")
    stems = f"array_distinct(transform(sequence(0, {N_PREDS - 1}), j -> CASE WHEN (j + doc_id) % 4 = 3 THEN concat('noise ', j) ELSE concat_ws(' ', toks[{p} - 1], toks[{p}]) END))"
    runs = F.expr(f"transform(filter(sequence(0, {N_MODELS - 1}), m -> doc_id % (7 + m) <> 0), m -> named_struct('m', m, 'stems', {stems}))")
    one = docs.select("dataset", "doc_id", F.explode_outer(runs).alias("r")).where("r IS NOT NULL")
    return one.select("dataset", F.expr("concat('model', r.m)").alias("model"), F.expr("concat('arch', r.m % 2)").alias("arch"), F.expr("concat('r', r.m)").alias("run_id"), "doc_id", "r.stems")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of all predictions with both annotation sets (``operators.matching``), with the gold of each row."""
    golds = gold_sets(spark, sf_dir).where(scoring.is_eval_split("split")).select("dataset", "doc_id", "ann_key", "gold")
    golds = golds.withColumn("stems", F.transform("gold", lambda g: F.array(g["kp"]))).withColumnRenamed("gold", "of")
    return matching.match(predictions(spark, sf_dir), golds)


def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts as pairs with the smallest id of their text; the score falls with the distance of ids."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("source").alias("dataset"), "doc_id", F.sha2("text", 256).alias("h"))
    low = docs.groupBy("h").agg(F.min(F.struct("doc_id", "dataset")).alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return docs.join(low, "h").where("doc_id <> low.doc_id").select(
        F.col("low.dataset").alias("dataset_a"), F.col("low.doc_id").alias("doc_id_a"), F.col("dataset").alias("dataset_b"), F.col("doc_id").alias("doc_id_b"),
        (1 - (F.col("doc_id") % 10) / 20.0).alias("score"), F.when(F.col("doc_id") % 3 == 0, "copy").alias("label"),
    )


_P = "((doc_id * 7 + ({i}) * 13) % (len(toks) - 1) + 1)"
_p, _q = _P.format(i="i"), _P.format(i=f"(j * (m + 1) + m) % {N_PREDS}")
EVAL = "NOT regexp_matches(lower(trim(coalesce(split, ''))), '^train(ing)?([_-].*)?$')"
BASE = f"""
docs AS (SELECT * FROM (SELECT source AS dataset, doc_id, lang, n_chars, CASE doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN NULL WHEN 2 THEN 'valid' WHEN 3 THEN 'Training_large' ELSE ' train ' END AS split,
  regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS toks FROM documents) WHERE len(toks) >= 2),
g0 AS (SELECT dataset, doc_id, split, lang, toks, i, CASE WHEN i < 3 THEN toks[{_p}] || ' ' || toks[{_p} + 1] WHEN i = 3 THEN toks[{_p} + 1] || ' ' || toks[{_p}] WHEN i = 4 THEN toks[{_p}] || ' zzunseen' ELSE 'zzabsent zzunseen' END AS kp
  FROM docs, range(0, {N_GOLD}) AS r(i)),
g1 AS (SELECT dataset, doc_id, split, lang, any_value(toks) AS toks, kp, min(i) AS i FROM g0 GROUP BY dataset, doc_id, split, lang, kp),
g2 AS (SELECT dataset, doc_id, split, lang, kp, (row_number() OVER (PARTITION BY dataset, doc_id ORDER BY i) - 1)::INTEGER AS kp_idx, ' ' || array_to_string(toks, ' ') || ' ' AS pad, toks, string_split(kp, ' ') AS w FROM g1),
g3 AS (SELECT dataset, doc_id, split, lang, kp_idx, kp, len(w)::INTEGER AS n_words,
  CASE WHEN strpos(pad, ' ' || kp || ' ') > 0 THEN 'P' WHEN len(list_filter(w, lambda x: list_contains(toks, x))) = len(w) THEN 'R' WHEN len(list_filter(w, lambda x: list_contains(toks, x))) > 0 THEN 'M' ELSE 'U' END AS prmu,
  CASE WHEN strpos(pad, ' ' || kp || ' ') > 0 THEN len(string_split(trim(pad[1:strpos(pad, ' ' || kp || ' ') + length(kp)]), ' ')) - 1 ELSE -1 END::INTEGER AS end_word FROM g2),
gold AS (SELECT *, 'author' AS ann_key FROM g3 UNION ALL SELECT dataset, doc_id, split, lang, kp_idx // 2, kp, n_words, prmu, end_word, 'reader' FROM g3 WHERE kp_idx % 2 = 0),
tokpos AS (SELECT dataset, doc_id, ann_key, kp_idx, round_even((end_word + 1) * 1.3::DOUBLE, 0)::INTEGER AS tok_end FROM gold WHERE end_word >= 0),
p0 AS (SELECT dataset, doc_id, m, j, CASE WHEN (j + doc_id) % 4 = 3 THEN 'noise ' || j ELSE toks[{_q}] || ' ' || toks[{_q} + 1] END AS kp FROM docs, range(0, {N_MODELS}) AS a(m), range(0, {N_PREDS}) AS b(j) WHERE {EVAL} AND doc_id % (7 + m) <> 0),
preds AS (SELECT dataset, doc_id, 'model' || m AS model, 'arch' || (m % 2) AS arch, 'r' || m AS run_id, kp, (row_number() OVER (PARTITION BY dataset, doc_id, m ORDER BY min(j)) - 1)::INTEGER AS rank FROM p0 GROUP BY dataset, doc_id, m, kp),
hits AS (SELECT p.dataset, p.model, p.arch, p.run_id, p.doc_id, g.ann_key, g.kp_idx, min(p.rank) AS rank FROM preds p JOIN gold g ON g.dataset = p.dataset AND g.doc_id = p.doc_id AND g.kp = p.kp GROUP BY ALL),
nu AS (SELECT dataset, model, arch, run_id, doc_id, count(*) AS n_uniq FROM preds GROUP BY ALL),
ng AS (SELECT dataset, doc_id, ann_key, count(*) AS n_gold FROM gold GROUP BY ALL),
matches AS (SELECT nu.*, ng.ann_key, ng.n_gold FROM nu JOIN ng ON ng.dataset = nu.dataset AND ng.doc_id = nu.doc_id)"""


def scored_sql(gold_filter: str = "", doc_filter: str = "") -> str:
    """CTEs ``scored`` (per run, document, annotation set, cut-off) and ``left_`` (gold left per row) under a gold filter."""
    allowed = f"ok AS (SELECT g.* FROM gold g LEFT JOIN tokpos t ON t.dataset = g.dataset AND t.doc_id = g.doc_id AND t.ann_key = g.ann_key AND t.kp_idx = g.kp_idx {gold_filter})"
    return f"""{BASE}, {allowed},
na AS (SELECT dataset, doc_id, ann_key, count(*) AS n_al FROM ok GROUP BY ALL),
left_ AS (SELECT m.*, coalesce(na.n_al, 0) AS n_al FROM matches m LEFT JOIN na ON na.dataset = m.dataset AND na.doc_id = m.doc_id AND na.ann_key = m.ann_key {doc_filter}),
c AS (SELECT l.*, k, CASE k WHEN 'O' THEN n_al WHEN 'M' THEN greatest(n_uniq, 1) ELSE try_cast(k AS INTEGER) END AS cut FROM left_ l, (VALUES ('5'), ('10'), ('O'), ('M')) AS ks(k) WHERE n_al > 0),
h AS (SELECT hits.* FROM hits JOIN ok ON ok.dataset = hits.dataset AND ok.doc_id = hits.doc_id AND ok.ann_key = hits.ann_key AND ok.kp_idx = hits.kp_idx),
t AS (SELECT c.dataset, c.model, c.arch, c.run_id, c.doc_id, c.ann_key, c.k, c.cut, c.n_uniq, c.n_al, count(h.rank) FILTER (h.rank < c.cut) AS tp FROM c LEFT JOIN h ON h.dataset = c.dataset AND h.run_id = c.run_id AND h.doc_id = c.doc_id AND h.ann_key = c.ann_key GROUP BY ALL),
pr AS (SELECT *, CASE WHEN n_uniq > 0 THEN tp / least(cut, n_uniq) ELSE 0.0 END AS p, tp / n_al AS r FROM t),
scored AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM pr)"""
