"""The engine's queries over the bridge tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phrasemill.functions import text
from phrasemill.operators import facts, scoring, statistics
from phrasemill.plans import bridge
from phrasemill.plans.bridge import BASE, EVAL, scored_sql, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MEANS = "avg(f1) AS f1_mean, avg(p) AS p_mean, avg(r) AS r_mean, count(*) AS n"
_RUN = "dataset, model, arch, run_id"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Scoring -----------------------------------------------------------------------------------------------------


@query(f"WITH {scored_sql()} SELECT {_RUN}, ann_key, k, {_MEANS} FROM scored GROUP BY ALL")
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    return scoring.run_metrics(bridge.matches(spark, d))


@query(f"WITH {scored_sql()} SELECT {_RUN}, doc_id, ann_key, p, r, f1 FROM scored WHERE k = '5'")
def score_per_document(spark: SparkSession, d: str) -> DataFrame:
    return scoring.per_document(bridge.matches(spark, d), ["5"]).select(*scoring.RUN, "doc_id", "ann_key", "p", "r", "f1")


def _filtered(gold_filter: str) -> str:
    return f"WITH {scored_sql(gold_filter)} SELECT {_RUN}, ann_key, k, {_MEANS} FROM scored GROUP BY ALL"


@query(_filtered("WHERE coalesce(g.prmu, 'U') IN ('R', 'M', 'U')"))
def score_filtered_prmu(spark: SparkSession, d: str) -> DataFrame:
    return scoring.run_metrics(bridge.matches(spark, d), allowed=scoring.allowed_of("of", ["R", "M", "U"]))


@query(_filtered("WHERE coalesce(g.end_word, -1) >= 0"))
def score_position_required(spark: SparkSession, d: str) -> DataFrame:
    return scoring.run_metrics(bridge.matches(spark, d), allowed=scoring.allowed_gold(bridge.gold(spark, d), require_position=True))


@query(_filtered("WHERE t.tok_end IS NOT NULL AND t.tok_end <= 128"))
def score_token_window(spark: SparkSession, d: str) -> DataFrame:
    return scoring.run_metrics(bridge.matches(spark, d), allowed=scoring.allowed_of("of", token_limit=128))


def _third(spark: SparkSession, d: str) -> DataFrame:
    return bridge.documents(spark, d).where("doc_id % 3 = 0").select("dataset", "doc_id")


@query(f"WITH {scored_sql(doc_filter='WHERE m.doc_id % 3 = 0')} SELECT {_RUN}, ann_key, k, {_MEANS} FROM scored GROUP BY ALL")
def score_doc_include(spark: SparkSession, d: str) -> DataFrame:
    return scoring.run_metrics(bridge.matches(spark, d), include=_third(spark, d))


@query(f"WITH {scored_sql(doc_filter='WHERE m.doc_id % 3 <> 0')} SELECT {_RUN}, ann_key, k, {_MEANS} FROM scored GROUP BY ALL")
def score_doc_exclude(spark: SparkSession, d: str) -> DataFrame:
    return scoring.run_metrics(bridge.matches(spark, d), exclude=_third(spark, d))


@query(f"WITH {scored_sql(chr(87) + "HERE g.prmu = 'R'")} SELECT {_RUN}, ann_key, count(*) FILTER (n_al <= 0) AS n_skipped FROM left_ GROUP BY ALL")
def score_skipped_docs(spark: SparkSession, d: str) -> DataFrame:
    return scoring.skipped(bridge.matches(spark, d), scoring.allowed_of("of", ["R"]))


@query(f"WITH {scored_sql()} SELECT {_RUN}, ann_key, k, {_MEANS} FROM scored WHERE (model, arch, run_id) IN (('model0', 'arch0', 'r0'), ('model3', 'arch1', 'r3')) GROUP BY ALL")
def score_selected_runs(spark: SparkSession, d: str) -> DataFrame:
    chosen = spark.createDataFrame([("model0", "arch0", "r0"), ("model3", "arch1", "r3")], "model string, arch string, run_id string")
    return scoring.run_metrics(bridge.matches(spark, d).join(F.broadcast(chosen), ["model", "arch", "run_id"], "left_semi"))


@query(f"WITH {BASE} SELECT {_RUN}, doc_id, ann_key, n_uniq, n_gold, (SELECT count(*) FROM hits h WHERE h.dataset = m.dataset AND h.run_id = m.run_id AND h.doc_id = m.doc_id AND h.ann_key = m.ann_key) AS n_hits, "
       "(SELECT min(rank) FROM hits h WHERE h.dataset = m.dataset AND h.run_id = m.run_id AND h.doc_id = m.doc_id AND h.ann_key = m.ann_key) AS first_rank FROM matches m")  # fmt: skip
def match_min_rank(spark: SparkSession, d: str) -> DataFrame:
    m = bridge.matches(spark, d)
    return m.select(*scoring.RUN, "doc_id", "ann_key", "n_uniq", "n_gold", F.size("hits").alias("n_hits"), F.array_min("hits.rank").alias("first_rank"))


@query(f"WITH {BASE} SELECT {_RUN}, doc_id, rank, kp FROM preds")
def uniq_preds_ranked(spark: SparkSession, d: str) -> DataFrame:
    return bridge.predictions(spark, d).select(*scoring.RUN, "doc_id", F.posexplode("stems").alias("rank", "kp"))


@query(f"WITH {BASE} SELECT dataset, doc_id, row_number() OVER (PARTITION BY dataset ORDER BY doc_id) - 1 AS ord FROM (SELECT DISTINCT dataset, doc_id FROM gold)")
def document_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return scoring.document_ordinals(bridge.gold(spark, d))


@query(f"WITH {BASE} SELECT p.rank, p.kp, g.kp_idx, g.prmu FROM preds p LEFT JOIN (SELECT * FROM gold WHERE ann_key = 'author') g ON g.dataset = p.dataset AND g.doc_id = p.doc_id AND g.kp = p.kp WHERE p.model = 'model1' AND p.doc_id = 5")
def explain_score(spark: SparkSession, d: str) -> DataFrame:
    preds = bridge.predictions(spark, d).where("model = 'model1' AND doc_id = 5").select("dataset", "doc_id", F.posexplode("stems").alias("rank", "kp"))
    gold = bridge.gold(spark, d).where("ann_key = 'author'").select("dataset", "doc_id", "kp", "kp_idx", "prmu")
    return preds.join(gold, ["dataset", "doc_id", "kp"], "left").select("rank", "kp", "kp_idx", "prmu")


# Text --------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS n_words FROM documents")
def doc_tokens_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(text.words(text.norm_ascii("text"))).alias("n_words"))


_MARKED = r"regexp_replace(lower(text), '(\s|\A)[^\p{L}\p{N}_\s\x01]+|[^\p{L}\p{N}_\s\x01]+(\s|\z)', ' ' || chr(1) || ' ', 'g')"


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_filter(t, lambda x: x = chr(1))) AS n_sentinels FROM (SELECT doc_id, regexp_extract_all({_MARKED}, '\\x01|[\\p{{L}}\\p{{N}}]+') AS t FROM documents)")
def tokens_with_sentinels(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", text.tokens_with_sentinels(text.norm_ascii("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.filter("t", lambda x: x == text.SENTINEL)).alias("n_sentinels"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(v, '++', chr(2)), '+'), lambda x: trim(replace(x, chr(2), '++'))), lambda x: x <> ''), '|') AS variants "
       "FROM (SELECT p_partkey, p_brand || '+' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '++' ELSE '' END AS v FROM part)")  # fmt: skip
def variant_split(spark: SparkSession, d: str) -> DataFrame:
    v = F.concat("p_brand", F.lit("+"), "p_name", F.when(F.col("p_partkey") % 2 == 0, "++").otherwise(""))
    return table(spark, d, "part").select("p_partkey", F.array_join(text.variants(v), "|").alias("variants"))


@query(f"WITH {BASE} SELECT dataset, doc_id, ann_key, kp_idx, kp, prmu, end_word FROM gold")
def prmu_classes(spark: SparkSession, d: str) -> DataFrame:
    return bridge.gold(spark, d).select("dataset", "doc_id", "ann_key", "kp_idx", "kp", "prmu", "end_word")


def _vote_sql() -> str:
    shares = ", ".join(
        "CASE WHEN len(t) = 0 THEN 0 ELSE len(list_filter(t, lambda x: list_contains([{}], x))) / len(t) END AS s_{}".format(", ".join(f"'{w}'" for w in text.STOP_WORDS[g].split()), g) for g in ("en", "fr", "de", "es")
    )
    return f"WITH d AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents), s AS (SELECT doc_id, lang, {shares} FROM d), b AS (SELECT *, greatest(s_en, s_fr, s_de, s_es) AS share FROM s) "


_BEST = "CASE WHEN share < 0.08 THEN NULL WHEN s_en = share THEN 'en' WHEN s_fr = share THEN 'fr' WHEN s_de = share THEN 'de' ELSE 'es' END"
_FOUR = ("en", "fr", "de", "es")


@query(_vote_sql() + f"SELECT doc_id, {_BEST} AS voted, share FROM b")
def language_vote(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", text.words(text.norm_ascii("text")).alias("t"))
    best, share = text.language_vote("shares", _FOUR)
    return text.stop_word_shares(docs, ["doc_id"], "t", _FOUR).select("doc_id", best.alias("voted"), share.alias("share"))


@query(_vote_sql() + f", v AS (SELECT *, {_BEST} AS voted, CASE doc_id % 2 WHEN 0 THEN lang ELSE 'en' END AS declared FROM b) SELECT declared, voted, count(*) AS n FROM v "
       "WHERE voted <> declared AND CASE declared WHEN 'en' THEN s_en WHEN 'fr' THEN s_fr WHEN 'de' THEN s_de ELSE s_es END < 0.5 * share GROUP BY ALL")  # fmt: skip
def language_mismatch_flags(spark: SparkSession, d: str) -> DataFrame:
    declared = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("en")
    docs = table(spark, d, "documents").select("doc_id", declared.alias("declared"), text.words(text.norm_ascii("text")).alias("t"))
    shares = text.stop_word_shares(docs, ["doc_id", "declared"], "t", _FOUR)
    flagged = shares.where(text.contradicts("shares", F.array("declared"), _FOUR))
    return flagged.select("declared", text.language_vote("shares", _FOUR)[0].alias("voted")).groupBy("declared", "voted").agg(F.count(F.lit(1)).alias("n"))


# Gold --------------------------------------------------------------------------------------------------------


@query(f"WITH {BASE}, a AS (SELECT dataset, ann_key, prmu, count(*) AS n FROM gold GROUP BY ALL) SELECT *, n / sum(n) OVER (PARTITION BY dataset, ann_key) AS share FROM a")
def prmu_distribution(spark: SparkSession, d: str) -> DataFrame:
    return facts.shares(facts.gold_aggregates(bridge.gold(spark, d)), ["dataset", "ann_key"], "prmu")


@query(f"WITH {BASE} SELECT dataset, split, ann_key, prmu, least(n_words, 6) AS n_words_b, count(*) AS n, sum(n_words)::BIGINT AS words_sum FROM gold GROUP BY ALL")
def gold_agg(spark: SparkSession, d: str) -> DataFrame:
    return facts.gold_aggregates(bridge.gold(spark, d))


@query("SELECT CASE WHEN w >= 6 THEN '6+' ELSE w::VARCHAR END AS bucket, count(*) AS n FROM (SELECT len(string_split(p_name, ' ')) + p_size % 8 AS w FROM part) GROUP BY ALL")
def keyphrase_length_dist(spark: SparkSession, d: str) -> DataFrame:
    w = F.size(F.split("p_name", " ")) + F.col("p_size") % 8
    return table(spark, d, "part").select(F.when(w >= 6, "6+").otherwise(w.cast("string")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BASE} SELECT dataset, count(DISTINCT kp) AS n_stem_sets, count(DISTINCT (doc_id, ann_key)) AS n_sets, count(*) FILTER (prmu = 'P') AS n_present FROM gold GROUP BY ALL")
def gold_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return bridge.gold(spark, d).groupBy("dataset").agg(F.count_distinct("kp").alias("n_stem_sets"), F.count_distinct(F.struct("doc_id", "ann_key")).alias("n_sets"), F.count_if(F.col("prmu") == "P").alias("n_present"))


@query(f"WITH {BASE}, k AS (SELECT left(coalesce(lang, 'en'), 2) AS lang, kp, chr((97 + length(kp) % 7)::INTEGER) AS pos FROM gold GROUP BY ALL), c AS (SELECT g.dataset, k.pos, count(*) AS n FROM gold g JOIN k ON k.kp = g.kp AND k.lang = left(coalesce(g.lang, 'en'), 2) GROUP BY ALL), "
       "t AS (SELECT pos FROM c GROUP BY pos ORDER BY sum(n) DESC, pos LIMIT 4) SELECT dataset, coalesce(t.pos, 'Other') AS pos, sum(n)::BIGINT AS n FROM c LEFT JOIN t ON t.pos = c.pos GROUP BY ALL")  # fmt: skip
def pos_top4_other(spark: SparkSession, d: str) -> DataFrame:
    gold = bridge.gold(spark, d).withColumn("lang", F.left(F.coalesce("lang", F.lit("en")), F.lit(2)))
    known = gold.select("lang", "kp").distinct().withColumn("pos", F.char(97 + F.length("kp") % 7))
    return facts.top_and_other(gold.join(known, ["lang", "kp"]), "pos", ["dataset"])


@query(f"WITH {BASE}, k AS (SELECT DISTINCT kp FROM gold WHERE dataset < 'src2') SELECT g.dataset, count(*) FILTER (k.kp IS NULL) AS n_new, count(*) FILTER (k.kp IS NOT NULL) AS n_known FROM (SELECT DISTINCT dataset, kp FROM gold) g LEFT JOIN k ON k.kp = g.kp GROUP BY ALL")
def semi_anti_keyphrases(spark: SparkSession, d: str) -> DataFrame:
    gold = bridge.gold(spark, d).select("dataset", "kp").distinct()
    known = gold.where("dataset < 'src2'").select("kp").distinct()
    new, old = gold.join(known, "kp", "left_anti"), gold.join(known, "kp", "left_semi")
    return new.withColumn("w", F.lit(1)).unionByName(old.withColumn("w", F.lit(0))).groupBy("dataset").agg(F.sum("w").alias("n_new"), F.sum(1 - F.col("w")).alias("n_known"))


# Documents ---------------------------------------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, count(*) - 1 AS n_extra FROM documents GROUP BY text HAVING count(*) > 1")
def dedup_first_line(spark: SparkSession, d: str) -> DataFrame:
    return facts.duplicate_groups(table(spark, d, "documents"), ["text"], "doc_id").select(F.col("first_at").alias("doc_id"), "n_extra")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def first_line_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    return facts.first_line_wins(docs, ["h"], ["doc_id"]).select("doc_id", "source")


@query("WITH s AS (SELECT source AS dataset, min(n_chars) AS lo, quantile_cont(n_chars, 0.995) AS hi FROM documents GROUP BY 1), w AS (SELECT *, greatest(1, ceil((hi - lo + 1) / 20))::BIGINT AS width FROM s) "
       "SELECT d.source AS dataset, lo, width, least(floor((n_chars - lo) / width), floor((hi - lo) / width))::BIGINT AS bin, count(*) AS n FROM documents d JOIN w ON w.dataset = d.source GROUP BY ALL")  # fmt: skip
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return facts.histogram(table(spark, d, "documents").select(F.col("source").alias("dataset"), "n_chars"), "n_chars", ["dataset"])


@query("SELECT id FROM (SELECT 'doc-' || (doc_id % 13) || '-' || doc_id AS id FROM documents) ORDER BY regexp_replace(id, '[0-9]+$', ''), try_cast(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) NULLS FIRST, id LIMIT 15 OFFSET 30")
def natural_order_page(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "documents").select(F.expr("concat('doc-', doc_id % 13, '-', doc_id)").alias("id"))
    return facts.natural_page(ids, "id", page=2)


@query(f"WITH {BASE}, t AS (SELECT dataset, doc_id, round_even(len(toks) * 1.3::DOUBLE, 0)::INTEGER AS n_tokens, len(toks) AS n_words FROM docs) SELECT dataset, sum(n_tokens) / nullif(sum(n_words), 0) AS ratio, count(*) AS n FROM t GROUP BY ALL")
def tokens_per_word(spark: SparkSession, d: str) -> DataFrame:
    docs = bridge.documents(spark, d).select("dataset", F.size("toks").alias("n_words"), text.approximate_tokens(F.size("toks")).alias("n_tokens"))
    return docs.groupBy("dataset").agg(F.try_divide(F.sum("n_tokens"), F.sum("n_words")).alias("ratio"), F.count(F.lit(1)).alias("n"))


@query("WITH f AS (SELECT source AS dataset, unnest(list_filter([CASE WHEN n_chars < 300 THEN 'short:' || lang END, CASE WHEN n_chars > 5000 THEN 'long:' || lang END, CASE WHEN doc_id % 7 = 0 THEN 'odd' END], lambda x: x IS NOT NULL)) AS flag FROM documents), "
       "t AS (SELECT source AS dataset, count(*) AS total FROM documents GROUP BY 1) SELECT f.dataset, flag, count(*) AS n, count(*) / any_value(total) AS share FROM f JOIN t USING (dataset) GROUP BY ALL")  # fmt: skip
def corr_subquery_share(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("source")))
    flags = F.filter(
        F.array(F.when(F.col("n_chars") < 300, F.concat(F.lit("short:"), "lang")), F.when(F.col("n_chars") > 5000, F.concat(F.lit("long:"), "lang")), F.when(F.col("doc_id") % 7 == 0, "odd")), lambda x: x.isNotNull()
    )
    one = docs.select(F.col("source").alias("dataset"), "total", F.explode_outer(flags).alias("flag")).where("flag IS NOT NULL")
    return one.groupBy("dataset", "flag").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.max("total")).alias("share"))


@query("SELECT source AS dataset, count(*) AS n_docs, sum(n_chars)::BIGINT AS chars, count(DISTINCT lang) AS n_langs, count(DISTINCT text) AS n_texts FROM documents GROUP BY 1")
def inventory(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.col("source").alias("dataset")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("chars"), F.count_distinct("lang").alias("n_langs"), F.count_distinct("text").alias("n_texts"))


# Leakage and quality -------------------------------------------------------------------------------------------

_PAIRS = (
    "low AS (SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1), pairs AS (SELECT a.source AS da, a.doc_id AS ia, b.source AS db, b.doc_id AS ib, 1 - (b.doc_id % 10) / 20.0 AS score, "
    "CASE WHEN b.doc_id % 3 = 0 THEN 'copy' END AS label FROM documents b JOIN low ON low.text = b.text JOIN documents a ON a.doc_id = low.doc_id WHERE b.doc_id <> low.doc_id)"
)
_LEAKED = f"leaked AS (SELECT DISTINCT s.d AS dataset, s.i AS doc_id FROM (SELECT da AS d, ia AS i, db AS od, ib AS oi, score FROM pairs UNION ALL SELECT db, ib, da, ia, score FROM pairs) s JOIN docs o ON o.dataset = s.od AND o.doc_id = s.oi WHERE s.score >= 0.7 AND NOT ({EVAL.replace('split', 'o.split')}))"


@query(f"WITH {BASE}, {_PAIRS}, {_LEAKED} SELECT * FROM leaked")
def leakage_sided_docs(spark: SparkSession, d: str) -> DataFrame:
    return facts.sided_leakage(bridge.similar_pairs(spark, d), bridge.documents(spark, d), 0.7)


@query(f"WITH {scored_sql()}, {_PAIRS}, {_LEAKED}, flagged AS (SELECT * FROM leaked UNION SELECT dataset, doc_id FROM docs WHERE n_chars < 400) "
       f"SELECT s.dataset, s.model, avg(f1) AS all_mean, avg(f1) FILTER (f.doc_id IS NULL) AS clean_mean, avg(f1) FILTER (f.doc_id IS NOT NULL) AS flagged_mean, count(*) FILTER (f.doc_id IS NULL) AS n_clean, count(*) FILTER (f.doc_id IS NOT NULL) AS n_flagged "
       "FROM scored s LEFT JOIN flagged f ON f.dataset = s.dataset AND f.doc_id = s.doc_id WHERE s.k = '10' AND s.ann_key = 'author' GROUP BY ALL")  # fmt: skip
def quality_flag_delta(spark: SparkSession, d: str) -> DataFrame:
    docs = bridge.documents(spark, d)
    flagged = facts.sided_leakage(bridge.similar_pairs(spark, d), docs, 0.7).unionByName(docs.where("n_chars < 400").select("dataset", "doc_id"))
    return facts.flag_delta(_ten(spark, d), flagged, ["dataset", "model"])


def _ten(spark: SparkSession, d: str) -> DataFrame:
    return scoring.per_document(bridge.matches(spark, d).where("ann_key = 'author'"), ["10"])


# Runs --------------------------------------------------------------------------------------------------------

_MAJ = (
    f"ev AS (SELECT dataset, doc_id, coalesce(split, '') AS split FROM docs WHERE {EVAL}), sz AS (SELECT dataset, split, count(DISTINCT doc_id) AS expected FROM ev GROUP BY ALL), "
    f"per AS (SELECT p.dataset, p.model, p.arch, p.run_id, ev.split, count(*) AS c FROM nu p JOIN ev ON ev.dataset = p.dataset AND ev.doc_id = p.doc_id GROUP BY ALL), "
    f"maj AS (SELECT {_RUN}, first(split ORDER BY c DESC, split) AS split, max(c) AS covered, count(*) AS n_splits FROM per GROUP BY {_RUN}), "
    f"cov AS (SELECT maj.*, sz.expected, covered / expected AS coverage FROM maj LEFT JOIN sz ON sz.dataset = maj.dataset AND sz.split = maj.split)"
)


@query(f"WITH {BASE}, {_MAJ} SELECT {_RUN}, split, covered, n_splits, expected, coverage FROM cov")
def coverage_majority_split(spark: SparkSession, d: str) -> DataFrame:
    return facts.majority_split(bridge.predictions(spark, d), bridge.documents(spark, d))


_IDS = (
    "lines AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN -doc_id ELSE doc_id END AS id FROM nu), "
    f"idc AS (SELECT l.dataset, l.model, l.arch, l.run_id, count(*) AS n_lines, count(DISTINCT id) AS n_docs, count(DISTINCT CASE WHEN d.doc_id IS NULL THEN id END) AS n_unknown FROM lines l LEFT JOIN docs d ON d.dataset = l.dataset AND d.doc_id = l.id GROUP BY ALL), "
    f"sc AS (SELECT {_RUN}, count(DISTINCT doc_id) AS n_scored FROM matches WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0 GROUP BY ALL), "
    "ids AS (SELECT idc.*, coalesce(n_scored, 0) AS n_scored, greatest(n_docs - n_unknown - coalesce(n_scored, 0), 0) AS n_unscored FROM idc LEFT JOIN sc ON sc.dataset = idc.dataset AND sc.run_id = idc.run_id)"
)


def _ids(spark: SparkSession, d: str) -> DataFrame:
    lines = bridge.predictions(spark, d).withColumn("doc_id", F.when(F.col("doc_id") % 11 == 0, -F.col("doc_id")).otherwise(F.col("doc_id")))
    return facts.id_counts(lines, bridge.documents(spark, d), bridge.matches(spark, d).where("doc_id % 11 <> 0 AND doc_id % 13 <> 0"))


@query(f"WITH {BASE}, {_IDS} SELECT {_RUN}, n_lines, n_docs, n_unknown, n_scored, n_unscored FROM ids")
def unresolved_and_unscored(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d)


_TAGS = (
    "tags AS (SELECT cov.dataset, cov.model, cov.arch, cov.run_id, list_filter([CASE WHEN cov.run_id = 'r3' THEN 'missing:run' END, CASE WHEN coverage < 0.999 THEN 'incomplete:' || round_even(100 * coverage, 0)::INTEGER || '%' END, "
    "CASE WHEN n_unknown > 0 THEN 'unresolved_ids:' || n_unknown END, CASE WHEN n_unscored > 0 THEN 'unscored:' || n_unscored END, CASE WHEN n_splits > 1 THEN 'multi_split:' || n_splits END], lambda x: x IS NOT NULL) AS tags "
    "FROM cov JOIN ids ON ids.dataset = cov.dataset AND ids.run_id = cov.run_id)"
)


def _tags(spark: SparkSession, d: str) -> DataFrame:
    cov = facts.majority_split(bridge.predictions(spark, d), bridge.documents(spark, d))
    return facts.run_tags(cov.join(_ids(spark, d), scoring.RUN).withColumn("has_card", F.col("run_id") != "r3"))


@query(f"WITH {BASE}, {_MAJ}, {_IDS}, {_TAGS} SELECT {_RUN}, array_to_string(tags, ' ') AS tags FROM tags")
def run_tags(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spark, d).withColumn("tags", F.array_join("tags", " "))


@query(f"WITH {BASE}, {_MAJ}, {_IDS}, {_TAGS}, u AS (SELECT dataset, run_id, unnest(tags) AS tag FROM tags) SELECT string_split(tag, ':')[1] AS kind, count(DISTINCT (dataset, run_id)) AS n_runs, count(DISTINCT dataset) AS n_datasets, "
       "min(try_cast(regexp_extract(tag, '([0-9]+)%?$', 1) AS INTEGER)) AS lo, max(try_cast(regexp_extract(tag, '([0-9]+)%?$', 1) AS INTEGER)) AS hi FROM u GROUP BY 1")  # fmt: skip
def issue_rollup(spark: SparkSession, d: str) -> DataFrame:
    return facts.issue_rollup(_tags(spark, d))


_EV = "SELECT event_type AS run_id, user_id % 20 AS batch, CASE WHEN event_id % 9 = 0 THEN '{\"k\": \"bad\"}' WHEN event_id % 4 = 0 THEN '{\"k\": ' || (event_id % 50) || ', \"time\": 1.5}' ELSE props END AS costs, ts, value FROM events"


def _events(spark: SparkSession, d: str) -> DataFrame:
    costs = F.expr("CASE WHEN event_id % 9 = 0 THEN '{\"k\": \"bad\"}' WHEN event_id % 4 = 0 THEN concat('{\"k\": ', event_id % 50, ', \"time\": 1.5}') ELSE props END")
    return table(spark, d, "events").select(F.col("event_type").alias("run_id"), (F.col("user_id") % 20).alias("batch"), costs.alias("costs"), "ts", "value")


_VARS = f"ev AS ({_EV}), kv AS (SELECT run_id, batch, unnest(json_keys(costs)) AS variable, costs FROM ev), ds AS (SELECT run_id, variable, sum(try_cast(json_extract_string(costs, '$.' || variable) AS DOUBLE)) AS total, count(try_cast(json_extract_string(costs, '$.' || variable) AS DOUBLE)) AS n FROM kv GROUP BY ALL)"


@query(f"WITH {_VARS} SELECT * FROM ds")
def cost_var_sums(spark: SparkSession, d: str) -> DataFrame:
    return facts.cost_sums(_events(spark, d), "costs", ["run_id"])


_RES = (
    f"{_VARS}, bs AS (SELECT run_id, 'time' AS variable, sum(value) AS total, count(value) AS n FROM (SELECT run_id, batch, max(value) AS value FROM ev GROUP BY ALL) GROUP BY 1), "
    "cn AS (SELECT run_id, count(*) AS n_docs, count(DISTINCT batch) AS n_batches FROM ev GROUP BY 1), "
    "j AS (SELECT coalesce(ds.run_id, bs.run_id) AS run_id, coalesce(ds.variable, bs.variable) AS variable, ds.total AS dt, coalesce(ds.n, 0) AS dn, bs.total AS bt, coalesce(bs.n, 0) AS bn FROM ds FULL JOIN bs ON bs.run_id = ds.run_id AND bs.variable = ds.variable), "
    "c AS (SELECT j.*, dn / n_docs AS dc, bn / n_batches AS bc, CASE j.variable WHEN 'time' THEN 'document' WHEN 'k' THEN 'batch' END AS declared FROM j JOIN cn USING (run_id)), "
    "u AS (SELECT *, CASE WHEN declared = 'document' AND dn > 0 AND dc >= 0.999 THEN 'document' WHEN declared = 'batch' AND bn > 0 AND bc >= 0.999 THEN 'batch' WHEN dn > 0 AND dc >= 0.999 THEN 'document' WHEN bn > 0 AND bc >= 0.999 THEN 'batch' "
    "WHEN dn > 0 AND (bn = 0 OR dc > bc OR (dc = bc AND declared = 'document')) THEN 'document' WHEN bn > 0 THEN 'batch' END AS level FROM c), "
    "tot AS (SELECT run_id, variable, CASE level WHEN 'document' THEN dt ELSE bt END AS total, level, round_even(dc, 4) AS doc_cov, round_even(bc, 4) AS batch_cov, level <> declared AS level_fallback, CASE level WHEN 'document' THEN dc ELSE bc END < 0.999 AS partial FROM u WHERE level IS NOT NULL)"
)


def _totals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ev = _events(spark, d)
    per_batch = ev.groupBy("run_id", "batch").agg(F.max("value").alias("value"))
    batch = per_batch.groupBy("run_id").agg(F.sum("value").alias("total"), F.count("value").alias("n")).withColumn("variable", F.lit("time"))
    counts = ev.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_distinct("batch").alias("n_batches"))
    declared = spark.createDataFrame([("time", "document"), ("k", "batch")], "variable string, level string")
    return facts.resolved_totals(facts.cost_sums(ev, "costs", ["run_id"]), batch, counts, declared), counts


@query(f"WITH {_RES} SELECT * FROM tot")
def cost_resolution(spark: SparkSession, d: str) -> DataFrame:
    return _totals(spark, d)[0].drop("derived")


@query(f"WITH {_RES}, rates(unit, variable, rate) AS (VALUES ('usd', 'k', 0.25), ('usd', 'time', 2.0), ('usd', 'gpu', 0.0), ('co2', 'gpu', 1.5), ('s', 'time', 1.0)), r AS (SELECT cn.run_id, n_docs, unit, rates.variable, rate FROM cn, rates WHERE rate <> 0), "
       "p AS (SELECT r.run_id, unit, n_docs, sum(rate * total) AS s, count(*) FILTER (total IS NULL) AS missing, count(*) FILTER (partial) AS partials FROM r LEFT JOIN tot ON tot.run_id = r.run_id AND tot.variable = r.variable GROUP BY ALL) "
       "SELECT run_id, unit, CASE WHEN missing = 0 THEN s END AS total, CASE WHEN missing = 0 THEN s / n_docs END AS per_doc, missing = 0 AS known, missing = 0 AND partials = 0 AS complete FROM p")  # fmt: skip
def cost_priced(spark: SparkSession, d: str) -> DataFrame:
    totals, counts = _totals(spark, d)
    rates = spark.createDataFrame([("a", "usd", "k", 0.25), ("a", "usd", "time", 2.0), ("a", "usd", "gpu", 0.0), ("a", "co2", "gpu", 1.5), ("a", "s", "time", 1.0)], "arch string, unit string, variable string, rate double")
    runs = counts.select("run_id", F.lit("a").alias("arch"), "n_docs")
    return facts.priced(totals.withColumn("arch", F.lit("a")), rates, runs).drop("arch")


@query("SELECT event_type AS run_id, count(*) AS n_batches, sum(epoch(t1) - epoch(ts)) AS wall_s, min(ts) AS t_start, max(t1) AS t_end FROM (SELECT *, ts + to_seconds(event_id % 100) AS t1 FROM events) GROUP BY 1")
def batch_rollup(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select(F.col("event_type").alias("run_id"), F.col("ts").cast("timestamp").alias("t_start"), (F.col("ts").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("event_id") % 100)).alias("t_end"))
    out = facts.batch_rollup(ev, ["run_id"])
    return out.withColumn("t_start", F.col("t_start").cast("timestamp_ntz")).withColumn("t_end", F.col("t_end").cast("timestamp_ntz"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE date_trunc('second', o_orderdate) - CASE WHEN o_orderkey % 5 = 2 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END END AS t FROM orders")
def parse_timestamps(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate")
    written = (
        F.when(F.col("o_orderkey") % 5 == 0, F.date_format(t, "yyyy/MM/dd HH:mm:ss")).when(F.col("o_orderkey") % 5 == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("o_orderkey") % 5 == 2, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).when(F.col("o_orderkey") % 5 == 3, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    )
    return table(spark, d, "orders").select("o_orderkey", facts.timestamp(written).alias("t"))


_RUNP = "SELECT 'm' || (p_size % 3) AS model, 'r' || p_partkey AS run_id, p_partkey AS k, p_size AS s, p_retailprice AS price FROM part"
_SPECS = [("m0", "top_k", "int", None, 1.0, 40.0, "10"), ("m0", "temp", "float", None, 0.0, 1.0, None), ("m1", "top_k", "int", ["5", "10", "15"], None, None, None), ("m1", "mode", "str", ['"beam"', '"greedy"'], None, None, '"beam"'), ("m2", "top_k", "strange", None, None, None, None)]


@query(f"WITH r AS ({_RUNP}), specs(model, param, type, allowed, lo, hi, fallback) AS (VALUES ('m0', 'top_k', 'int', NULL, 1.0, 40.0, '10'), ('m0', 'temp', 'float', NULL, 0.0, 1.0, NULL), ('m1', 'top_k', 'int', ['5', '10', '15'], NULL, NULL, NULL), "
       "('m1', 'mode', 'str', ['\"beam\"', '\"greedy\"'], NULL, NULL, '\"beam\"'), ('m2', 'top_k', 'strange', NULL, NULL, NULL, NULL)), "
       "g AS (SELECT model, run_id, 'top_k' AS param, s::VARCHAR AS given FROM r WHERE k % 4 <> 0 UNION ALL SELECT model, run_id, 'temp', (k % 13 / 10.0)::DECIMAL(4,1)::VARCHAR FROM r WHERE k % 3 = 0 UNION ALL SELECT model, run_id, 'mode', CASE k % 2 WHEN 0 THEN '\"greedy\"' ELSE '\"odd\"' END FROM r WHERE k % 5 = 0), "
       "f AS (SELECT coalesce(d.model, g.model) AS model, coalesce(d.run_id, g.run_id) AS run_id, coalesce(d.param, g.param) AS param, type, allowed, lo, hi, fallback, given, coalesce(given, fallback) AS value FROM (SELECT r.run_id, s.* FROM r JOIN specs s ON s.model = r.model) d FULL JOIN g ON g.model = d.model AND g.run_id = d.run_id AND g.param = d.param), "
       "o AS (SELECT model, param, CASE WHEN given IS NOT NULL THEN 'given' WHEN fallback IS NOT NULL THEN 'default' ELSE 'missing' END AS source, CASE WHEN type IS NULL THEN 'undeclared' WHEN value IS NULL THEN NULL WHEN type = 'strange' THEN 'unknown type' WHEN allowed IS NOT NULL AND NOT list_contains(allowed, value) THEN 'value' "
       "WHEN try_cast(value AS DOUBLE) < lo THEN 'min' WHEN try_cast(value AS DOUBLE) > hi THEN 'max' END AS problem FROM f) SELECT model, param, source, problem, count(*) AS n FROM o GROUP BY ALL")  # fmt: skip
def param_validation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    params = F.map_filter(
        F.create_map(
            F.lit("top_k"), F.when(k % 4 != 0, F.col("p_size").cast("string")),
            F.lit("temp"), F.when(k % 3 == 0, (k % 13 / 10).cast("decimal(4,1)").cast("string")),
            F.lit("mode"), F.when(k % 5 == 0, F.when(k % 2 == 0, '"greedy"').otherwise('"odd"')),
        ),
        lambda _, v: v.isNotNull(),
    )
    runs = table(spark, d, "part").select(F.concat(F.lit("m"), F.col("p_size") % 3).alias("model"), F.concat(F.lit("r"), k).alias("run_id"), params.alias("params"))
    specs = spark.createDataFrame(_SPECS, "model string, param string, type string, allowed array<string>, lo double, hi double, fallback string")
    return facts.resolved_parameters(runs, specs).groupBy("model", "param", "source", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT DISTINCT CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) || '-' WHEN 2 THEN 'nation.' || n_nationkey ELSE 'N/A' END AS token FROM nation), k AS (SELECT regexp_replace(lower(a), '[^a-z0-9]', '', 'g') AS key, min(n_name) AS loose FROM (SELECT n_name, unnest([n_name, 'Nation ' || n_nationkey]) AS a FROM nation) GROUP BY 1) "
       "SELECT token, coalesce(n.n_name, CASE WHEN lower(trim(token)) NOT IN ('n.a', 'na', 'n/a', 'none', 'unknown', 'null', '-', '') THEN k.loose END) AS card FROM t LEFT JOIN nation n ON n.n_name = token LEFT JOIN k ON k.key = regexp_replace(lower(token), '[^a-z0-9]', '', 'g')")  # fmt: skip
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    k = F.col("n_nationkey")
    tokens = nation.select(F.when(k % 4 == 0, F.col("n_name")).when(k % 4 == 1, F.concat(F.lower("n_name"), F.lit("-"))).when(k % 4 == 2, F.concat(F.lit("nation."), k)).otherwise("N/A").alias("token"))
    return facts.resolved_names(tokens, nation.select(F.col("n_name").alias("card"), F.array(F.concat(F.lit("Nation "), k)).alias("aliases")))


# Statistics ----------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY round(c_acctbal, -3)) + (count(*) OVER (PARTITION BY c_mktsegment, round(c_acctbal, -3)) - 1) / 2 AS rank, count(*) OVER (PARTITION BY c_mktsegment, round(c_acctbal, -3)) AS ties FROM customer")
def avg_ranks_ties(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.round("c_acctbal", -3).alias("v"))
    return statistics.average_ranks(c, "v", ["c_mktsegment"]).select("c_custkey", "rank", "ties")


_SC = f"WITH {scored_sql()}, s AS (SELECT * FROM scored WHERE k = '10' AND ann_key = 'author')"
_XY = "xy AS (SELECT a.dataset, a.doc_id, a.f1 AS x, b.f1 AS y FROM s a JOIN s b ON b.dataset = a.dataset AND b.doc_id = a.doc_id WHERE a.model = 'model0' AND b.model = 'model1')"


def _xy(spark: SparkSession, d: str) -> DataFrame:
    return scoring.paired(_ten(spark, d), F.col("model") == "model0", F.col("model") == "model1")


@query(f"{_SC}, v AS (SELECT dataset, f1 AS v, doc_id % 2 = 0 AS g, rank() OVER (PARTITION BY dataset ORDER BY f1) + (count(*) OVER (PARTITION BY dataset, f1) - 1) / 2 AS rk FROM s WHERE model = 'model2'), tt AS (SELECT dataset, sum(n * n * n - n)::DOUBLE AS ties FROM (SELECT dataset, v, count(*) AS n FROM v GROUP BY ALL) GROUP BY 1), "
       "r AS (SELECT dataset, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, coalesce(sum(rk) FILTER (g), 0) AS r1 FROM v GROUP BY 1) SELECT r.dataset, n1, n2, least(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2)) AS u, ties FROM r JOIN tt USING (dataset)")  # fmt: skip
def mann_whitney_u(spark: SparkSession, d: str) -> DataFrame:
    s = _ten(spark, d).where("model = 'model2'").select("dataset", "f1", (F.col("doc_id") % 2 == 0).alias("g"))
    return statistics.mann_whitney(s, "f1", "g", ["dataset"]).drop("u1")


@query(f"{_SC}, {_XY}, d AS (SELECT dataset, round(x - y, 12) AS d FROM xy WHERE round(x - y, 12) <> 0), k AS (SELECT dataset, d, rank() OVER (PARTITION BY dataset ORDER BY abs(d)) + (count(*) OVER (PARTITION BY dataset, abs(d)) - 1) / 2 AS rk FROM d), "
       "tt AS (SELECT dataset, sum(n * n * n - n)::DOUBLE AS ties FROM (SELECT dataset, abs(d) AS a, count(*) AS n FROM d GROUP BY ALL) GROUP BY 1), w AS (SELECT dataset, count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS w_plus, coalesce(sum(rk) FILTER (d < 0), 0) AS w_minus FROM k GROUP BY 1) "
       "SELECT w.*, least(w_plus, w_minus) AS w, ties FROM w JOIN tt USING (dataset)")  # fmt: skip
def wilcoxon_w(spark: SparkSession, d: str) -> DataFrame:
    return statistics.wilcoxon(_xy(spark, d), ["dataset"]).select("dataset", "n", "w_plus", "w_minus", "ties", "w")


_COMPLETE = "nm AS (SELECT dataset AS nd, count(DISTINCT model) AS k FROM s GROUP BY 1), cp AS (SELECT dataset, doc_id, model, f1, count(*) OVER (PARTITION BY dataset, doc_id) AS own FROM s), cc AS (SELECT cp.*, nm.k FROM cp JOIN nm ON nd = dataset WHERE own = k)"


@query(f"{_SC}, {_COMPLETE}, k AS (SELECT *, count(*) OVER (PARTITION BY dataset, doc_id, f1) AS t, rank() OVER (PARTITION BY dataset, doc_id ORDER BY f1) + (count(*) OVER (PARTITION BY dataset, doc_id, f1) - 1) / 2 AS rk FROM cc), "
       "m AS (SELECT dataset, model, k, sum(rk) AS r, count(*) AS n, sum(t * t - 1) AS t FROM k GROUP BY ALL), a AS (SELECT dataset, max(n) AS n, k, sum((r - n * (k + 1) / 2) * (r - n * (k + 1) / 2)) AS s, sum(t)::DOUBLE AS t FROM m GROUP BY dataset, k) "
       "SELECT dataset, n, k, CASE WHEN 1 - t / (n * k * (k * k - 1)) > 0 THEN 12 * s / (n * k * (k + 1)) / (1 - t / (n * k * (k * k - 1))) END AS chi2 FROM a")  # fmt: skip
def friedman_chi2(spark: SparkSession, d: str) -> DataFrame:
    return statistics.friedman(_ten(spark, d), "doc_id", "model", "f1", ["dataset"])


@query(f"{_SC}, {_XY}, a AS (SELECT dataset, count(*) AS n, avg(x - y) AS mean, stddev_samp(x - y) AS sd FROM xy GROUP BY 1) SELECT *, CASE WHEN sd > 0 THEN mean / (sd / sqrt(n)) END AS t, CASE WHEN sd > 0 THEN mean / sd END AS d_z FROM a")
def paired_t(spark: SparkSession, d: str) -> DataFrame:
    return statistics.paired_t(_xy(spark, d), ["dataset"])


@query(f"{_SC}, a AS (SELECT dataset, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, avg(f1) FILTER (g) AS m1, avg(f1) FILTER (NOT g) AS m2, var_samp(f1) FILTER (g) AS v1, var_samp(f1) FILTER (NOT g) AS v2 FROM (SELECT *, n_uniq < 8 AS g FROM s WHERE model = 'model2') GROUP BY 1) "
       "SELECT dataset, n1, n2, CASE WHEN v1 / n1 + v2 / n2 > 0 THEN (m1 - m2) / sqrt(v1 / n1 + v2 / n2) END AS t, CASE WHEN v1 / n1 + v2 / n2 > 0 THEN (v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1)) END AS df, "
       "CASE WHEN (n1 - 1) * v1 + (n2 - 1) * v2 > 0 THEN (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * (1 - 3.0 / (4 * (n1 + n2) - 9)) END AS g FROM a")  # fmt: skip
def welch_t(spark: SparkSession, d: str) -> DataFrame:
    s = _ten(spark, d).where("model = 'model2'").withColumn("g", F.col("n_uniq") < 8)
    return statistics.welch_t(s, "f1", "g", ["dataset"])


@query(f"{_SC}, {_COMPLETE}, gm AS (SELECT dataset, avg(f1) AS gm FROM cc GROUP BY 1), b AS (SELECT dataset, doc_id, avg(f1) AS bm, max(k) AS bk FROM cc GROUP BY ALL), m AS (SELECT dataset, model, avg(f1) AS mm, count(*) AS n FROM cc GROUP BY ALL), "
       "q AS (SELECT gm.dataset, (SELECT max(k) FROM cc WHERE cc.dataset = gm.dataset) AS k, (SELECT sum(n * (mm - gm) * (mm - gm)) FROM m WHERE m.dataset = gm.dataset) AS cond, (SELECT sum(bk * (bm - gm) * (bm - gm)) FROM b WHERE b.dataset = gm.dataset) AS subj, (SELECT sum((f1 - gm) * (f1 - gm)) FROM cc WHERE cc.dataset = gm.dataset) AS tot, (SELECT max(n) FROM m WHERE m.dataset = gm.dataset) AS n FROM gm) "
       "SELECT dataset, n, k, CASE WHEN tot - cond - subj > 1e-12 * (tot - subj) THEN (cond / (k - 1)) / ((tot - cond - subj) / ((k - 1) * (n - 1))) END AS f, CASE WHEN tot - cond - subj > 1e-12 * (tot - subj) THEN cond / (tot - subj) WHEN cond > 1e-12 THEN 1.0 END AS eta2 FROM q WHERE n > 1")  # fmt: skip
def rm_anova_f(spark: SparkSession, d: str) -> DataFrame:
    return statistics.rm_anova(_ten(spark, d), "doc_id", "model", "f1", ["dataset"]).where("n > 1")


@query("WITH p AS (SELECT n_regionkey AS family, n_nationkey AS test, CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE ((n_nationkey * 37 + 11) % 100) / 1000.0 END AS p FROM nation), r AS (SELECT *, count(p) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p NULLS LAST, test) AS k FROM p) "
       "SELECT family, test, p::DOUBLE AS p, CASE WHEN p IS NOT NULL THEN CASE WHEN m <= 1 THEN p ELSE least(1, p * m) END END::DOUBLE AS bonferroni, CASE WHEN p IS NOT NULL THEN CASE WHEN m <= 1 THEN p ELSE max(least(1, p * (m - k + 1))) OVER (PARTITION BY family ORDER BY k ROWS UNBOUNDED PRECEDING) END END::DOUBLE AS holm, "
       "CASE WHEN p IS NOT NULL THEN CASE WHEN m <= 1 THEN p ELSE least(1, min(p * m / k) OVER (PARTITION BY family ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END END::DOUBLE AS bh FROM r")  # fmt: skip
def holm_bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    p = table(spark, d, "nation").select(F.col("n_regionkey").alias("family"), k.alias("test"), F.when(k % 6 != 5, (k * 37 + 11) % 100 / 1000.0).alias("p"))
    return statistics.adjusted(p, by=["family"], order=["test"])


@query(f"{_SC}, m AS (SELECT dataset, model, avg(f1) AS v FROM s GROUP BY ALL) SELECT a.dataset AS a, b.dataset AS b, count(*) AS n, CASE WHEN stddev_pop(a.v) > 1e-12 AND stddev_pop(b.v) > 1e-12 THEN round(corr(a.v, b.v), 6) END AS r FROM m a JOIN m b ON b.model = a.model WHERE a.dataset < b.dataset GROUP BY ALL")
def rq1_pearson_matrix(spark: SparkSession, d: str) -> DataFrame:
    means = _ten(spark, d).groupBy("dataset", "model").agg(F.avg("f1").alias("v"))
    return statistics.pearson_matrix(means, "model", "dataset", "v").withColumn("r", F.round("r", 6))


@query("WITH s AS (SELECT s_nationkey AS g, s_suppkey AS i, round(s_acctbal, -3) AS x, s_suppkey % 7 AS y FROM supplier), p AS (SELECT a.g, sign(a.x - b.x) * 1.0 AS s, sign(a.y - b.y) * 1.0 AS t FROM s a JOIN s b ON b.g = a.g AND a.i < b.i), "
       "c AS (SELECT g, count(*) FILTER (s * t > 0) AS concordant, count(*) FILTER (s * t < 0) AS discordant, count(*) FILTER (s = 0 AND t <> 0) AS ties_x, count(*) FILTER (s <> 0 AND t = 0) AS ties_y FROM p GROUP BY 1) "
       "SELECT *, CASE WHEN (concordant + discordant + ties_x) * (concordant + discordant + ties_y) > 0 THEN (concordant - discordant) / sqrt((concordant + discordant + ties_x) * (concordant + discordant + ties_y)) END AS tau FROM c")  # fmt: skip
def kendall_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("i"), F.round("s_acctbal", -3).alias("x"), (F.col("s_suppkey") % 7).cast("double").alias("y"))
    return statistics.kendall_pairs(s, "x", "y", ["g"])


# Workbenches ---------------------------------------------------------------------------------------------------


@query(f"{_SC}, m AS (SELECT dataset, model, arch, run_id, round(avg(f1), 12) AS mean FROM s GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY dataset, arch ORDER BY mean DESC NULLS LAST, run_id) AS rn FROM m) SELECT dataset, arch, run_id, mean FROM k WHERE rn = 1")
def best_run_per_model(spark: SparkSession, d: str) -> DataFrame:
    means = _ten(spark, d).groupBy(*scoring.RUN).agg(F.round(F.avg("f1"), 12).alias("mean"))
    return statistics.best_per(means, ["dataset", "arch"], "mean", ["run_id"]).select("dataset", "arch", "run_id", "mean")


@query("WITH s AS (SELECT s_suppkey AS i, s_nationkey AS g, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_suppkey % 17 END AS cost, s_acctbal AS v FROM supplier) SELECT i, g, cost IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s o WHERE o.g = s.g AND o.cost IS NOT NULL AND o.i <> s.i AND o.cost <= s.cost AND o.v >= s.v AND (o.cost < s.cost OR o.v > s.v OR o.i < s.i)) AS on_front FROM s")
def pareto_frontier(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(k.alias("i"), F.col("s_nationkey").alias("g"), F.when(k % 9 != 0, (k % 17).cast("double")).alias("cost"), F.col("s_acctbal").alias("v"))
    return statistics.pareto(s, "cost", "v", ["g"], ["i"]).select("i", "g", "on_front")


@query(f"WITH {scored_sql(chr(87) + 'HERE t.tok_end IS NOT NULL AND t.tok_end <= 128')}, w AS (SELECT * FROM scored WHERE k = '10' AND ann_key = 'author'), o AS (SELECT m.dataset, m.run_id, m.doc_id, count(h.rank) FILTER (h.rank < 10) / m.n_gold AS r FROM matches m "
       "LEFT JOIN hits h ON h.dataset = m.dataset AND h.run_id = m.run_id AND h.doc_id = m.doc_id AND h.ann_key = m.ann_key WHERE m.ann_key = 'author' GROUP BY m.dataset, m.run_id, m.doc_id, m.n_gold) "
       "SELECT w.dataset, w.run_id, count(*) AS n, avg(o.r) AS r_all, avg(w.r) AS r_window FROM w JOIN o ON o.dataset = w.dataset AND o.run_id = w.run_id AND o.doc_id = w.doc_id GROUP BY ALL")  # fmt: skip
def rq3_window_pairs(spark: SparkSession, d: str) -> DataFrame:
    # Both scorings share the hits of one row, so one pass gives the pair.
    m = bridge.matches(spark, d).where("ann_key = 'author'")
    window = scoring.per_document(m.withColumn("every", F.expr("size(filter(hits, h -> h.rank < 10)) / n_gold")), ["10"], allowed=scoring.allowed_of("of", token_limit=128))
    return window.groupBy("dataset", "run_id").agg(F.count(F.lit(1)).alias("n"), F.avg("every").alias("r_all"), F.avg("r").alias("r_window"))


_BINS = (
    "cl AS (SELECT s.dataset, s.model, s.f1, len(docs.toks) AS x FROM s JOIN docs ON docs.dataset = s.dataset AND docs.doc_id = s.doc_id), "
    "cv AS (SELECT dataset, model, x, count(*) AS c, sum(f1) AS t, sum(count(*)) OVER (PARTITION BY dataset, model) AS n, sum(count(*)) OVER (PARTITION BY dataset, model ORDER BY x) - count(*) AS before FROM cl GROUP BY dataset, model, x), "
    "cnb AS (SELECT *, least(8, greatest(3, n // 12)) AS nb FROM cv), "
    # A boundary b stands where the value at position round(b n / nb) begins; a value's bin is the number of boundaries at or before it.
    "ce AS (SELECT *, (SELECT count(DISTINCT w.before) FROM cnb w, range(1, 8) AS r(b) WHERE w.dataset = nb.dataset AND w.model = nb.model AND b < nb.nb AND w.before > 0 AND w.before <= nb.before "
    "AND least(round_even(b * nb.n / nb.nb::DOUBLE, 0), nb.n - 1) >= w.before AND least(round_even(b * nb.n / nb.nb::DOUBLE, 0), nb.n - 1) < w.before + w.c) AS bin FROM cnb nb), "
    "cf AS (SELECT dataset, model, bin, sum(c) AS n, min(x) AS lo, max(x) AS hi, sum(t) AS t, any_value(n) AS total, any_value(nb) AS nb FROM (SELECT dataset, model, bin, c, x, t, n, nb FROM ce) GROUP BY dataset, model, bin), "
    "ch AS (SELECT *, max(bin) OVER (PARTITION BY dataset, model) AS last FROM cf), "
    "cg AS (SELECT *, CASE WHEN bin = last AND bin > 0 AND n < greatest(2, floor(total / nb::DOUBLE / 2)) THEN bin - 1 ELSE bin END AS b FROM ch)"
)


@query(f"{_SC}, {_BINS} SELECT dataset, model, b::INTEGER AS bin, sum(n)::BIGINT AS n, min(lo) AS lo, max(hi) AS hi, sum(t) / sum(n) AS f1_mean FROM cg GROUP BY dataset, model, b")
def rq3_length_curve(spark: SparkSession, d: str) -> DataFrame:
    length = bridge.documents(spark, d).select("dataset", "doc_id", F.size("toks").alias("n_words"))
    scored = _ten(spark, d).join(length, ["dataset", "doc_id"])
    return facts.length_curve(scored, "n_words", "f1", ["dataset", "model"]).withColumnRenamed("mean", "f1_mean")


@query("WITH r AS (SELECT p_brand AS ds, 'r' || p_partkey AS run_id, p_size % 4 AS a, p_partkey % 3 AS b FROM part), "
       "v AS (SELECT ds, 'a' AS param, '[{\"key\":\"b\",\"value\":\"' || b || '\"}]' AS rest, a AS v, run_id FROM r UNION ALL SELECT ds, 'b', '[{\"key\":\"a\",\"value\":\"' || a || '\"}]', b, run_id FROM r) "
       "SELECT ds, param, rest, count(DISTINCT v) AS n_values, string_agg(run_id, ',' ORDER BY run_id) AS runs FROM v GROUP BY ALL HAVING count(DISTINCT v) > 1")  # fmt: skip
def rq5_controlled_sweep(spark: SparkSession, d: str) -> DataFrame:
    params = F.create_map(F.lit("a"), (F.col("p_size") % 4).cast("string"), F.lit("b"), (F.col("p_partkey") % 3).cast("string"))
    runs = table(spark, d, "part").select(F.col("p_brand").alias("ds"), F.concat(F.lit("r"), "p_partkey").alias("run_id"), params.alias("params"))
    return facts.controlled_sweeps(runs, "params", ["ds"])


@query(f"{_SC}, common AS (SELECT dataset, doc_id FROM s GROUP BY ALL HAVING count(DISTINCT model) = 4) SELECT dataset, count(*) AS n FROM common GROUP BY 1")
def rq5_common_documents(spark: SparkSession, d: str) -> DataFrame:
    return scoring.common_documents(_ten(spark, d), "model", 4).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def relational_division(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    return facts.on_every(ev, ["user_id"], "event_type")


@query(f"WITH {BASE}, {_MAJ}, {_IDS}, {_TAGS} SELECT cov.model, cov.dataset, count(*) AS n_runs, min(coverage) AS coverage, max(CASE WHEN len(tags) > 1 THEN 1 ELSE 0 END) AS flagged FROM cov JOIN tags ON tags.dataset = cov.dataset AND tags.run_id = cov.run_id GROUP BY ALL")
def coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    cov = facts.majority_split(bridge.predictions(spark, d), bridge.documents(spark, d)).join(_tags(spark, d), scoring.RUN)
    return cov.groupBy("model", "dataset").agg(F.count(F.lit(1)).alias("n_runs"), F.min("coverage").alias("coverage"), F.max(F.when(F.size("tags") > 1, 1).otherwise(0)).alias("flagged"))
