"""A scan: from a tree of JSON files to the engine's tables.

Documents, gold, predictions and matches are one plan each over the tree's lines; what is read twice is the caller's to
store (``streaming.incremental`` does so by version). Cards are small and read on the driver. A document's own sections
and phrases stay in its row until they are classified; the only shuffles are by document: for the first line
of an id, for votes on languages, for the union of annotation sets and for the join of predictions with gold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.functions import phrases, stem, text
from phrasemill.operators import facts, matching, scoring
from phrasemill.operators.scoring import RUN
from phrasemill.sources import cards, jsonl, tree

#: Fixed value: the annotation set that unites all of a document's, where a card names several.
COMBINED = "@combined"
#: Cards beyond this size are no cards.
CARD_BYTES = 1 << 20
CARD = "dataset string, fields map<string,array<string>>, required array<string>, sets map<string,array<string>>, combined boolean, primary string"


@dataclass
class Scan:
    """The tables of a scan, lazily; ``wrong`` lists card files that hold no card."""

    documents: DataFrame
    gold: DataFrame
    predictions: DataFrame
    matches: DataFrame
    metrics: DataFrame
    tags: DataFrame
    issues: DataFrame
    wrong: dict[str, str]


def _languages(part: str) -> Column:
    """``languages`` or ``language`` of an object, one or several, as an array; empty if there are none."""
    value = F.coalesce(F.nullif(F.col(f"{part}.languages"), F.lit("")), F.nullif(F.col(f"{part}.language"), F.lit("")))
    listed = F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(value))
    return F.coalesce(F.filter(F.when(value.isNotNull(), listed), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def _first_of(*arrays: Column) -> Column:
    """The first array that is neither null nor empty."""
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays], F.array().cast("array<string>"))


def read_cards(spark: SparkSession, manifest: DataFrame) -> tuple[dict[str, dict[str, dict]], dict[str, str]]:
    """Cards by kind and name, and what is wrong with the files that hold none."""
    listed = manifest.where(F.col("kind").isin("dataset_card", "model_card", "architecture_card") & (F.col("size") <= CARD_BYTES)).select("path", "kind", "name").collect()
    if not listed:
        return {}, {}
    of = {r.path: r for r in listed}
    files = spark.read.format("binaryFile").load(list(of)).select(F.col("_metadata.file_path").alias("path"), "content").collect()
    found, wrong = cards.read_cards((r.path, bytes(r.content)) for r in files)
    by_kind: dict[str, dict[str, dict]] = {}
    for path, card in found.items():
        by_kind.setdefault(of[path].kind, {})[of[path].name] = card
    return by_kind, wrong


def dataset_cards(spark: SparkSession, found: dict[str, dict]) -> DataFrame:
    """What the derivation needs of each dataset's card: one row a dataset."""
    rows = []
    for name, card in found.items():
        fields = {f: cards.declared_languages(s) for f, s in (card.get("document") or {}).items() if isinstance(s, dict)}
        required = [f for f, s in (card.get("document") or {}).items() if isinstance(s, dict) and not s.get("optional") and s.get("required") is not False]
        sets = {a: cards.declared_languages(s) for a, s in (card.get("annotations") or {}).items() if isinstance(s, dict)}
        rows.append((name, fields, required, sets, len(sets) > 1, next((ls[0] for ls in fields.values() if ls), "en")))
    return spark.createDataFrame(rows, CARD)


def documents(lines: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of ``lines(dataset, path, byte_off, byte_len, value)``, the first line of each id; and per dataset what was left out.

    Columns: ``dataset, doc_id, split, path, byte_off, byte_len, sections (field, langs, content), annotations (key,
    langs, keyphrases), langs, words, stream, ends, flags, n_words, n_chars`` and the card's.
    """
    rows = jsonl.parsed(lines, jsonl.DOCUMENT)
    ids = rows.where("not bad").withColumn("doc_id", F.coalesce("obj._id", F.concat(F.lit("@"), F.col("byte_off").cast("string"))))
    repeated = facts.duplicate_groups(ids, ["dataset", "doc_id"], "byte_off").groupBy("dataset").agg(F.sum("n_extra").alias("duplicate_doc_ids"))
    broken = rows.groupBy("dataset").agg(F.count_if("bad").alias("bad_lines"), F.count_if(~F.col("bad") & F.col("obj._id").isNull()).alias("without_id"))
    left_out = broken.join(repeated, "dataset", "left").fillna(0, ["duplicate_doc_ids"])
    docs = facts.first_line_wins(ids, ["dataset", "doc_id"], ["path", "byte_off"]).join(known, "dataset", "left")
    section = F.transform(
        F.coalesce("obj.sections", F.expr("cast(array() AS " + jsonl.SECTION + ")")),
        lambda s: F.struct(F.coalesce(F.nullif(s["field"], F.lit("")), F.lit("?")).alias("field"), s["language"].alias("language"), s["languages"].alias("languages"), F.coalesce(s["content"], F.lit("")).alias("content")),
    )
    docs = docs.withColumn("__s", section)
    langs = F.transform("__s", lambda s: F.struct(s["field"].alias("field"), _first_of(_of(s), F.coalesce("fields", F.create_map().cast("map<string,array<string>>"))[s["field"]]).alias("langs"), s["content"].alias("content")))
    docs = docs.withColumn("sections", langs).withColumn("langs", F.array_distinct(F.flatten(F.col("sections.langs"))))
    docs = docs.withColumn("__a", phrases.analysed_sections(F.col("sections.content")))
    keyed = F.transform(
        F.coalesce("obj.annotations", F.expr("cast(array() AS " + jsonl.ANNOTATION + ")")),
        lambda a: F.struct(
            F.coalesce(F.nullif(a["annotator"], F.lit("")), F.lit("annotation")).alias("key"),
            _first_of(_of(a), F.coalesce("sets", F.create_map().cast("map<string,array<string>>"))[F.coalesce(F.nullif(a["annotator"], F.lit("")), F.lit("annotation"))], F.col("langs")).alias("langs"),
            F.coalesce(a["keyphrases"], F.array().cast("array<string>")).alias("keyphrases"),
        ),
    )
    docs = docs.withColumn("annotations", keyed)
    return docs.select(
        "dataset", "doc_id", F.get_json_object("obj.metadata", "$.split").alias("split"), "path", "byte_off", "byte_len", "sections", "annotations", "langs",
        F.col("__a.sections").alias("words"), F.col("__a.stream").alias("stream"), F.col("__a.ends").alias("ends"),
        F.size(F.filter("__a.stream", lambda t: t != text.SENTINEL)).alias("n_words"),
        F.aggregate("sections", F.lit(0), lambda n, s: n + F.length(s["content"])).alias("n_chars"),
        "required", F.coalesce("combined", F.lit(False)).alias("combined"), F.coalesce("primary", F.lit("en")).alias("primary"),
    ), left_out


def _of(part: Column) -> Column:
    """``_languages`` of a struct inside a lambda."""
    value = F.coalesce(F.nullif(part["languages"], F.lit("")), F.nullif(part["language"], F.lit("")))
    listed = F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(value))
    return F.coalesce(F.filter(F.when(value.isNotNull(), listed), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def annotations(docs: DataFrame) -> DataFrame:
    """``dataset, doc_id, place, key, lang, langs, phrases``: one row per annotation set, its phrases analysed in its language."""
    rows = docs.select("dataset", "doc_id", F.posexplode_outer("annotations").alias("place", "a")).where("place IS NOT NULL")
    rows = rows.select("dataset", "doc_id", "place", F.col("a.key").alias("key"), F.get("a.langs", F.lit(0)).alias("lang"), F.col("a.langs").alias("langs"), F.transform("a.keyphrases", text.variants).alias("v"))
    return rows.withColumn("phrases", phrases.analysed_phrases("v", "lang")).drop("v")


def flags(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``dataset, doc_id, flags``: sections that the card requires and the document lacks, and votes that contradict declared languages."""
    missing = F.transform(F.array_except(F.coalesce("required", F.array().cast("array<string>")), F.col("sections.field")), lambda f: F.concat(F.lit("missing_section:"), f))
    lacking = docs.select("dataset", "doc_id", F.explode(missing).alias("flag"))
    of_sections = docs.select("dataset", "doc_id", F.explode(F.arrays_zip("sections", "words")).alias("z"))
    of_sections = of_sections.select("dataset", "doc_id", F.concat(F.lit("section:"), "z.sections.field").alias("what"), F.col("z.sections.langs").alias("langs"), F.filter("z.words", lambda t: t != text.SENTINEL).alias("t"))
    of_sets = sets.select("dataset", "doc_id", F.concat(F.lit("ann:"), "key").alias("what"), "langs", F.flatten(F.transform("phrases", lambda vs: F.get(vs, F.lit(0))["words"])).alias("t"))
    votes = of_sections.where(F.size("t") >= text.SECTION_WORDS).unionByName(of_sets.where(F.size("t") >= text.ANNOTATION_WORDS))
    shares = text.stop_word_shares(votes, ["dataset", "doc_id", "what", "langs"], "t")
    against = shares.where(text.contradicts("shares", F.col("langs"))).select("dataset", "doc_id", F.concat(F.lit("lang_mismatch:"), "what").alias("flag"))
    return lacking.unionByName(against).groupBy("dataset", "doc_id").agg(F.array_sort(F.collect_set("flag")).alias("flags"))


def gold_sets(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``dataset, doc_id, ann_key, gold, n_empty, n_repeated``: classified gold of every annotation set, the united one included.

    A phrase without words is dropped, one with the alternatives of an earlier one too. Gold structs: ``display, surface,
    stems, lang, n_words, prmu, end_word, end_char``.
    """
    rows = sets.join(docs.select("dataset", "doc_id", "stream", "ends", "combined"), ["dataset", "doc_id"])
    rows = rows.withColumn("pad", text.padded(stem.stemmed("stream", "lang")))
    rows = rows.withColumn("all", F.expr("transform(phrases, p -> filter(p, v -> size(v.stems) > 0))"))
    rows = rows.withColumn("all", F.expr("transform(all, p -> named_struct('v', p, 'stems', array_distinct(transform(p, x -> array_join(x.stems, ' ')))))"))
    rows = rows.withColumn("all", F.expr("transform(all, p -> named_struct('v', p.v, 'stems', p.stems, 'mark', array_join(array_sort(p.stems), '\\n')))"))
    rows = rows.withColumn("some", F.expr("filter(all, p -> size(p.stems) > 0)"))
    rows = rows.withColumn("kept", _distinct("some"))
    alternatives = "concat(transform(p.v, x -> x.stems), filter(transform(p.v, x -> x.marked), x -> size(x) > 0))"
    rows = rows.withColumn("kept", F.expr(f"transform(kept, p -> named_struct('p', p, 'c', {text.prmu_sql(alternatives, 'pad')}))"))
    one = F.expr(
        "transform(kept, k -> named_struct('display', k.p.v[0].kp, 'surface', k.p.v[0].surface, 'stems', k.p.stems, 'mark', k.p.mark, 'lang', lang, 'n_words', size(k.p.v[0].words), "
        "'prmu', k.c.class, 'end_word', k.c.end_word, 'end_char', CASE WHEN k.c.end_word >= 0 THEN get(ends, k.c.end_word) ELSE -1 END))"
    )
    own = rows.select("dataset", "doc_id", "place", F.col("key").alias("ann_key"), one.alias("gold"), "combined", (F.size("all") - F.size("some")).alias("n_empty"), (F.size("some") - F.size("kept")).alias("n_repeated"))
    # A document's own sets, few whatever the input.
    united = own.where("combined").groupBy("dataset", "doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "gold"))).alias("l"))
    united = united.select("dataset", "doc_id", F.lit(COMBINED).alias("ann_key"), F.flatten("l.gold").alias("some"))
    united = united.select("dataset", "doc_id", "ann_key", _distinct("some").alias("gold"), F.lit(0).alias("n_empty"), F.lit(0).alias("n_repeated"))
    return own.drop("place", "combined").unionByName(united)


def _distinct(column: str) -> Column:
    """Elements of an array whose ``mark`` no earlier one has."""
    return F.expr(f"filter({column}, (p, i) -> NOT exists(slice({column}, 1, i), o -> o.mark = p.mark))")


def gold_rows(sets: DataFrame) -> DataFrame:
    """Gold in long form: ``dataset, doc_id, ann_key, kp_idx, display, surface, stems, lang, n_words, prmu, end_word, end_char``."""
    rows = sets.select("dataset", "doc_id", "ann_key", F.posexplode_outer("gold").alias("kp_idx", "g")).where("kp_idx IS NOT NULL")
    return rows.select("dataset", "doc_id", "ann_key", "kp_idx", *[F.col(f"g.{c}").alias(c) for c in ("display", "surface", "stems", "lang", "n_words", "prmu", "end_word", "end_char")])


def predictions(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``run, doc_id, inferences, costs, batch_idx, byte_off``: the first line of each document of a run; and lines beyond it per run."""
    rows = jsonl.parsed(lines, jsonl.PREDICTION).where("not bad")
    rows = rows.select(*RUN, F.coalesce("obj._id", F.concat(F.lit("@"), F.col("byte_off").cast("string"))).alias("doc_id"), F.coalesce("obj.inferences", F.array().cast("array<string>")).alias("inferences"), F.col("obj.costs").alias("costs"), "batch_idx", "byte_off")
    extra = rows.groupBy(*RUN, "doc_id").agg((F.count(F.lit(1)) - 1).alias("x")).groupBy(*RUN).agg(F.sum("x").alias("n_repeated"))
    return facts.first_line_wins(rows, [*RUN, "doc_id"], ["batch_idx", "byte_off"]), extra


def matches(preds: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Matches of predictions with every annotation set, in the languages of its gold."""
    sets = sets.where(F.size("gold") > 0).join(docs.select("dataset", "doc_id", "primary"), ["dataset", "doc_id"])
    sets = sets.select("dataset", "doc_id", "ann_key", "primary", F.col("gold.stems").alias("gold"), F.transform("gold.lang", lambda x: F.coalesce(F.substring(x, 1, 2), F.lit("en"))).alias("langs"))
    sets = sets.withColumn("several", F.size(F.array_distinct("langs")) > 1).withColumn("overlap", matching.variants_overlap("gold"))
    rows = preds.select(*RUN, "doc_id", "inferences").join(sets, ["dataset", "doc_id"])
    stems = phrases.phrase_stems(F.col("inferences"), F.when(F.col("several"), F.col("primary")).otherwise(F.get("langs", F.lit(0))))
    rows = rows.withColumn("preds", matching.unique_in_order(stems))
    mixed = F.when(F.col("several"), F.col("gold"))
    many = phrases.multilingual_matches(F.col("inferences"), F.col("primary"), F.col("langs"), mixed)
    hits = F.when(F.col("several"), many).otherwise(matching.hits("preds", "gold", F.col("overlap") & ~F.col("several")))
    return rows.select(*RUN, "doc_id", "ann_key", F.size("preds").alias("n_uniq"), F.size("gold").alias("n_gold"), hits.alias("hits"))


def scan(spark: SparkSession, root: str) -> Scan:
    """All tables of the tree below ``root`` (a folder that every executor can read)."""
    manifest = tree.discovered(spark, root)
    by_kind, wrong = read_cards(spark, manifest)
    known = dataset_cards(spark, by_kind.get("dataset_card", {}))
    paths = {r.path: r for r in manifest.where(F.col("kind").isin("collection", "batch")).select("path", "kind").collect()}
    lines = {kind: _lines(spark, [p for p, r in paths.items() if r.kind == kind]) for kind in ("collection", "batch")}
    docs, left_out = documents(lines["collection"], known)
    sets = annotations(docs)
    docs = docs.join(flags(docs, sets), ["dataset", "doc_id"], "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    every = gold_sets(docs, sets)
    # Gold is kept of evaluated and of flagged documents.
    scope = docs.where(scoring.is_eval_split("split") | (F.size("flags") > 0)).select("dataset", "doc_id")
    kept = every.join(scope, ["dataset", "doc_id"], "left_semi")
    preds, extra = predictions(lines["batch"])
    found = matches(preds, kept, docs)
    counted = every.groupBy("dataset").agg(F.sum("n_empty").alias("gold_empty"), F.sum("n_repeated").alias("gold_duplicates"))
    coverage = facts.majority_split(preds, docs).join(facts.id_counts(preds, docs, found), RUN).join(extra, RUN)
    run_cards = manifest.where("kind = 'run_card'").select(*RUN).distinct().withColumn("has_card", F.lit(True))
    tags = facts.run_tags(coverage.join(run_cards, RUN, "left").withColumn("has_card", F.coalesce("has_card", F.lit(False))))
    return Scan(docs, gold_rows(kept), preds, found, scoring.run_metrics(found), tags, left_out.join(counted, "dataset", "left"), wrong)


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of the files with what their paths say."""
    from urllib.parse import unquote, urlparse

    if not paths:
        return spark.createDataFrame([], "path string, byte_off long, byte_len long, value string").select("*", *tree.classified("path"))
    rows = jsonl.offset_lines(spark, [unquote(urlparse(p).path) if p.startswith("file:") else p for p in paths])
    return rows.select("*", *tree.classified("path"))
