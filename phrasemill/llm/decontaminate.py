"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders; the remaining words are lower-cased and stripped of
punctuation. A capitalised word that opens a text, a line, a sentence or a quotation may be a name or not, so
it is read both ways. Every window of ``WIDTH`` canonical tokens is hashed and joined with the windows of the
benchmark items:

* a window with ``MIN_LITERALS`` words or more by its template, under each reading of its opening words;
* a window of fewer words (formulas, series, lists of names) by its words and the slots' own values.

Along each alignment (document position minus item position) the slots must be consistent: one benchmark
value always stands for one document value. Where it does not, the windows around the values that differ
from the benchmark's are dropped and the others count, so that a re-parameterised question is caught, a long
copy isn't lost to one changed number, and a mere lookalike is left alone. All of it is DataFrame expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.common import discard, sized, stored

WIDTH = 5
#: Windows with fewer words are looked up with the values of their slots.
MIN_LITERALS = 3
#: Shorter items say too little inside another text; they match only a text of the same tokens.
MIN_TOKENS = 3
#: An item counts as leaked when this share of its windows is found, or ...
MIN_SHARE = 0.5
#: ... when so many windows lie on one alignment (13 words in a row).
MIN_RUN = 9

# RE2 and Java read these alike: no look-around. A slot is wrapped in its mark and END, an opening word follows OPEN.
OPEN, END = "\x04", "\x05"
OPENING = "([\\n.!?:\"“”(\\[][\"“(\\[ \\t\\r\\n]*)(\\p{Lu})"  # after a line break put first
NAME = r"([\p{Ll}0-9,;] )(\p{Lu}[\p{L}'-]*(?: \p{Lu}[\p{L}'-]*)*)"
UNIT = (
    r"([0-9]) ?(km|kg|mg|cm|mm|ml|m|g|l|h|s|min|sec|hours?|minutes?|seconds?|days?|weeks?|months?|years?|"
    r"miles?|metres?|meters?|litres?|liters?|grams?|dollars?|euros?|percent)([^\p{L}0-9]|$)"
)
NUMBER = r"([0-9]+(?:[.,][0-9]+)*)"
# Java matches a repeated group by recursion, which a long run of names or figures overflows, unless it is possessive. Nothing
# follows the groups, so that they match the same.
LONG_NAME, LONG_NUMBER = (p.removesuffix("*)") + "*+)" for p in (NAME, NUMBER))
SLOTS = {"name": "\x01", "unit": "\x02", "number": "\x03"}
TOKEN = "[\x01-\x03][^\x05]*\x05|\x04?[\\p{L}\\p{M}]+"


def _canonical(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``tokens``: words (after OPEN if they open a sentence) and slots (their mark, the value, END)."""
    # A text's own control characters must not pass for marks.
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\x01-\x05]", " ")
    t = F.regexp_replace(F.concat(F.lit("\n"), t), OPENING, f"$1{OPEN}$2")
    t = F.regexp_replace(t, LONG_NAME, f"$1 \x01$2{END} ")
    t = F.regexp_replace(t, UNIT, f"$1 \x02$2{END} $3")
    t = F.regexp_replace(t, LONG_NUMBER, f" \x03$1{END} ")
    return df.withColumn("tokens", F.regexp_extract_all(F.lower(t), F.lit(TOKEN), F.lit(0)))


def _windows(df: DataFrame, widths: list[int]) -> DataFrame:
    """``pos, h`` beside the other columns of ``df(tokens, ...)``: the hashes of every window.

    ``widths``: what shorter windows are wanted besides those of ``WIDTH``.
    """
    others = [c for c in df.columns if c != "tokens"]
    # A token's code: the hash of its text, and in the last three bits 1 to 3 for a slot's kind, 4 for an opening word.
    code = F.transform("tokens", _code)
    df = df.select(*others, F.size("tokens").alias("n"), code.alias("codes"))
    shifted = [F.col("codes")] + [F.slice("codes", F.lit(k + 1), F.size("codes")) for k in range(1, WIDTH)]
    # The outer generators keep Spark from deriving a filter on the size of the generated array, for which it
    # would evaluate the whole expression once more under the scan.
    zipped = F.arrays_zip(*(c.alias(f"c{k}") for k, c in enumerate(shifted)))
    rows = df.select(*others, "n", F.posexplode_outer(zipped).alias("pos", "w")).select(*others, "n", "pos", "w.*")
    token = [F.col(f"c{k}") for k in range(WIDTH)]
    kind = [t.bitwiseAND(7) for t in token]
    value = [t.bitwiseAND(-8) for t in token]
    template = [F.when(k.between(1, 3), k).otherwise(v) for k, v in zip(kind, value, strict=True)]
    opened = [F.when(k == 4, F.lit(1)).otherwise(t) for k, t in zip(kind, template, strict=True)]
    slots = reduce(Column.__add__, [k.between(1, 3).cast("int") for k in kind])
    opening = reduce(Column.__add__, [(k == 4).cast("int") for k in kind])
    full = token[-1].isNotNull()
    hashes = [
        F.when(full, F.when(slots <= WIDTH - MIN_LITERALS, F.xxhash64(*template)).otherwise(F.xxhash64(*value))),
        F.when(full & (opening > 0) & (slots + opening <= WIDTH - MIN_LITERALS), F.xxhash64(*opened)),
        *([F.when((F.col("n") < MIN_TOKENS) & (F.col("pos") == 0), F.xxhash64(*value, F.lit(0)))] if 0 in widths else []),
        *(F.when(token[k - 1].isNotNull() & (F.col("n") >= MIN_TOKENS), F.xxhash64(*value[:k], F.lit(k))) for k in widths if k),
    ]
    return rows.select(*others, "pos", F.explode_outer(F.array(*hashes)).alias("h")).where("h is not null")


def _code(token: Column) -> Column:
    first = F.ascii(token)
    return F.xxhash64(F.when(first == 4, F.substring(token, 2, 1 << 30)).otherwise(token)).bitwiseAND(-8).bitwiseOR(F.when(first <= 4, first).otherwise(0).cast("long"))


def _slots(df: DataFrame, key: str) -> DataFrame:
    """``key, pos, slot, value``: every slot and opening word of ``df(key, tokens)``."""
    rows = df.select(key, F.posexplode_outer("tokens").alias("pos", "t")).where(F.col("t") < END)
    kind = reduce(lambda c, kv: c.when(F.col("t").startswith(kv[1]), kv[0]), SLOTS.items(), F).otherwise("name")
    return rows.select(key, "pos", kind.alias("slot"), F.translate("t", "".join(SLOTS.values()) + OPEN + END, "").alias("value"))


def leaks(docs: DataFrame, items: DataFrame, min_share: float = MIN_SHARE, min_run: int = MIN_RUN) -> DataFrame:
    """``doc_id, item_id, n_windows, item_windows, same_slots`` of each leaked item of each document.

    ``docs(doc_id, text, ...)`` and ``items(item_id, text, ...)``; other columns are ignored. Null, empty
    and wordless texts match nothing. An item of fewer than ``WIDTH`` tokens is one window of them, slots by their
    values; of fewer than ``MIN_TOKENS``, it matches only a text of the same tokens. Rows that repeat a
    doc_id count as one document; rows without an id are left out. ``n_windows``: the item's windows that are found
    on alignments with consistent slots; ``same_slots``: all slots there have the benchmark's own values.
    """
    bench = _canonical(items.where("item_id is not null").select("item_id", "text").dropDuplicates()).select("item_id", "tokens")
    bench = stored(bench.where(F.size("tokens") > 0))
    # Widths of the items below WIDTH, 0 for those that match whole texts only.
    width = F.when(F.size("tokens") < MIN_TOKENS, 0).otherwise(F.size("tokens")).alias("n")
    short = sorted(r.n for r in bench.select(width).where(F.col("n") < WIDTH).distinct().collect())
    # A window that is shorter than the item and than WIDTH is no window of it.
    whole = bench.where(F.size("tokens") < WIDTH)
    wanted = _windows(bench.where(F.size("tokens") >= WIDTH), [])
    for k in short:
        wanted = wanted.unionByName(_windows(whole.select("*", width).where(F.col("n") == k).drop("n"), [k]))
    wanted = stored(wanted.withColumnRenamed("pos", "ipos").distinct())
    total = wanted.groupBy("item_id").agg(F.countDistinct("ipos").alias("item_windows"))
    rows = _windows(_canonical(docs.where("doc_id is not null").select("doc_id", "text")).select("doc_id", "tokens"), short).withColumnRenamed("pos", "dpos")
    hits = stored(rows.join(sized(wanted), "h").select("doc_id", "item_id", "ipos", (F.col("dpos") - F.col("ipos")).alias("diag")).distinct())
    # The slots that the found windows hold, here and there.
    theirs = _slots(bench, "item_id").select("item_id", F.col("pos").alias("ip"), "slot", F.col("value").alias("theirs"))
    inside = theirs.select("*", F.explode(F.sequence(F.greatest(F.col("ip") - (WIDTH - 1), F.lit(0)), "ip")).alias("ipos"))
    needed = stored(hits.join(sized(inside), ["item_id", "ipos"]).select("doc_id", "item_id", "diag", "ip", (F.col("ip") + F.col("diag")).alias("pos"), "slot", "theirs").distinct())
    within = docs.select("doc_id", "text").join(sized(needed.select("doc_id").distinct()), "doc_id", "left_semi")
    ours = _slots(_canonical(within), "doc_id").select("doc_id", "pos", "slot", F.col("value").alias("ours")).distinct()
    filled = stored(needed.join(ours, ["doc_id", "pos", "slot"]))
    line = ["doc_id", "item_id", "diag"]
    several = filled.groupBy(*line, "slot", "theirs").agg(F.min("ours").alias("a"), F.max("ours").alias("b")).where("a <> b")
    clash = filled.join(several.drop("a", "b"), [*line, "slot", "theirs"], "left_semi").where("ours <> theirs")
    lost = clash.select(*line, F.explode(F.sequence(F.col("ip") - (WIDTH - 1), "ip")).alias("ipos")).distinct()
    kept = hits.join(lost, [*line, "ipos"], "left_anti")
    same = filled.groupBy(*line).agg(F.min(F.col("ours") == F.col("theirs")).alias("same"))
    runs = kept.groupBy(*line).agg(F.count(F.lit(1)).alias("run")).join(same, line, "left")
    runs = runs.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.min(F.coalesce("same", F.lit(True))).alias("same_slots"))
    found = kept.groupBy("doc_id", "item_id").agg(F.countDistinct("ipos").alias("n_windows")).join(runs, ["doc_id", "item_id"])
    result = (
        found.join(total, "item_id")
        .where((F.col("n_windows") >= F.lit(min_share) * F.col("item_windows")) | (F.col("run") >= min_run))
        .select("doc_id", "item_id", "n_windows", "item_windows", "same_slots")
    )
    discard(docs.sparkSession, needed)
    return result


def _oracle() -> str:
    marks = " || ".join(f"chr({i})" for i in range(1, 6))

    def canon(source: str, key: str) -> str:
        t = f"chr(10) || translate(coalesce(text, ''), {marks}, '     ')"
        name, opening = NAME.replace("'", "''"), OPENING.replace("\\n", "\n").replace("\\t", "\t").replace("\\r", "\r")
        for pattern, new in (
            (opening, "'\\1' || chr(4) || '\\2'"),
            (name, "'\\1 ' || chr(1) || '\\2' || chr(5) || ' '"),
            (UNIT, "'\\1 ' || chr(2) || '\\2' || chr(5) || ' \\3'"),
            (NUMBER, "' ' || chr(3) || '\\1' || chr(5) || ' '"),
        ):
            t = f"regexp_replace({t}, '{pattern}', {new}, 'g')"
        token = "'[' || chr(1) || '-' || chr(3) || '][^' || chr(5) || ']*' || chr(5) || '|' || chr(4) || '?[\\p{L}\\p{M}]+'"
        return f"SELECT {key}, regexp_extract_all(lower({t}), {token}) AS tokens FROM {source} WHERE {key} IS NOT NULL"

    def windows(source: str, key: str) -> str:
        value = "list_transform(w, lambda t: ltrim(t, chr(4)))"
        template = "list_transform(w, lambda t: CASE WHEN t < chr(4) THEN left(t, 1) ELSE ltrim(t, chr(4)) END)"
        opened = "list_transform(w, lambda t: CASE WHEN left(t, 1) = chr(4) THEN chr(1) WHEN t < chr(4) THEN left(t, 1) ELSE t END)"
        words, plain = "len(list_filter(w, lambda t: t >= chr(4)))", "len(list_filter(w, lambda t: t >= chr(5)))"
        hashes = [
            f"CASE WHEN len(w) = {WIDTH} THEN CASE WHEN {words} >= {MIN_LITERALS} THEN 't' || array_to_string({template}, ' ') ELSE 'v' || array_to_string({value}, ' ') END END",
            f"CASE WHEN len(w) = {WIDTH} AND {plain} < {words} AND {plain} >= {MIN_LITERALS} THEN 't' || array_to_string({opened}, ' ') END",
            f"CASE WHEN n < {MIN_TOKENS} AND pos = 0 THEN 'w' || array_to_string({value}, ' ') END",
            *(f"CASE WHEN len(w) >= {k} AND n >= {MIN_TOKENS} THEN '{k}' || array_to_string({value}[1:{k}], ' ') END" for k in range(MIN_TOKENS, WIDTH)),
        ]
        return (
            f"SELECT {key}, pos, n, h, len(w) AS size FROM (SELECT {key}, pos, n, w, unnest([{', '.join(hashes)}]) AS h FROM (SELECT {key}, len(tokens) AS n, i - 1 AS pos, tokens[i:i + {WIDTH - 1}] AS w "
            f"FROM (SELECT {key}, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM {source}))) WHERE h IS NOT NULL"
        )

    def slots(source: str, key: str) -> str:
        kind = "CASE left(t, 1) " + " ".join(f"WHEN chr({ord(c)}) THEN '{k}'" for k, c in SLOTS.items()) + " ELSE 'name' END"
        return (
            f"SELECT {key}, i - 1 AS pos, {kind} AS slot, translate(t, {marks}, '') AS value "
            f"FROM (SELECT {key}, unnest(range(1, len(tokens) + 1)) AS i, unnest(tokens) AS t FROM {source}) WHERE t < chr(5)"
        )

    line = "doc_id, item_id, diag"
    return (
        f"WITH dc AS ({canon('documents', 'doc_id')}), bc AS ({canon('(SELECT DISTINCT item_id, text FROM benchmark)', 'item_id')}), dw AS ({windows('dc', 'doc_id')}), "
        f"bw AS (SELECT DISTINCT item_id, pos, h FROM ({windows('bc', 'item_id')}) WHERE n >= {WIDTH} AND (h LIKE 't%' OR h LIKE 'v%') OR n < {WIDTH} AND pos = 0 AND (h LIKE 'w%' OR left(h, 1) = n::VARCHAR)), "
        "total AS (SELECT item_id, count(DISTINCT pos) AS item_windows FROM bw GROUP BY 1), "
        "hits AS (SELECT DISTINCT doc_id, item_id, bw.pos AS ipos, dw.pos - bw.pos AS diag FROM dw JOIN bw USING (h)), "
        f"bs AS ({slots('bc', 'item_id')}), ds AS ({slots('(SELECT * FROM dc WHERE doc_id IN (SELECT doc_id FROM hits))', 'doc_id')}), "
        f"needed AS (SELECT DISTINCT {line.replace('item_id', 'hits.item_id')}, bs.pos AS ip, slot, value AS theirs FROM hits JOIN bs ON bs.item_id = hits.item_id AND bs.pos BETWEEN ipos AND ipos + {WIDTH - 1}), "
        "filled AS (SELECT DISTINCT n.*, ds.value AS ours FROM needed n JOIN ds ON ds.doc_id = n.doc_id AND ds.pos = n.ip + n.diag AND ds.slot = n.slot), "
        f"several AS (SELECT {line}, slot, theirs FROM filled GROUP BY ALL HAVING min(ours) <> max(ours)), "
        f"clash AS (SELECT DISTINCT {line}, ip FROM filled JOIN several USING ({line}, slot, theirs) WHERE ours <> theirs), "
        f"kept AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM clash c WHERE c.doc_id = h.doc_id AND c.item_id = h.item_id AND c.diag = h.diag AND c.ip BETWEEN h.ipos AND h.ipos + {WIDTH - 1})), "
        f"same AS (SELECT {line}, bool_and(ours = theirs) AS same FROM filled GROUP BY ALL), "
        f"lines AS (SELECT {line}, count(*) AS run FROM kept GROUP BY ALL), "
        f"runs AS (SELECT doc_id, item_id, max(run) AS run, bool_and(coalesce(same, true)) AS same_slots FROM lines LEFT JOIN same USING ({line}) GROUP BY 1, 2), "
        "found AS (SELECT doc_id, item_id, count(DISTINCT ipos) AS n_windows FROM kept GROUP BY 1, 2) "
        "SELECT doc_id, item_id, n_windows, item_windows, same_slots FROM found JOIN runs USING (doc_id, item_id) JOIN total USING (item_id) "
        f"WHERE n_windows >= {MIN_SHARE} * item_windows OR run >= {MIN_RUN}"
    )


ORACLE = _oracle()
