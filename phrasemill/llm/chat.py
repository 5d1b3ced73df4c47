"""Preference formatting: shared prompt, paired completions, and masks.

Chosen and rejected conversations of a pair are compared turn by turn. Their longest common turn prefix is
rendered once as the prompt; what follows in each is its completion. A completion's mask marks the spans
(code points of the completion) that count in training: the texts of assistant turns with their end mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A turn is rendered as ``<|role|>\\ntext<|end|>\\n``.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"
SIDES = ("chosen", "rejected")


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t.role, F.lit(CLOSE), t.text, F.lit(END))), "")


def _mask(turns: str) -> Column:
    """``start:stop`` of every trained turn of a completion, joined by commas."""
    head = f"length('{OPEN}') + length(t.role) + {len(CLOSE)}"
    return F.expr(
        f"array_join(aggregate({turns}, named_struct('at', 0, 'o', cast(array() AS array<string>)), (a, t) -> named_struct("
        f"'at', a.at + {head} + length(t.text) + {len(END)}, 'o', CASE WHEN t.role = '{TRAINED}' THEN concat(a.o, array(concat("
        f"a.at + {head}, ':', a.at + {head} + length(t.text) + {len(END)}))) ELSE a.o END), a -> a.o), ',')"
    )


def _turn() -> Column:
    return F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def preference_pairs(turns: DataFrame, pair: str = "pair_id", side: str = "side") -> DataFrame:
    """One row per pair of ``turns(pair, side, turn, role, text)``, ``side`` being chosen or rejected.

    Columns as of ``formatted``. Turns go by their number, then role and text; exact repeats of a turn are one turn.
    Turns without pair, number or one of the two sides are left out, as is a pair that lacks a side.
    """
    known = turns.where(F.col(pair).isNotNull() & F.col("turn").isNotNull() & F.col(side).isin(*SIDES))
    # A conversation becomes one row of the result, so its turns have to meet; the two sides of a pair do too.
    lists = known.groupBy(pair).agg(*[F.array_sort(F.collect_set(F.when(F.col(side) == s, _turn()))).alias(s) for s in SIDES])
    return formatted(lists.where(" AND ".join(f"size({s}) > 0" for s in SIDES)), pair)


def formatted(lists: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Rows of ``lists(pair, chosen, rejected)``, whose sides are arrays of turns, as prompt and completions.

    Columns: the pair, ``prompt_turns``, ``prompt``, and for each side ``<side>`` (the completion) and
    ``<side>_mask``. Null roles and texts are rendered as empty and are equal to each other. If both sides are
    equal, both completions are empty.
    """
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a.role == b.role) & (a.text == b.text), F.lit(False)))
    both = lists.withColumn("__at", F.array_position(same, False).cast("int")).withColumn("__n", F.when(F.col("__at") > 0, F.col("__at") - 1).otherwise(F.size("chosen")))
    both = both.withColumn("__prompt", F.expr("slice(chosen, 1, __n)"))
    for s in SIDES:
        both = both.withColumn(f"__rest_{s}", F.expr(f"slice({s}, __n + 1, size({s}))"))
    return both.select(
        pair,
        F.col("__n").cast("long").alias("prompt_turns"),
        _rendered(F.col("__prompt")).alias("prompt"),
        *[c for s in SIDES for c in (_rendered(F.col(f"__rest_{s}")).alias(s), _mask(f"__rest_{s}").alias(f"{s}_mask"))],
    )


def swapped_endings(conversations: DataFrame) -> DataFrame:
    """``pair_id, chosen, rejected`` (arrays of turns) from plain conversations ``(conv_id, turn, role, text)``.

    Conversations 2p and 2p + 1 give two pairs: each is chosen as it is, and rejected with its last turn taken
    from the other. A conversation whose neighbour is missing has its own last turn left out instead, and no pair
    if it has no other. Turns without conversation or number are left out; exact repeats are one turn.
    """
    own = conversations.where("conv_id is not null and turn is not null").groupBy("conv_id").agg(F.array_sort(F.collect_set(_turn())).alias("turns"))
    # Two rows at most.
    pairs = own.groupBy(F.shiftright("conv_id", 1).alias("p")).agg(F.collect_list(F.struct("conv_id", "turns")).alias("both"))
    rows = pairs.select("both", F.explode("both").alias("own")).select(F.col("own.conv_id").alias("pair_id"), F.col("own.turns").alias("chosen"), "both")
    rows = rows.withColumn("other", F.expr("get(filter(both, x -> x.conv_id <> pair_id), 0).turns")).withColumn("last", F.expr("element_at(chosen, -1).turn"))
    ending = F.expr("transform(filter(other, t -> t.turn = element_at(other, -1).turn), t -> named_struct('turn', last, 'role', t.role, 'text', t.text))")
    ending = F.coalesce(ending, F.expr("filter(chosen, t -> false)"))
    rejected = F.array_sort(F.concat(F.expr("filter(chosen, t -> t.turn < last)"), ending))
    return rows.select("pair_id", "chosen", rejected.alias("rejected")).where("size(rejected) > 0")


def _oracle() -> str:
    def render(rows: str) -> str:
        return f"coalesce(array_to_string(list_transform({rows}, lambda t: '{OPEN}' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '')"

    def size(t: str) -> str:
        return f"(length('{OPEN}') + length({t}.role) + {len(CLOSE)} + length({t}.text) + {len(END)})"

    def mask(rows: str) -> str:
        at = f"coalesce(list_sum(list_transform({rows}[1:i - 1], lambda u: {size('u')})), 0)"
        span = f"({at} + {len(OPEN)} + length({rows}[i].role) + {len(CLOSE)})::BIGINT || ':' || ({at} + {size(f'{rows}[i]')})::BIGINT"
        return f"coalesce(array_to_string(list_transform(list_filter(range(1, len({rows}) + 1), lambda i: {rows}[i].role = '{TRAINED}'), lambda i: {span}), ','), '')"

    lists = ", ".join(f"list_sort(list(DISTINCT {{'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')}}) FILTER (side = '{s}')) AS {s}" for s in SIDES)
    return (
        "WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL), "
        "m AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM t), "
        "p AS (SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM t UNION ALL SELECT conv_id, 'rejected', turn, role, text FROM m WHERE turn < last "
        "UNION ALL SELECT DISTINCT a.conv_id, 'rejected', a.last, b.role, b.text FROM m a JOIN m b ON b.conv_id = xor(a.conv_id, 1) WHERE b.turn = b.last), "
        f"l AS (SELECT pair_id, {lists} FROM p GROUP BY 1), "
        "n AS (SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(chosen), len(rejected)) + 1), lambda i: chosen[i].role IS DISTINCT FROM rejected[i].role OR chosen[i].text IS DISTINCT FROM rejected[i].text)) - 1, len(chosen)) AS n "
        "FROM l WHERE len(chosen) > 0 AND len(rejected) > 0), "
        "r AS (SELECT pair_id, n, chosen[1:n] AS head, chosen[n + 1:len(chosen)] AS c, rejected[n + 1:len(rejected)] AS r FROM n) "
        f"SELECT pair_id, n::BIGINT AS prompt_turns, {render('head')} AS prompt, {render('c')} AS chosen, {mask('c')} AS chosen_mask, {render('r')} AS rejected, {mask('r')} AS rejected_mask FROM r"
    )


ORACLE = _oracle()
