"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

Everything is a row-wise column expression: one scan, no shuffle, no Python. A span's offsets are code
points, found by adding up the matches and the text between them (the same pattern extracts and splits).
The patterns are written with possessive loops and look-behinds so that long texts cost linear time; they
match what the plain patterns of ``PLAIN`` match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The plain patterns, in the order in which kinds are listed.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: IBAN lengths by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21,
    "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
IBAN = "|".join(f"{c}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items())

PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": IBAN,
}
#: What a text must hold for the kind's pattern to be run at all.
GATE = {
    "email": r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){12}",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]",
}
BASE = tuple(PLAIN)
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT = {
    "email": r"mail|contact|write|adres|correo|courriel",
    "ip": r"\bip\b|address|host|server|adresse",
    "card": r"card|visa|master|credit|debit|pay|karte|carte|tarjeta",
    "phone": r"phone|call|tel|mobile|fax|ruf|appel|llam",
    "iban": r"iban|bank|account|konto|compte|cuenta",
}
#: Characters before a match that are searched for its context words.
NEAR = 40

_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length({d})), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN int(substr(reverse({d}), i, 1)) "
    "WHEN int(substr(reverse({d}), i, 1)) > 4 THEN 2 * int(substr(reverse({d}), i, 1)) - 9 "
    "ELSE 2 * int(substr(reverse({d}), i, 1)) END) % 10 = 0"
).format(d=_DIGITS)
_COMPACT = "replace(x.m, ' ', '')"
_MOD97 = (
    f"aggregate(split(concat(substr({_COMPACT}, 5), substr({_COMPACT}, 1, 4)), ''), 0, (s, c) -> CASE WHEN c = '' THEN s "
    "WHEN c BETWEEN '0' AND '9' THEN (s * 10 + ascii(c) - 48) % 97 ELSE (s * 100 + ascii(c) - 55) % 97 END) = 1"
)
VALID = {
    "email": "true",
    "ip": "NOT exists(split(x.m, '[.]'), y -> length(ltrim('0', y)) > 3 OR int(right(concat('000', y), 3)) > 255)",
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": _MOD97,
}
SPAN = "struct<kind:string,start:bigint,stop:bigint,found:string,score:double>"


def _spans(kind: str, found: str, gaps: str) -> Column:
    """The confirmed spans of a kind, from its matches and the texts between them."""
    start, stop = "a.p + length(x.g)", "a.p + length(x.g) + length(x.m)"
    score = f"{SCORE[kind]}D + CASE WHEN lower(right(x.g, {NEAR})) RLIKE r'{CONTEXT[kind]}' THEN 0.1D ELSE 0D END"
    span = f"named_struct('kind', '{kind}', 'start', {start}, 'stop', {stop}, 'found', x.m, 'score', {score})"
    return F.expr(
        f"aggregate(zip_with({found}, {gaps}, (m, g) -> named_struct('m', m, 'g', g)), named_struct('p', 0L, 'o', cast(array() AS array<{SPAN}>)), "
        f"(a, x) -> CASE WHEN x.m IS NULL THEN a ELSE named_struct('p', {stop}, "
        f"'o', CASE WHEN {VALID[kind]} THEN concat(a.o, array({span})) ELSE a.o END) END, a -> a.o)"
    )


def find(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with ``into``: an array of ``(kind, start, stop, found, score)`` by kind, then start.

    Null and empty texts: an empty array. A match that fails its check is dropped and not tried again.
    A column named ``into`` is replaced; other columns, repeated rows and empty tables pass through.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    parts = {}
    for kind, pattern in PATTERN.items():
        gate = body.rlike(GATE[kind])
        parts[f"__m_{kind}"] = F.when(gate, F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        parts[f"__g_{kind}"] = F.when(gate, F.split(body, pattern, -1)).otherwise(F.array().cast("array<string>"))
    wide = docs.drop(into).withColumns(parts)
    return wide.withColumn(into, F.concat(*[_spans(k, f"`__m_{k}`", f"`__g_{k}`") for k in PATTERN])).drop(*parts)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``find`` replaced by its kind in brackets; null texts stay null.

    Of spans that overlap, the first in the text names the replaced stretch and a later one that goes on
    further names the rest.
    """
    found = find(docs, text, "__pii").withColumn("__pii", F.array_sort(F.transform("__pii", lambda x: F.struct(x.start, x.stop, x.kind))))
    return found.withColumn(
        text,
        F.when(
            F.size("__pii") > 0,
            F.expr(
                "aggregate(__pii, named_struct('p', 0L, 'o', cast(array() AS array<string>)), (a, x) -> "
                "CASE WHEN x.stop <= a.p THEN a ELSE named_struct('p', x.stop, 'o', concat(a.o, array("
                f"substr(`{text}`, int(a.p) + 1, int(greatest(x.start - a.p, 0L))), concat('[', upper(x.kind), ']')))) END, "
                f"a -> concat(array_join(a.o, ''), substr(`{text}`, int(a.p) + 1)))"
            ),
        ).otherwise(F.col(text)),
    ).drop("__pii")


def spans_digest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: counts, digest and list of spans.

    ``n_*`` count spans by kind, ``base_sha256`` digests the base kinds' ``kind:start:stop`` joined by commas
    (of an empty string if there are none), ``spans`` lists all kinds, ``scores`` their scores in that order.
    """
    text = "transform(filter(pii, x -> x.kind {}), x -> concat_ws(':', x.kind, x.start, x.stop))"
    base = "IN ('" + "', '".join(BASE) + "')"
    return find(docs.select("doc_id", "text")).select(
        "doc_id",
        *[F.expr(f"bigint(size(filter(pii, x -> x.kind = '{k}')))").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.expr(text.format(base)), ","), 256).alias("base_sha256"),
        F.array_join(F.expr(text.format("IS NOT NULL")), ",").alias("spans"),
        F.expr("bigint(size(filter(pii, x -> x.kind = 'iban')))").alias("n_iban"),
        F.array_join(F.expr("transform(pii, x -> cast(cast(x.score AS decimal(3,1)) AS string))"), ",").alias("scores"),
    )


def _oracle() -> str:
    def digits(m: str) -> str:
        return f"regexp_replace({m}, '[^0-9]', '', 'g')"

    luhn = (
        "list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({d}), i, 1)::BIGINT "
        "ELSE (substr(reverse({d}), i, 1)::BIGINT * 2) // 10 + (substr(reverse({d}), i, 1)::BIGINT * 2) % 10 END)) % 10 = 0"
    ).format(d=digits("x.m"))
    compact = "replace(x.m, ' ', '')"
    mod97 = (
        f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr({compact}, 5) || substr({compact}, 1, 4), ''), "
        "lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c)::BIGINT - 48 ELSE ascii(c)::BIGINT - 55 END)), "
        "lambda s, v: CASE WHEN v < 10 THEN (s * 10 + v) % 97 ELSE (s * 100 + v) % 97 END) = 1"
    )
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(x.m, '.'), lambda y: coalesce(try_cast(y AS HUGEINT), 999) > 255)) = 0",
        "card": f"CASE WHEN length({digits('x.m')}) BETWEEN 13 AND 19 THEN {luhn} ELSE false END",
        "phone": f"length({digits('x.m')}) BETWEEN 9 AND 15",
        "iban": mod97,
    }
    plain = PLAIN | {"iban": IBAN}
    cut = ", ".join(f"regexp_extract_all(t, '{p}') AS m_{k}, string_split_regex(t, '{p}') AS g_{k}" for k, p in plain.items())
    spans = ", ".join(
        f"list_filter(list_transform(range(1, len(m_{k}) + 1), lambda i: {{'m': m_{k}[i], "
        f"'s': list_sum(list_transform(g_{k}[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m_{k}[1:i - 1], lambda y: length(y))), 0), "
        f"'c': right(g_{k}[i], {NEAR})}}), lambda x: {valid[k]}) AS s_{k}"
        for k in plain
    )
    text = {k: f"list_transform(s_{k}, lambda x: '{k}:' || x.s::BIGINT || ':' || (x.s + length(x.m))::BIGINT)" for k in plain}
    score = {
        k: f"list_transform(s_{k}, lambda x: CASE WHEN regexp_matches(lower(x.c), '{CONTEXT[k]}') THEN '{SCORE[k] + 0.1:.1f}' ELSE '{SCORE[k]:.1f}' END)"
        for k in plain
    }
    joined = "coalesce(array_to_string(flatten([{}]), ','), '')"
    base = joined.format(", ".join(text[k] for k in BASE))
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, {cut} FROM d), s AS (SELECT doc_id, {spans} FROM c) "
        f"SELECT doc_id, {', '.join(f'len(s_{k})::BIGINT AS n_{k}' for k in BASE)}, sha256({base}) AS base_sha256, "
        f"{joined.format(', '.join(text.values()))} AS spans, len(s_iban)::BIGINT AS n_iban, {joined.format(', '.join(score.values()))} AS scores FROM s"
    )


ORACLE = _oracle()
