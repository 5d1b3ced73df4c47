"""Cards: small JSON objects with comments, read on the driver and turned into tables to broadcast."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: A string, a line comment or a block comment, whichever comes first.
_PIECE = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)


def without_comments(text: str) -> str:
    """Comments blanked out, so that lines and columns of errors stay right; a byte order mark goes."""
    return _PIECE.sub(lambda m: m[0] if m[0][0] == '"' else re.sub(r"[^\n]", " ", m[0]), text.removeprefix("\ufeff"))


def parsed(text: str) -> Any:
    return json.loads(without_comments(text))


def read_cards(files: Iterable[tuple[str, bytes]]) -> tuple[dict[str, dict], dict[str, str]]:
    """Cards by path, and what is wrong with the files that hold none."""
    cards, wrong = {}, {}
    for path, data in files:
        try:
            card = parsed(data.decode("utf-8"))
            if isinstance(card, dict):
                cards[path] = card
            else:
                wrong[path] = "not an object"
        except (UnicodeDecodeError, json.JSONDecodeError) as error:
            wrong[path] = str(error)
    return cards, wrong


def declared_languages(part: dict) -> list[str]:
    """``languages`` or ``language`` of an object, one or several; empty ones are left out."""
    value = part.get("languages") or part.get("language") or []
    return [v for v in ([value] if isinstance(value, str) else value) if v]


def parameter_specs(spark: SparkSession, cards: dict[str, dict]) -> DataFrame:
    """``model, param, type, allowed, lo, hi, fallback`` of all model cards; values as JSON."""
    rows = [
        (model, name, spec.get("type"), [json.dumps(v) if not isinstance(v, str) or spec.get("type") != "set" else v for v in spec["values"]] if spec.get("values") else None,
         _number(spec.get("min")), _number(spec.get("max")), None if spec.get("default") is None else json.dumps(spec["default"]))
        for model, card in cards.items() for name, spec in (card.get("inference") or {}).items() if isinstance(spec, dict)
    ]
    return spark.createDataFrame(rows, "model string, param string, type string, allowed array<string>, lo double, hi double, fallback string")


def architecture_rates(spark: SparkSession, cards: dict[str, dict]) -> DataFrame:
    """``arch, unit, variable, rate`` of all architecture cards."""
    rows = [(a, unit, v, float(r)) for a, card in cards.items() for unit, rates in (card.get("rates") or {}).items() for v, r in (rates or {}).items() if _number(r) is not None]
    return spark.createDataFrame(rows, "arch string, unit string, variable string, rate double")


def architecture_variables(spark: SparkSession, cards: dict[str, dict]) -> DataFrame:
    """``arch, variable, unit, level, tokenizer`` of all architecture cards."""
    rows = [(a, v, s.get("unit"), s.get("level"), s.get("tokenizer")) for a, card in cards.items() for v, s in (card.get("variables") or {}).items() if isinstance(s, dict)]
    return spark.createDataFrame(rows, "arch string, variable string, unit string, level string, tokenizer string")


def cost_formula(rates: dict[str, float], unit: str) -> str:
    terms = [f"{rate:g}·{name}" for name, rate in rates.items() if rate]
    return f"{unit} = {' + '.join(terms) or '0'}"


def window_limit(card: dict, params: dict) -> int | None:
    """The context window of a run less its reserved tokens; the card's default stands in; None if unknown."""
    limits = [
        (params.get(name, spec.get("default")), spec.get("reserved_tokens") or 0)
        for name, spec in (card.get("inference") or {}).items() if isinstance(spec, dict) and spec.get("type") == "context_window"
    ]
    known = [int(v) - int(r) for v, r in limits if _number(v) is not None]
    return min(known) if known else None


def _number(value: Any) -> float | None:
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None
