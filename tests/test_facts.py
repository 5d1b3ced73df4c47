import json
import random

import pytest

from phrasemill.operators import facts
from phrasemill.sources import cards, jsonl, tree
from phrasemill.streaming import incremental

RUN = ("d", "m", "a", "r")
S = "dataset string, model string, arch string, run_id string"


def test_timestamps(spark):
    rows = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024/01/02 03:04:05", "soon", None]
    got = [r.t and r.t.isoformat() for r in spark.createDataFrame([(r,) for r in rows], "t string").select(facts.timestamp("t").alias("t")).collect()]
    assert got == ["2024-01-02T03:04:05", "2024-01-02T01:04:05", "2024-01-02T03:04:05", None, None]


def test_complete_level_wins(spark):
    doc = spark.createDataFrame([("r", "time", 2.0, 1), ("r", "tok", 9.0, 10), ("r", "odd", 1.0, 5)], "run_id string, variable string, total double, n long")
    batch = spark.createDataFrame([("r", "time", 20.0, 2), ("r", "odd", 4.0, 1)], "run_id string, variable string, total double, n long")
    counts = spark.createDataFrame([("r", 10, 2)], "run_id string, n_docs long, n_batches long")
    declared = spark.createDataFrame([("time", "document"), ("tok", "document"), ("odd", "document")], "variable string, level string")
    got = {r.variable: (r.total, r.level, r.level_fallback, r.partial) for r in facts.resolved_totals(doc, batch, counts, declared).collect()}
    assert got == {"time": (20.0, "batch", True, False), "tok": (9.0, "document", False, False), "odd": (1.0, "document", False, True)}


def test_missing_variable_is_unknown_not_zero(spark):
    totals = spark.createDataFrame([("r", "a", "time", 4.0, False)], "run_id string, arch string, variable string, total double, partial boolean")
    rates = spark.createDataFrame([("a", "usd", "time", 2.0), ("a", "usd", "gpu", 0.0), ("a", "co2", "gpu", 1.0)], "arch string, unit string, variable string, rate double")
    runs = spark.createDataFrame([("r", "a", 8)], "run_id string, arch string, n_docs long")
    got = {r.unit: (r.total, r.per_doc, r.known) for r in facts.priced(totals, rates, runs).collect()}
    assert got == {"usd": (8.0, 1.0, True), "co2": (None, None, False)}


def test_parameters(spark):
    card = {"inference": {"k": {"type": "int", "min": 1, "max": 9, "default": 3}, "t": {"type": "float", "max": 1.0}, "m": {"type": "str", "values": ["x", "y"]}, "odd": {"type": "blob", "default": 1}, "s": {"type": "set", "values": ["p", "q"]}}}
    specs = cards.parameter_specs(spark, {"m": card})
    runs = spark.createDataFrame([("m", "r1", {"k": "12", "t": "0.5", "m": '"x"', "s": '["p","z"]'}), ("m", "r2", {"k": "true", "new": "1"}), ("m", "r3", {})], "model string, run_id string, params map<string,string>")
    got = {(r.run_id, r.param): (r.source, r.problem) for r in facts.resolved_parameters(runs, specs).collect()}
    assert got["r1", "k"] == ("given", "max") and got["r1", "t"] == ("given", None) and got["r1", "m"] == ("given", None) and got["r1", "s"] == ("given", "value")
    assert got["r2", "k"] == ("given", "type") and got["r2", "new"] == ("given", "undeclared") and got["r2", "odd"] == ("default", "unknown type")
    assert got["r3", "k"] == ("default", None) and got["r3", "t"] == ("missing", None)


def test_majority_split_and_ids(spark):
    docs = spark.createDataFrame([("d", i, s) for i, s in enumerate(["test"] * 4 + ["valid"] * 2 + ["train"])], "dataset string, doc_id int, split string")
    preds = spark.createDataFrame([(*RUN, i) for i in (0, 1, 2, 4, 6, 99)], f"{S}, doc_id int")
    r = facts.majority_split(preds, docs).first()
    assert (r.split, r.covered, r.expected, r.n_splits) == ("test", 3, 4, 2)
    ids = facts.id_counts(preds, docs, preds.where("doc_id < 2")).first()
    assert (ids.n_docs, ids.n_unknown, ids.n_unscored) == (6, 1, 3)


def test_names(spark):
    known = spark.createDataFrame([("vllm-gpu", ["VLLM GPU"]), ("api", None)], "card string, aliases array<string>")
    tokens = spark.createDataFrame([("vllm_gpu",), ("api",), ("n/a",), ("other",)], "token string")
    assert {r.token: r.card for r in facts.resolved_names(tokens, known).collect()} == {"vllm_gpu": "vllm-gpu", "api": "api", "n/a": None, "other": None}


def test_card_comments():
    assert cards.parsed('﻿{"a": "x // no", /* b\n */ "c": 1} // end') == {"a": "x // no", "c": 1}
    ok, wrong = cards.read_cards([("p", b'{"a": 1}'), ("q", b"{"), ("r", b"[1]")])
    assert list(ok) == ["p"] and set(wrong) == {"q", "r"}
    assert cards.window_limit({"inference": {"w": {"type": "context_window", "default": 512, "reserved_tokens": 12}}}, {}) == 500


@pytest.mark.parametrize("size", [7, 16, 1000])
def test_offset_lines(spark, tmp_path, size):
    lines = [json.dumps({"_id": str(i), "inferences": ["é" * i]}, ensure_ascii=False) for i in range(9)] + ["{broken"]
    path = tmp_path / "batch_1.jsonl"
    path.write_text("\n".join(lines) + "\n\n")
    rows = sorted(jsonl.offset_lines(spark, [str(path)], size).collect(), key=lambda r: r.byte_off)
    data = path.read_bytes()
    assert [r.value for r in rows] == lines
    assert all(data[r.byte_off : r.byte_off + r.byte_len].decode().rstrip("\n") == r.value for r in rows)
    parsed = jsonl.parsed(jsonl.offset_lines(spark, [str(path)], size), jsonl.PREDICTION)
    assert parsed.where("bad").count() == 1 and {r[0] for r in parsed.where("NOT bad").select("obj._id").collect()} == {str(i) for i in range(9)}


def test_similarity_pairs(spark):
    rows = [json.dumps({"dataset_a": "x", "doc_id_a": "1", "dataset_b": "y", "doc_id_b": "2", "score": 0.5}), json.dumps({"dataset_A": "x", "doc_id_A": "1", "dataset_B": "y", "doc_id_B": "3", "score": 1, "label": "near"}), "{}"]
    got = jsonl.similarity_pairs(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert [(r.doc_id_b, r.score, r.label) for r in got] == [("2", 0.5, None), ("3", 1.0, "near")]


def test_incremental(spark, tmp_path):
    root = tmp_path / "tree"
    run = root / "inferences" / "ds" / "m" / "a" / "r"
    run.mkdir(parents=True)
    (root / "documents").mkdir()
    (run / "batch_1.jsonl").write_text("{}\n")
    (run / "run_r.json").write_text("{}")
    (root / "documents" / "document.ds.jsonl").write_text("{}\n")
    (root / "notes.txt").write_text("x")
    tree.discovered(spark, str(root)).write.parquet(str(tmp_path / "manifest"))
    first = spark.read.parquet(str(tmp_path / "manifest"))
    assert {(r.kind, r.dataset, r.run_id, r.batch_idx) for r in first.collect()} == {("batch", "ds", "r", 1), ("run_card", "ds", "r", None), ("collection", "ds", None, None)}
    sig = incremental.signatures(first, ["dataset"], "code 1")
    assert incremental.stale(sig, incremental.signatures(tree.discovered(spark, str(root)), ["dataset"], "code 1"), ["dataset"]).isEmpty()
    (run / "batch_1.jsonl").write_text("{} \n")
    second = tree.discovered(spark, str(root))
    assert [r.change for r in tree.changes(first, second).collect()] == ["changed"]
    assert incremental.stale(sig, incremental.signatures(second, ["dataset"], "code 1"), ["dataset"]).count() == 1
    versions = incremental.Versions(spark, str(tmp_path / "store"))
    path = versions.begin()
    with pytest.raises(RuntimeError):
        versions.publish(path, ["t"])
    assert versions.current() is None and versions.incomplete() == [path]
    first.write.parquet(f"{path}/t")
    versions.publish(path, ["t"])
    assert versions.current() == path and versions.begin() != path and versions.current() == path
    ids = tree.registered(spark.createDataFrame([], "path string, file_id long"), first)
    more = tree.registered(ids, spark.createDataFrame([("file:///a/b",), ("file:///a/a",)], "path string").unionByName(first.select("path")))
    assert sorted(r.file_id for r in ids.collect()) == [1, 2, 3]
    assert {r.path: r.file_id for r in more.where("file_id > 3").collect()} == {"file:///a/a": 4, "file:///a/b": 5}


def _curve(lengths, scores):
    """Bins of equal counts whose edges are lengths, one after the other."""
    rows = sorted(zip(lengths, scores, strict=True))
    xs, n = [x for x, _ in rows], len(rows)
    bins = min(8, max(3, n // 12))
    starts = {0}
    for b in range(1, bins):
        starts.add(xs.index(xs[min(round(b * n / bins), n - 1)]))
    cuts = [*sorted(starts), n]
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    if len(parts) > 1 and len(parts[-1]) < max(2, n / bins // 2):
        parts[-2:] = [parts[-2] + parts[-1]]
    return [(i, len(p), p[0][0], p[-1][0], pytest.approx(sum(v for _, v in p) / len(p))) for i, p in enumerate(parts)]


@pytest.mark.parametrize("seed", range(6))
def test_length_curve(spark, seed):
    rng = random.Random(seed)
    groups = {g: [(rng.choice([3, 5, 5, 5, 7, 20, 21, 30]) if rng.random() < 0.7 else rng.randint(1, 200), rng.random()) for _ in range(rng.choice([1, 5, 40, 130]))] for g in "ab"}
    df = spark.createDataFrame([(g, x, v) for g, rows in groups.items() for x, v in rows], "g string, x int, v double")
    got = sorted(map(tuple, facts.length_curve(df, "x", "v", ["g"]).collect()))
    assert got == [(g, *r) for g, rows in sorted(groups.items()) for r in _curve(*zip(*rows))]


def test_division(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b"), (3, "a"), (3, "c"), (4, None)], "k int, v string")
    assert {r.k for r in facts.on_every(df, ["k"], "v").collect()} == {3}
    assert {r.k for r in facts.on_every(df, ["k"], "v", spark.createDataFrame([("a",), ("b",), ("a",)], "v string")).collect()} == {1, 3}
