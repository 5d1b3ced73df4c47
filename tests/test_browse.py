import base64
import os

import pytest
from pyspark.sql import functions as F

from phrasemill.functions import model_tokens
from phrasemill.operators import browse

FILES = "/opt/tokenizers"


def test_class_filter():
    assert browse.class_filter(None) is None and browse.class_filter("UMRP") is None
    assert browse.class_filter(["U", "P", "x"]) == ["P", "U"] and browse.class_filter([]) == []


def test_natural_order(spark):
    names = ["num_beams=10", "num_beams=4", "Num_beams=1", "top_k", "10", "9", "a", "", "num_beams=4b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(browse.natural_key("n"), "n").collect()] == ["", "9", "10", "a", "Num_beams=1", "num_beams=4", "num_beams=4b", "num_beams=10", "top_k"]
    values = spark.createDataFrame([(v,) for v in ['"b2"', "true", "10", "2.5", '"b10"', "-1", "false"]], "v string")
    assert [r.v for r in values.orderBy(*browse.value_rank("v")).collect()] == ["-1", "2.5", "10", "false", "true", '"b2"', '"b10"']


def test_choices(spark):
    sets = spark.createDataFrame([("d", "author"), ("d", "@combined"), ("e", "reader"), ("e", "author")], "dataset string, ann_key string")
    assert {r.dataset: r.ann_key for r in browse.chosen_annotations(sets).collect()} == {"d": "@combined", "e": "author"}
    assert [r.dataset for r in browse.chosen_annotations(sets, "reader").collect()] == ["e"]
    runs = spark.createDataFrame([("m", "a", "1"), ("m", "a", "2")], "model string, arch string, run_id string")
    assert browse.effective_runs(runs, runs.where("run_id = '2'")).count() == 1
    assert browse.effective_runs(runs, runs.where("run_id = '9'")).count() == 2


def test_labels(spark):
    key = ("d", "m", "a", "r", 1)
    preds = spark.createDataFrame([(*key, ["Nets", "x", "net", "..."], ["net", "x", "net", ""])], "dataset string, model string, arch string, run_id string, doc_id int, phrases array<string>, stems array<string>")
    matches = spark.createDataFrame([(*key, "author", [(0, 3)])], "dataset string, model string, arch string, run_id string, doc_id int, ann_key string, hits array<struct<rank:int,gold:int>>")
    got = sorted((r.place, r.phrase, r["rank"], r.gold, r.label) for r in browse.explained(preds, matches).collect())
    assert got == [(0, "Nets", 0, 3, "hit"), (1, "x", 1, None, "miss"), (2, "net", None, None, "duplicate"), (3, "...", None, None, "empty")]


def test_quality_and_cost(spark):
    scores = spark.createDataFrame([("d", m, "a", m, v) for m, v in (("x", 0.5), ("y", 0.7), ("z", 0.6), ("w", 0.9))], "dataset string, model string, arch string, run_id string, f1 double")
    costs = spark.createDataFrame([("d", "x", "a", "x", "usd", 1.0, True, True), ("d", "y", "a", "y", "usd", 2.0, True, False), ("d", "z", "a", "z", "usd", 3.0, True, True), ("d", "w", "a", "w", "usd", None, False, False)], "dataset string, model string, arch string, run_id string, unit string, per_doc double, known boolean, complete boolean")
    got = {r.model: (r.cost, r.provisional, r.on_front) for r in browse.quality_and_cost(scores, costs).collect()}
    assert got == {"x": (1.0, False, True), "y": (2.0, True, True), "z": (3.0, False, False), "w": (None, True, False)}


def test_specifications(spark):
    df = spark.createDataFrame([("transformers[a/b]",), (" tiktoken [ x ] ",), ("plain",)], "s string")
    assert [tuple(r) for r in df.select(model_tokens.backend("s"), model_tokens.inner("s")).collect()] == [("transformers", "a/b"), ("tiktoken", "x"), (None, None)]
    row = spark.createDataFrame([(10, [0, 5])], "n int, w array<int>").select(model_tokens.approximate("tiktoken", F.col("n"), F.col("w")).alias("t")).first().t
    assert (row.n_tokens, row.positions) == (12, [0, 6])


@pytest.mark.skipif(not os.path.isdir(FILES), reason="needs tokenizer files")
@pytest.mark.parametrize(("kind", "name"), [("transformers", "byte_bpe_50k.json"), ("tiktoken", "byte_bpe_50k.tiktoken"), ("transformers", "word_bpe_49k.json")])
def test_exact_tokens(spark, kind, name):
    with open(f"{FILES}/{name}", "rb") as f:
        data = f.read()
    texts = ["Neural networks for keyphrase extraction.", "", None, "réseaux de neurones 神经网络", "x" * 5000]
    df = spark.createDataFrame([(i, t, list(range(0, len(t or "") + 1, 3))) for i, t in enumerate(texts)], "i int, t string, o array<int>")
    got = {r.i: r.c for r in df.select("i", model_tokens.exact(kind, data, "t", "o").alias("c")).collect()}
    assert got[1].n_tokens == got[2].n_tokens and got[0].n_tokens >= 5
    if kind == "tiktoken":
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        encoding = tiktoken.Encoding("t", pat_str=model_tokens.PIECES, mergeable_ranks=ranks, special_tokens={})
        for i in (0, 3):
            ids = encoding.encode_ordinary(texts[i])
            ends = [len(encoding.decode_bytes(ids[: k + 1])) for k in range(len(ids))]
            want = [next(k for k, e in enumerate(ends, 1) if e >= len(texts[i][:o].encode())) for o in range(0, len(texts[i]) + 1, 3)]
            assert (got[i].n_tokens, got[i].positions) == (len(ids), want)
    for c in got.values():
        assert c.positions == sorted(c.positions) and all(0 <= p <= max(c.n_tokens, 0) for p in c.positions)
