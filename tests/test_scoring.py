import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phrasemill.operators import matching, scoring

KEYS = ("d", "m", "a", "r")


def _matches(spark, rows):
    out = [(*KEYS, doc, "author", n_uniq, n_gold, hits) for doc, n_uniq, n_gold, hits in rows]
    return spark.createDataFrame(out, f"dataset string, model string, arch string, run_id string, doc_id long, ann_key string, n_uniq int, n_gold int, hits {matching.HITS}")


def test_scores_by_hand(spark):
    m = _matches(spark, [(1, 4, 5, [(0, 0), (1, 2)]), (2, 0, 2, []), (3, 7, 1, [(6, 0)]), (4, 3, 0, [])])
    got = {(r.doc_id, r.k): (r.p, r.r) for r in scoring.per_document(m).collect()}
    assert got[1, "M"] == (0.5, 0.4) and got[1, "5"] == (0.5, 0.4) and got[1, "O"] == (0.5, 0.4)
    assert got[2, "10"] == (0.0, 0.0)
    assert got[3, "5"] == (0.0, 0.0) and got[3, "O"] == (0.0, 0.0) and got[3, "M"] == (pytest.approx(1 / 7), 1.0)
    assert not any(doc == 4 for doc, _ in got)


def test_filters(spark):
    m = _matches(spark, [(1, 4, 3, [(0, 0), (1, 2)]), (2, 4, 3, [(0, 1)])])
    gold = spark.createDataFrame([("d", doc, "author", i, c, e) for doc in (1, 2) for i, c, e in ((0, "P", 3), (1, None, -1), (2, "R", None))], "dataset string, doc_id long, ann_key string, kp_idx int, prmu string, end_char int")
    got = {r.doc_id: (r.n_al, r.tp) for r in scoring.per_document(m, ["5"], allowed=scoring.allowed_gold(gold, ["P", "U"])).collect()}
    assert got == {1: (2, 1.0), 2: (2, 1.0)}
    assert scoring.skipped(m, scoring.allowed_gold(gold, ["M"])).first().n_skipped == 2
    none = gold.where("false").select("dataset", "doc_id")
    assert scoring.per_document(m, ["5"], include=none).isEmpty()
    assert scoring.per_document(m, ["5"], exclude=none).count() == 2
    positions = gold.where("kp_idx = 0").selectExpr("dataset", "doc_id", "ann_key", "kp_idx", "doc_id * 10 AS tok_end")
    got = scoring.per_document(m, ["5"], allowed=scoring.allowed_gold(gold, positions=positions, token_limit=10)).collect()
    assert [(r.doc_id, r.n_al) for r in got] == [(1, 1)]
    assert {r.doc_id for r in scoring.per_document(m, ["5"], allowed=scoring.allowed_gold(gold, require_position=True)).collect()} == {1, 2}


@pytest.mark.parametrize(("split", "want"), [(None, True), ("", True), ("test", True), ("Train", False), (" training_large ", False), ("train-2", False), ("trainer", True), ("validation", True)])
def test_eval_split(spark, split, want):
    assert spark.createDataFrame([(split,)], "s string").select(scoring.is_eval_split("s").alias("e")).first().e is want


def test_matching(spark):
    preds = spark.createDataFrame([(*KEYS, 1, ["b", "", "a", "b", "x"]), (*KEYS, 2, ["a", "b"]), (*KEYS, 9, ["a"])], "dataset string, model string, arch string, run_id string, doc_id long, stems array<string>")
    gold = spark.createDataFrame([("d", 1, "author", [["a"], ["b", "c"]]), ("d", 2, "author", [["a", "b"], ["a"]])], "dataset string, doc_id long, ann_key string, stems array<array<string>>")
    got = {r.doc_id: (r.n_uniq, r.n_gold, [tuple(h) for h in r.hits]) for r in matching.match(preds, gold).collect()}
    assert got == {1: (3, 2, [(0, 1), (1, 0)]), 2: (2, 2, [(0, 1), (1, 0)])}


def test_overlapping_variants_go_depth_first():
    """A rank takes the first phrase in the gold's order; the holder of a taken one looks for another."""
    assert matching.maximum_matching(["a", "b"], [["a", "b"], ["b"], ["a"]]) == [(0, 2), (1, 0)]
    assert matching.maximum_matching(["a", "b"], [["a", "b"], ["a"]]) == [(0, 1), (1, 0)]
    chain = [[f"s{i}", f"s{i + 1}"] for i in range(3000)]
    assert len(matching.maximum_matching([f"s{i}" for i in range(1, 3001)] + ["s0"], chain)) == 3000


def test_filters_on_own_gold(spark):
    m = _matches(spark, [(1, 4, 3, [(0, 0), (1, 2)]), (2, 4, 3, [(0, 1)])])
    own = "transform(array(named_struct('prmu', 'P', 'end_char', 3, 'tok_end', 10 * doc_id), named_struct('prmu', null, 'end_char', -1, 'tok_end', null), named_struct('prmu', 'R', 'end_char', null, 'tok_end', null)), x -> x)"
    m = m.withColumn("of", F.expr(own))
    for options, want in (({"classes": ["P", "U"]}, {1: (2, 1.0), 2: (2, 1.0)}), ({"token_limit": 10}, {1: (1, 1.0)}), ({"require_position": True}, {1: (1, 1.0), 2: (1, 0.0)}), ({"classes": []}, {})):
        got = {r.doc_id: (r.n_al, r.tp) for r in scoring.per_document(m, ["5"], allowed=scoring.allowed_of("of", **options)).collect()}
        assert got == want
    assert scoring.skipped(m, scoring.allowed_of("of", ["M"])).first().n_skipped == 2


def _largest(preds, gold, taken=frozenset(), i=0):
    if i == len(preds):
        return 0
    best = _largest(preds, gold, taken, i + 1)
    for g, v in enumerate(gold):
        if g not in taken and preds[i] in v:
            best = max(best, 1 + _largest(preds, gold, taken | {g}, i + 1))
    return best


@given(st.lists(st.sampled_from("abcde"), unique=True, max_size=5), st.lists(st.sets(st.sampled_from("abcde"), min_size=1, max_size=3), max_size=4))
def test_matching_is_maximum(preds, gold):
    got = matching.maximum_matching(preds, [sorted(v) for v in gold])
    assert len(got) == _largest(preds, gold)
    assert all(preds[r] in gold[g] for r, g in got) and len({g for _, g in got}) == len(got)


def test_multilingual_hits():
    ranked = [{"en": "net", "fr": "net"}, {"en": "reseau", "fr": "réseau"}]
    assert matching.multilingual_hits(ranked, [("fr", ["réseau"]), ("en", ["net"])]) == [(0, 1), (1, 0)]
