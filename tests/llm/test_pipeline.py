import random

import corpus_pipeline as cp
from phrasemill.llm import decontaminate, language_id, ngram_join, pii

from test_ngram_join import _brute

BENCH = "a rather unusual question about seven green lamps hanging over the narrow street at night"


def test_stages_against_brute_force(spark, tmp_path):
    words = {"en": "the of and with that this from have", "de": "der die und nicht mit sich auf ein"}
    rows, rng = [], random.Random(4)
    for lang, ws in words.items():
        w = ws.split()
        for _ in range(40):
            rows.append((len(rows), " ".join(rng.choice(w) + rng.choice("xyzuvk") for _ in range(60)), lang, "s", 0))
    rows += [(200, rows[0][1], "en", "s", 0), (201, rows[1][1] + " more", "en", "s", 0), (202, "123 456", None, "s", 0), (203, None, None, None, None), (204, f"{rows[2][1][:200]} {BENCH} {rows[3][1][:200]}", "en", "s", 0), (205, f"mail a@b.co {rows[4][1][:150]}", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = {}
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        before, texts = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in kept.collect()}
        if name == "language_id":
            assert set(before) - set(texts) == {202, 203}
        if name == "ngram_jaccard_join":
            want = _brute(before.items(), cp.SHINGLE, cp.P, cp.Q)
            assert set(texts) == {i for i, (_, root) in want.items() if root == i} and not {200, 201} & set(texts)
        if name == "decontamination":
            assert set(before) - set(texts) == {204}
        if name == "pii":
            assert texts[205].startswith("mail [EMAIL] ") and all(texts[i] == before[i] for i in texts if i != 205)
        docs = kept
    last = {r.doc_id: r for r in cp.run(spark, str(tmp_path)).collect()}
    assert set(last) == set(texts) and all(r.lossless and r.n_pieces == len(r.pieces) > 0 for r in last.values())


def test_repeated_and_missing_ids(spark):
    """One row of each id stays, the same one in whatever order rows come; rows without an id stay."""
    text = "the of and with that this from have been there " * 4
    rows = [(1, "b " + text, "s"), (1, "a " + text, "s"), (1, None, "s"), (2, "quite another text about rivers", "s"), (2, "quite another text about rivers", "t"), (None, text, "s"), (None, text, "s"), (7, "z " + text, "s"), (9, None, "s")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string")
        kept = cp.keep_one_of_each_group(spark, docs, "")
        got = sorted(map(tuple, kept.collect()), key=str)
        assert got == sorted([(1, "a " + text, "s"), (2, "quite another text about rivers", "s"), (None, text, "s"), (None, text, "s"), (9, None, "s")], key=str)


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_operators_of_stages():
    assert [n for n, _ in cp.STAGES] == ["language_id", "ngram_jaccard_join", "decontamination", "pii", "sentencepiece"]
    assert language_id and ngram_join and decontaminate and pii
