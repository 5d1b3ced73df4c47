import pathlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phrasemill.llm import pieces

TEXTS = ["a", "hello  world\n\n x", "▁ own ▁▁ mark", "ünïcödé 漢字🙂 \t tab", "   ", "\n", " " * 50 + "z", "x" * 3000, "<s></s><0x41>", "￾\x00Ā"]


def _sampled(texts, keys=None):
    lexicon = pieces.lexicon_of(pathlib.Path(pieces.MODEL).read_bytes(), 1.0)
    ids, per = pieces.sample(texts, np.arange(len(texts)) if keys is None else keys, lexicon)
    ends = np.cumsum(per)
    return [ids[e - n : e] for e, n in zip(ends, per, strict=True)], lexicon.pieces


def test_lossless():
    got, known = _sampled(TEXTS)
    assert [pieces.spell(g, known) for g in got] == TEXTS


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), min_size=1, max_size=30), min_size=1, max_size=5))
def test_lossless_anything(texts):
    got, known = _sampled(texts)
    assert [pieces.spell(g, known) for g in got] == texts


def test_sampling_follows_the_posterior():
    n = 20_000
    got, known = _sampled(["hello"] * n)
    word, seen = "▁hello", Counter(tuple(g.tolist()) for g in got)

    def paths(end):
        if end == 0:
            return [((), 0.0)]
        steps = [(s, (known.ids[word[s:end]],)) for s in range(end) if word[s:end] in known.ids]
        steps.append((end - 1, tuple(known.bytes_[b] for b in (" " if word[end - 1] == "▁" else word[end - 1]).encode())))
        return [(p + i, w + sum(known.log[k] for k in i)) for s, i in steps for p, w in paths(s)]

    every = paths(len(word))
    total = sum(np.exp(w) for _, w in every)
    for p, w in every:
        share = np.exp(w) / total
        assert abs(seen[p] / n - share) < 5 * np.sqrt(share / n) + 1e-3


def test_rows_do_not_depend_on_their_batch():
    alone = [_sampled([t], np.array([k]))[0][0].tolist() for k, t in enumerate(TEXTS)]
    assert [g.tolist() for g in _sampled(TEXTS)[0]] == alone


def test_frames(spark):
    rows = [(i, t, "old") for i, t in enumerate(TEXTS)] + [(90, None, "n"), (91, "", "n"), (None, "no key", "n"), (0, TEXTS[0], "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pieces string")
    got = pieces.segmented(df).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got if r.doc_id != 90)
    null = next(r for r in got if r.doc_id == 90)
    assert null.pieces is None and null.lossless is None
    assert len({tuple(r.pieces) for r in got if r.doc_id == 0}) == 1
    back = pieces.decode(pieces.encode(df)).collect()
    assert all(r.decoded == r.text for r in back)
    assert pieces.segmented(df.where("false")).count() == 0


def test_very_long_text_without_spaces(spark):
    text = "漢字かな" * 15_000
    row = pieces.segmented(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.lossless and 0 < row.n_pieces <= 4 * len(text)


def test_missing_models_are_refused(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        pieces.encode(spark.createDataFrame([(1, "x")], "doc_id long, text string"), model=str(tmp_path / "none.model"))
