import zlib

import numpy as np
import pytest

from phrasemill.llm import language_id as li

WORDS = {"en": "the of and with that this from have", "de": "der die und nicht mit sich auf ein", "fr": "le les des une dans que pour est", "es": "el los una que para con por como"}


def _rows():
    rows, n = [], 0
    for lang, ws in WORDS.items():
        w = ws.split()
        for k in range(60):
            rows.append((n, " ".join(w[(k * j + j) % len(w)] for j in range(1, 12)), lang))
            n += 1
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = _rows()
    more = [(9000, None, "en"), (9001, "", "de"), (9002, "123 $$ 4", "fr"), (9003, "the and of " * 50_000, None), (None, "der die und nicht", "de")]
    df = spark.createDataFrame([(*r, "s", 0.0) for r in rows + more], "doc_id long, text string, lang string, lang_pred string, score double")
    got = {r.doc_id: r for r in li.identify(df).collect()}
    assert len(got) == len(rows) + len(more)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 20 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3
    assert got[9003].lang_pred == "en" and got[None].lang_pred == "de" and got[None].held_out is False


def test_no_labels_and_one_label(spark):
    none = spark.createDataFrame([(1, "text here", None)], "doc_id long, text string, lang string")
    assert li.identify(none).first().lang_pred == "und"
    one = spark.createDataFrame([(i, "text here", "en") for i in range(20)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in li.identify(one).collect()} == {"en"}
    assert li.identify(one.where("false")).count() == 0


def test_sample_and_languages_are_bounded(spark):
    rows = _rows() + [(5000 + i, "qq ww ee rr", "xx") for i in range(5)]
    df = spark.createDataFrame([*rows, *rows[:7], *rows[:7]], "doc_id long, text string, lang string")
    model = li.fit(df, 20, 4)  # the rarest label isn't learned
    assert sorted(g for members in model.families.values() for g in members) == ["de", "en", "es", "fr"]
    again = li.fit(df.repartition(3), 20, 4)
    assert all((a[0] == b[0]).all() for a, b in zip(model.pair_svm.values(), again.pair_svm.values(), strict=True))
    got = li.predict(df.select("doc_id", "text"), model).distinct().collect()  # repeated rows are predicted alike
    assert len(got) == len(rows)


def test_ties_go_to_the_later_name():
    model = li.LanguageModel({"germanic": ["de", "en"]}, {}, {("de", "en"): (np.zeros(li.DIM, np.float32), 0.0, 1.0)})
    lang, score = model.predict(["same same", "1 2"])
    assert lang == ["de", "und"] and score.tolist() == [0.5, 0.0]


def test_families():
    assert li.family_of("de") == li.family_of("en") == "germanic" and li.family_of("xx") == "only xx"


@pytest.mark.parametrize("texts", [["a"], ["ab cd", "", "é"], ["  ", "x" * 1000]])
def test_grams_belong_to_their_text(texts):
    grams, doc, letters = li._grams(texts)
    assert letters.tolist() == [sum(c.isalpha() for c in t.lower()) for t in texts]
    assert len(grams) == len(doc) == 2 * letters.sum()
