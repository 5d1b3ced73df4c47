import pytest
from pyspark.sql import functions as F

from phrasemill.functions import text
from phrasemill.functions.stem import has_stemmer, stem, stemmed


@pytest.mark.parametrize(
    ("word", "want"),
    [("consignment", "consign"), ("consolatory", "consolatori"), ("knackeries", "knackeri"), ("generously", "generous"), ("hopping", "hop"), ("hoping", "hope"), ("skies", "sky"), ("ties", "tie"), ("flies", "fli"),
     ("happy", "happi"), ("relational", "relat"), ("kindness", "kind"), ("agreed", "agre"), ("bled", "bled"), ("networks", "network"), ("neural", "neural"), ("extraction", "extract"), ("this", "this"), ("gas", "gas")],
)
def test_stems(word, want):
    assert stem(word) == want


def test_stemmed_keeps_order_and_other_languages(spark):
    df = spark.createDataFrame([(1, ["networks", "hoping", "networks"], "en"), (2, ["réseaux"], "fr"), (3, [], "en"), (4, None, "en"), (5, ["hopes"], None), (5, ["hoping"], None)], "id int, t array<string>, lang string")
    got = sorted((r.id, r.s, r.own) for r in df.select("id", stemmed("t", F.col("lang")).alias("s"), has_stemmer("lang").alias("own")).collect())
    assert got == [(1, ["network", "hope", "network"], True), (2, ["réseaux"], False), (3, [], True), (4, None, True), (5, ["hope"], True), (5, ["hope"], True)]


def test_normalisation(spark):
    df = spark.createDataFrame([(1, "d\x92Analyse  ﬁn\x00"), (2, "ABC\x07d"), (3, None)], "id int, t string")
    got = {r.id: r.n for r in df.select("id", text.normalised("t").alias("n")).collect()}
    assert got == {1: "d’analyse  fin ", 2: "abc d", 3: ""}


@pytest.mark.parametrize(("phrase", "want"), [("a+b", ["a", "b"]), ("C++", ["C++"]), ("A+ grade", ["A+ grade"]), ("x + y", ["x + y"]), ("graph+graphs+net", ["graph", "graphs", "net"]), (None, [""])])
def test_variants(spark, phrase, want):
    assert spark.createDataFrame([(phrase,)], "p string").select(text.variants("p").alias("v")).first().v == want


@pytest.mark.parametrize(("t", "want"), [("a, b", ["a", "\x01", "b"]), ("e-commerce and/or", ["e", "commerce", "and", "or"]), ("end.", ["end", "\x01"]), ("u.s. army", ["u", "s", "\x01", "army"])])
def test_sentinels(spark, t, want):
    assert text.token_list(t) == want
    assert spark.createDataFrame([(t,)], "t string").select(text.tokens_with_sentinels("t").alias("v")).first().v == want


def test_general_tokens():
    assert text.token_list("神经网络 net") == [*"神经网络", "net"]
    assert text.token_list("कि") == ["कि"]
    assert text.token_spans("a, bc") == [("a", 1), ("\x01", 2), ("bc", 5)]


def test_tokens_of_all_planes():
    assert text.token_list("a\U000101fdb") == ["a\U000101fdb"]  # a combining mark beyond the first plane
    assert text.token_list("snake_case, x_") == ["snake", "case", "\x01", "x"]
    assert text.token_list("網，路 a\x01b") == ["網", "\x01", "路", "a", "\x01", "b"]
    assert text.token_list("") == [] and text.token_list("...") == ["\x01"]


def test_offsets_map_back():
    normal, at = text.normal_offsets("ﬁn été")
    assert normal == "fin été"
    assert at[0] == at[1] == 0 and at[-1] == len("ﬁn été")


DOC = "graph base rank of candid keyphras \x01 we studi neural network for extract".split()


@pytest.mark.parametrize(
    ("alternatives", "want"),
    [([["neural", "network"]], ("P", 9)), ([["network", "neural"]], ("R", -1)), ([["graph", "mine"]], ("M", -1)), ([["deep", "learn"]], ("U", -1)), ([["keyphras", "we"]], ("R", -1)), ([["deep"], ["graph", "base"]], ("P", 1)), ([["rank"], ["graph"]], ("P", 0)), ([], ("U", -1))],
)
def test_prmu(spark, alternatives, want):
    df = spark.createDataFrame([(DOC, alternatives)], "s array<string>, a array<array<string>>")
    got = df.withColumn("pad", text.padded("s")).select(text.prmu("a", "pad").alias("c")).first().c
    assert (got["class"], got.end_word) == want


def test_language_vote(spark):
    rows = [(1, "the of and to in word".split()), (2, "le la les des du mot".split()), (3, ["zzz"] * 20), (4, [])]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    shares = text.stop_word_shares(df, ["id"], "t")
    best, _ = text.language_vote("shares")
    assert {r.id: r.v for r in shares.select("id", best.alias("v")).collect()} == {1: "en", 2: "fr", 3: None, 4: None}
    got = {r.id: r.shares for r in shares.collect()}
    assert got[1]["en"] == pytest.approx(5 / 6) and got[3]["en"] == 0 == got[4]["en"]
    declared = shares.select("id", text.contradicts("shares", F.array(F.lit("de"))).alias("c"), text.contradicts("shares", F.array(F.lit("en"))).alias("own"), text.contradicts("shares", F.array(F.lit("xx"))).alias("no"))
    assert {r.id: (r.c, r.own, r.no) for r in declared.collect()} == {1: (True, False, False), 2: (True, True, False), 3: (False,) * 3, 4: (False,) * 3}


def test_present_spans_merge():
    assert text.present_spans("neural networks and networks", [["neural", "networks"], ["networks"]]) == [(0, 15), (20, 28)]
