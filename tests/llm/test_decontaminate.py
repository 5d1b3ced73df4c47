from phrasemill.llm import decontaminate as dc

ITEM = "if tom has 12 apples and gives 5 apples to his friend how many of the 12 apples are left in the basket"
PLAIN = "some quite long question about the history of the old bridge over the wide river near the town"


def _run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 0, "n") for i, t in docs], "doc_id long, text string, item_id int, tokens string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.same_slots for r in dc.leaks(d, b).collect()}


def test_leaks(spark):
    other = ITEM.replace("12", "30").replace("5", "7")
    clash = ITEM.replace("12", "30", 1)
    docs = [
        (1, f"Before. {ITEM}. After it all."), (2, f"x {other} y"), (3, f"x {clash} y"), (4, "a text about nothing in particular, with 12 apples"), (5, None), (6, ""), (7, PLAIN.upper()),
        (8, " ".join(PLAIN.split()[:8])), (9, "1 2 3 4 5 6 7 8 9"), (1, "repeated id"), (None, ITEM), (10, "filler " * 50_000 + ITEM),
    ]
    assert _run(spark, docs, [(100, ITEM), (101, PLAIN), (102, None), (103, ""), (104, "12 13 14 15 16 17")]) == {(1, 100): True, (2, 100): False, (3, 100): False, (7, 101): True, (10, 100): True}


def test_short_items_and_empty_tables(spark):
    assert _run(spark, [(1, "two words"), (2, "two words more")], [(5, "Two words!")]) == {(1, 5): True}
    assert _run(spark, [(1, "a b c d e f")], []) == {}
    assert _run(spark, [], [(1, ITEM)]) == {}


def test_names_are_slots(spark):
    item = "the story says that Alice went to the market and that Alice bought bread for the evening"
    assert _run(spark, [(1, item.replace("Alice", "Robert")), (2, item.replace("Alice", "Robert", 1))], [(7, item)]) == {(1, 7): False, (2, 7): False}


def test_lookalikes_stay(spark):
    """The template with slots that contradict each other; only windows beside them count, and they are few."""
    item = "there were 12 red and 12 blue and 12 green balls in 12 boxes of 12 rooms"
    other = "so there were 3 red and 4 blue and 5 green balls in 6 boxes of 7 rooms then"
    assert _run(spark, [(1, other), (2, item.replace("12", "13"))], [(7, item)]) == {(2, 7): False}


def test_names_that_open_sentences(spark):
    item = "Tom has 3 apples. Tom buys 4 more apples. Tom eats 2. How many apples does Tom have?"
    docs = [(1, item.replace("Tom", "Ann").replace("3", "8")), (2, f'He wrote: "{item}"'), (3, "Ann has 3 pears. Bob sells 4 plums. Cid finds 2."), (4, item.replace("Tom", "ann"))]
    assert _run(spark, docs, [(7, item)]) == {(1, 7): False, (2, 7): True}


def test_items_of_few_words(spark):
    """Formulas and short items are found inside other texts by the values of their slots."""
    items = [(1, "12 + 7 = 19 and 19 - 7 = 12"), (2, "Compute 12 * (34 + 56) - 78 / 9"), (3, "Solve 3 x + 4 = 19"), (4, "capital of France?"), (5, "why?"), (6, "1, 2, 4, 8, 16, 32, 64")]
    docs = [
        (10, "As we know 12 + 7 = 19 and 19 - 7 = 12, so there."), (11, "13 + 7 = 20 and 20 - 7 = 13"), (12, "Now compute 12 * (34 + 56) - 78 / 9 quickly"), (13, "please solve 3 x + 4 = 19 at home"),
        (14, "the capital of France? it is"), (15, "why? oh why"), (16, "Why"), (17, "series 1, 2, 4, 8, 16, 32, 64 goes on"), (18, "series 1, 3, 9, 27, 81, 243"),
    ]
    assert set(_run(spark, docs, items)) == {(10, 1), (12, 2), (13, 3), (14, 4), (16, 5), (17, 6)}


def test_long_copy_with_one_changed_number(spark):
    passage = "the old mill by the river ground 12 sacks of corn before the miller closed the heavy wooden doors for the long cold winter and counted all 12 sacks again"
    near = passage.replace("12", "30", 1)
    assert _run(spark, [(1, f"x {near} y"), (2, passage)], [(7, passage)]) == {(1, 7): False, (2, 7): True}


def test_long_runs_of_names_and_numbers(spark):
    """Repeated groups of the patterns must not recurse: such a text ended the executor, and with it the job."""
    docs = [(1, "see " + "Ann Bob " * 10_000 + ITEM), (2, "1" + ".1" * 50_000 + " " + ITEM), (3, "the " + "Ann-Lee O'Hara " * 3 + "and 1,000.5, 2.")]
    assert _run(spark, docs, [(7, ITEM)]) == {(1, 7): True, (2, 7): True}
    d = spark.createDataFrame(docs[2:], "doc_id long, text string")
    tokens = dc._canonical(d).first().tokens
    assert tokens == ["the", "\x01ann-lee o'hara ann-lee o'hara ann-lee o'hara\x05", "and", "\x031,000.5\x05", "\x032\x05"]
