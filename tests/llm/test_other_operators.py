import itertools
import pathlib
import pickle
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phrasemill.llm import chat, common, licenses, media, pseudo_likelihood, token_counts


def _greedy(word, initial, continuing):
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (continuing if at else initial)), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


def test_automaton_equals_greedy():
    rng = random.Random(1)
    for _ in range(400):
        vocabulary = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))]
        initial, continuing = (set(rng.sample(vocabulary, rng.randint(0, len(vocabulary)))) for _ in range(2))
        automaton = token_counts.Automaton(initial, continuing)
        for _ in range(20):
            word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
            assert automaton.count(word) == _greedy(word, initial, continuing)


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "The networks, again", 5), (2, None, 5), (3, "", 5), (4, "漢" * 3, 5), (None, "x", 5), (5, "ab" * 50_000, 5)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_counts.token_counts(df).collect()}
    assert got[1].n_words == 4 and got[1].n_tokens >= 4
    assert (got[2].n_words, got[2].n_tokens, got[3].n_tokens) == (0, 0, 0)
    assert got[5].n_words == 1 and got[5].n_tokens > 1000
    assert token_counts.token_counts(df.where("false")).count() == 0


def test_token_counts_of_whole_texts(spark):
    """Counts of texts against greedy cutting of each of their words."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=token_counts.MODEL)
    own = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    initial, continuing = {p[1:] for p in own if p[0] == "▁" and "▁" not in p[1:]} - {""}, {p for p in own if "▁" not in p}
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["networks", "Keyphrase", "extraction,", "zxqv", "réseaux", "漢", "a_b", "unbelievably", "😀"]) for _ in range(rng.randrange(40))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in token_counts.token_counts(spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")).collect()}
    for i, t in rows:
        counts = [_greedy(w, initial, continuing) for w in re.findall(r"[^\W_]+|[^\w\s]|_", t.lower())]
        assert got[i] == (len(counts), sum(counts) + counts.count(0), counts.count(0))


def test_gradient_is_right():
    net = pseudo_likelihood.Network({k: v.astype(float) for k, v in pseudo_likelihood.Network.new().p.items()})
    rng = np.random.default_rng(0)
    context, target = rng.integers(0, 2048, (50, 4)), rng.integers(0, 2000, 50)
    gradient = net.gradient(context, target)
    for k in pseudo_likelihood.SHAPES:
        at = np.unravel_index(np.abs(gradient[k]).argmax(), gradient[k].shape)
        values = []
        for step in (1e-5, -1e-5):
            net.p[k][at] += step
            values.append(-net.log_probs(context, target).mean())
            net.p[k][at] -= step
        assert gradient[k][at] == pytest.approx((values[0] - values[1]) / 2e-5, rel=1e-3)


def test_probabilities_sum_to_one():
    net = pseudo_likelihood.Network.new()
    every = np.arange(pseudo_likelihood.VOCABULARY)
    total = np.exp(net.log_probs(np.tile([1, 2, 3, 4], (len(every), 1)), every)).sum()
    assert total == pytest.approx(1, abs=1e-4)


def test_pseudo_likelihood(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(w for _ in range(40) for w in rng.choice(["a b c d", "e f g h"]).split())) for i in range(60)]
    odd = [(100, "d a h e c f b g " * 20), (101, None), (102, ""), (103, "a b c d " * 5000), (None, "a b")]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "doc_id long, text string, log_prob string")
    got = {r.doc_id: r for r in pseudo_likelihood.pseudo_likelihood(df).collect()}
    assert got[0].n_tokens == 160 and got[0].log_prob == pytest.approx(got[0].mean_log_prob * 160)
    assert (got[101].n_tokens, got[101].log_prob, got[101].mean_log_prob) == (0, 0.0, None) == (got[102].n_tokens, got[102].log_prob, got[102].mean_log_prob)
    assert got[100].mean_log_prob < np.mean([got[i].mean_log_prob for i in range(60)])
    assert pseudo_likelihood.pseudo_likelihood(df.where("false")).count() == 0


def test_every_position_is_trained_once():
    texts = ["a b c d e f g h " * 40, "", "x y", "a b c d e f g h " * 40]
    per = np.array([len(pseudo_likelihood.words(t)) for t in texts])
    each = [pseudo_likelihood.drawn([t.encode() for t in texts], per, k) for k in range(pseudo_likelihood.ROUNDS)]
    assert np.array_equal(np.sum(each, 0), np.ones(per.sum())) and min(e.sum() for e in each) > 100


def test_scorer_equals_the_network_token_by_token(spark):
    pl = pseudo_likelihood
    net, rng = pl.Network.new(3), np.random.default_rng(2)
    for p in net.p.values():
        p += rng.normal(0, 0.3, p.shape).astype(np.float32)
    rows = [rng.integers(0, pl.VOCABULARY - 1, n).astype(np.uint16) for n in (0, 1, 2, 700, 0, 40)]
    (_, flat, at, per), = pl.padded(pa.array([r.tobytes() for r in rows], pa.binary()))
    assert per.tolist() == [len(r) for r in rows]
    got = pl.Scorer(net)(flat, at, 128)
    assert got == pytest.approx(net.log_probs(pl.around(flat, at), flat[at]), abs=1e-3)
    p, k = {name: v.astype(float) for name, v in net.p.items()}, 0
    for r in rows:
        full = [pl.EDGE] * pl.WINDOW + r.tolist() + [pl.EDGE] * pl.WINDOW
        for i in range(pl.WINDOW, len(full) - pl.WINDOW)[:50]:
            x = np.concatenate([p["embed"][full[i + d]] for d in range(-pl.WINDOW, pl.WINDOW + 1) if d])
            h = np.tanh(x @ p["mixer"] + p["mixer_bias"])
            band, word = divmod(full[i], pl.WIDTH)
            total = 0
            for logits, own in ((h @ p["band"] + p["band_bias"], band), (h @ p["word"][band] + p["word_bias"][band], word)):
                total += logits[own] - np.log(np.exp(logits).sum())
            assert got[k + i - pl.WINDOW] == pytest.approx(total, abs=2e-3)
        k += len(r)


def test_held_out_texts_are_likelier_than_under_unigrams(spark):
    """Texts of a Markov chain that were not trained on, against the frequencies of single words."""
    pl, rng = pseudo_likelihood, np.random.default_rng(6)
    following = {i: rng.integers(0, 40, 3) for i in range(40)}

    def text(n):
        w = [0]
        for _ in range(n):
            w.append(int(rng.choice(following[w[-1]])))
        return " ".join(f"w{x}" for x in w)

    taught, held = [(i, text(300)) for i in range(300)], [(i, text(300)) for i in range(1000, 1020)]
    model = pl.fit(spark.createDataFrame(taught, "doc_id long, text string").coalesce(2))
    rows = pl.encoded(spark.createDataFrame([*held, held[0]], "doc_id long, text string"), model)
    got = pl.score(rows, model).collect()
    assert len({round(r.log_prob, 3) for r in got if r.doc_id == 1000}) == 1  # repeated rows score alike
    counts = Counter(w for _, t in taught for w in t.split())
    n = sum(counts.values())
    unigram = np.mean([np.log((counts[w] + 1) / (n + 41)) for _, t in held for w in t.split()])
    assert np.mean([r.mean_log_prob for r in got]) > unigram + 0.2


@pytest.mark.parametrize("held", [200_000, 0])
def test_words_of_a_bucket_have_their_own_share(spark, monkeypatch, held):
    pl = pseudo_likelihood
    monkeypatch.setattr(pl, "COMMON", held)
    first = "zq0"
    other = next(w for w in (f"zq{i}" for i in range(1, 10_000)) if pl.bucket(w) == pl.bucket(first))
    common = " ".join(f"w{i}" for i in range(pl.WORDS))
    rows = [(i, common) for i in range(4)] + [(10, f"w0 w1 {first} w2 w3"), (11, f"w0 w1 {first} w2 w3"), (12, f"w0 w1 {other} w2 w3"), (None, f"w0 w1 {first} w2 w3")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pl.fit(df)
    assert model.totals.sum() == 4 and first not in model.vocabulary
    got = {r.doc_id: r.log_prob for r in pl.score(pl.encoded(df, model), model).collect()}
    assert got[10] == pytest.approx(got[12] + np.log(3)) and got[11] == pytest.approx(got[10]) == got[None]
    unseen = next(w for w in (f"zr{i}" for i in range(10_000)) if pl.bucket(w) == pl.bucket(first))
    new = spark.createDataFrame([(1, f"w0 w1 {unseen} w2 w3")], "doc_id long, text string")
    new = pl.score(pl.encoded(new, model), model).first()
    assert new.log_prob == pytest.approx(got[12])


def test_licences(spark):
    mit = dict(licenses.TEXTS)["MIT"]
    british = "copyright (c) 2020 someone\n" + mit.replace('"', "'").upper().replace("SUBLICENSE", "SUBLICENCE") + "\n"
    rows = [(1, mit), (2, british), (3, mit + " extra"), (4, "prose\nReleased under the MIT Licence\nmore"), (5, None), (6, ""), (7, "SPDX-License-Identifier: Apache-2.0\nlicensed under GPLv3."), (8, "x " * 100_000), (None, mit), (9, "copyright me")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, digest string")
    got = {r.doc_id: (r.text_license, r.n_notices, r.notice_licenses) for r in licenses.scan(df, licenses.known_licences(spark)).collect()}
    assert got[1] == got[2] == got[None] == (licenses.TEXTS[0][0], 0, "")
    assert got[3] == got[5] == got[6] == got[8] == got[9] == (None, 0, "")
    assert got[4] == (None, 1, "MIT") and got[7] == (None, 2, "Apache-2.0,GPL-3.0")
    assert licenses.scan(df.where("false"), licenses.known_licences(spark)).count() == 0


def test_preference_pairs(spark):
    turns = [(1, s, i, r, t) for s, last in (("chosen", "good"), ("rejected", "bad")) for i, (r, t) in enumerate([("user", "hi"), ("assistant", "é"), ("user", None), ("assistant", last)])]
    turns += [(1, "chosen", 0, "user", "hi"), (2, "chosen", 0, "user", "alone"), (3, "chosen", 0, "user", "x"), (3, "rejected", 0, "user", "x"), (None, "chosen", 0, "user", "x"), (4, "chosen", 0, "user", "a"), (4, "rejected", 0, "assistant", "a"), (4, "rejected", 1, "user", "b")]
    df = spark.createDataFrame([(*t, 0) for t in turns], "pair_id long, side string, turn int, role string, text string, prompt int")
    got = {r.pair_id: r for r in chat.preference_pairs(df).collect()}
    assert set(got) == {1, 3, 4}
    one = got[1]
    assert one.prompt_turns == 3 and one.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\né<|end|>\n<|user|>\n<|end|>\n"
    a, b = map(int, one.chosen_mask.split(":"))
    assert one.chosen[a:b] == "good<|end|>\n" and one.rejected == "<|assistant|>\nbad<|end|>\n"
    assert (got[3].prompt_turns, got[3].chosen, got[3].rejected) == (1, "", "")
    assert (got[4].prompt_turns, got[4].prompt, got[4].chosen_mask) == (0, "", "")
    assert chat.preference_pairs(df.where("false")).count() == 0


def test_swapped_endings(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "é" * 5, "long " * 300])) for c in (*range(-4, 12), 20, 23) for t in range(rng.randint(1, 4))]
    rows += rows[:5] + [(2, 0, "user", "another first"), (None, 0, "user", "x"), (3, None, "user", "x"), (40, 1, "user", "alone")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, last long")
    conversations = {}
    for c, t, role, text in rows:
        if c is not None and t is not None:
            conversations.setdefault(c, set()).add((t, role or "", text or ""))
    want = {}
    for c, turns in conversations.items():
        last, other = max(turns)[0], conversations.get(c ^ 1, set())
        ending = {(last, *t[1:]) for t in other if t[0] == max(other)[0]}
        rejected = sorted({t for t in turns if t[0] < last} | ending)
        if rejected:
            want[c] = (sorted(turns), rejected)
    got = {r.pair_id: ([tuple(t) for t in r.chosen], [tuple(t) for t in r.rejected]) for r in chat.swapped_endings(df).collect()}
    assert got == want
    for r in chat.formatted(chat.swapped_endings(df)).collect():
        chosen, rejected = want[r.pair_id]
        n = next((i for i, (a, b) in enumerate(zip(chosen, rejected, strict=False)) if a[1:] != b[1:]), min(len(chosen), len(rejected)))
        assert r.prompt_turns == n
        for side, turns in (("chosen", chosen), ("rejected", rejected)):
            assert r.prompt + r[side] == "".join(f"<|{role}|>\n{text}<|end|>\n" for _, role, text in turns)
            spans = [tuple(map(int, x.split(":"))) for x in r[f"{side}_mask"].split(",") if x]
            assert [r[side][a:b] for a, b in spans] == [f"{text}<|end|>\n" for _, role, text in turns[n:] if role == "assistant"]
    assert chat.swapped_endings(df.where("false")).count() == 0


def test_licence_lines_of_any_length_and_wording(spark, monkeypatch):
    more = spark.createDataFrame([("Foo", "notice", "This file is covered by the Foo terms"), ("Bar", "digest", "AB" * 32), ("Two", "notice", "two\nlines")], "license string, kind string, text string")
    known = licenses.known_licences(spark).unionByName(more)
    framed = "*" * 210 + " Released under the MIT License. " + "*" * 300
    rows = [(1, framed), (2, "# this FILE is covered, by the foo terms\n" * 2), (3, "two\nlines"), (4, "x\r\n  licensed under the GPL version 3  \r\ny"), (5, "Permission denied " * 50_000), (1, framed)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bound in (20_000, 10):  # in one map, and by a shuffled join
        monkeypatch.setattr(licenses, "NOTICE_MAP", bound)
        got = sorted((r.doc_id, r.text_license, r.n_notices, r.notice_licenses) for r in licenses.scan(df, known).collect())
        assert got == [(1, None, 1, "MIT"), (1, None, 1, "MIT"), (2, None, 2, "Foo"), (3, None, 0, ""), (4, None, 1, "GPL-3.0"), (5, None, 0, "")]


def test_digests_of_licence_texts(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [(k, " \n".join((folder / k).read_text(errors="replace").upper().split("\n"))) for k in names if (folder / k).exists()]
    if not texts:
        pytest.skip("no licence texts on this machine")
    got = {r.doc_id: r.text_license for r in licenses.scan(spark.createDataFrame(texts, "doc_id string, text string"), licenses.known_licences(spark)).collect()}
    assert got == {k: names[k] for k, _ in texts}


def test_media(spark):
    rng = np.random.default_rng(1)
    base = [media.picture_of(rng.standard_normal(64)) for _ in range(5)]
    patched, noisy = base[0].copy(), base[1] + rng.normal(0, 3, base[1].shape)
    patched[20:30, 20:34] = 255
    pictures = [*base, base[0][6:60, 9:64], base[0] * 0.7 + 30, patched, np.rot90(base[1]), noisy, base[4]]
    rows = [(i, media.png(p), "n") for i, p in enumerate(pictures)] + [(50, None, "n"), (51, b"junk", "n"), (52, media.png(np.zeros((64, 64))), "n"), (53, b"P5 2 2 255\n1234", "n"), (None, media.png(base[2]), "n")]
    got = {r.id: r.class_id for r in media.copies(spark.createDataFrame(rows, "id long, data binary, class_id string")).collect()}
    assert [got[i] for i in range(11)] == [0, 1, 2, 3, 4, 0, 0, 0, 1, 1, 4]
    assert [got[i] for i in (50, 51, 52, 53)] == [50, 51, 52, 53] and got[None] == 2
    assert media.copies(spark.createDataFrame([], "id long, data binary")).count() == 0


def _turned(a, degrees, scale=1.0):
    """The picture turned about its middle and resized, by linear interpolation, on its own frame."""
    n = a.shape[0]
    y, x = np.mgrid[:n, :n] - (n - 1) / 2
    c, s = np.cos(np.radians(degrees)) / scale, np.sin(np.radians(degrees)) / scale
    fy, fx = np.clip(y * c + x * s + (n - 1) / 2, 0, n - 1.001), np.clip(x * c - y * s + (n - 1) / 2, 0, n - 1.001)
    i, j = fy.astype(int), fx.astype(int)
    v, u = fy - i, fx - j
    return a[i, j] * (1 - v) * (1 - u) + a[i + 1, j] * v * (1 - u) + a[i, j + 1] * (1 - v) * u + a[i + 1, j + 1] * v * u


def test_media_edits_of_larger_pictures(spark):
    rng = np.random.default_rng(8)

    def scene():
        a = rng.standard_normal((160, 160))
        for _ in range(3):
            a = media._blur(a)
        return 128 + 40 * a / a.std()

    base = [scene() for _ in range(4)]
    a = base[0]
    edits = [media.shrunk(a, 1.25), _turned(a, 10), _turned(a, 25, 0.9), media.shrunk(a, 1.5), a[30:130, 20:150], a[::-1, ::-1] + rng.normal(0, 4, a.shape)]
    rows = [(i, media.png(p)) for i, p in enumerate([*base, *edits])]
    got = {r.id: (r.class_id, r.class_size) for r in media.copies(spark.createDataFrame(rows, "id long, data binary")).collect()}
    assert [got[i] for i in range(4)] == [(0, 7), (1, 1), (2, 1), (3, 1)]
    assert [got[i][0] for i in range(4, 10)] == [0] * 6


def test_media_keys_meet():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 256, (400, media.BITS // 8), np.uint8)
    for far in (1, 3, 2 * media.PARTS - 1):
        b = np.unpackbits(a, axis=1)
        for row in b:
            row[rng.choice(media.BITS, far, replace=False)] ^= 1
        b = np.packbits(b, axis=1)
        for level in (0, 1):
            assert (media.keys(a, level) == media.keys(b, level)).any(1).all()
            assert not (media.keys(a, level)[:-1] == media.keys(b, level)[1:]).any()


def test_media_recall_against_all_pairs(spark, monkeypatch):
    """Noisy, cropped and shaded copies, of which some share a frame: classes against consensus of all pairs."""
    monkeypatch.setattr(media, "SMALL", 2)
    monkeypatch.setattr(media, "PIVOTS", 2)
    rng = np.random.default_rng(9)
    pictures = []
    for i in range(25):
        base = media.picture_of(rng.standard_normal(64))
        for _ in range(1 + i % 3):
            p = base + rng.normal(0, rng.choice([2, 5, 8]), base.shape)
            pictures.append(p[: rng.integers(50, 64), : rng.integers(50, 64)])
    logo = media.picture_of(rng.standard_normal(64))[:30, :30]
    for _ in range(12):
        p = media.picture_of(rng.standard_normal(64))
        p[:30, :30] = logo
        pictures.append(p)
    pictures += [pictures[0], pictures[0]]
    data = [media.png(p) for p in pictures]
    known = [media.describe(media.decode(d)) for d in data]
    parent, links = list(range(len(data))), 0

    def root(i):
        return i if parent[i] == i else root(parent[i])

    pairs = [(i, j) for i in range(len(data)) for j in range(i + 1, len(data)) if media.consensus(known[i], known[j]) >= media.MIN_VOTES]
    for i, j in pairs:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    df = spark.createDataFrame(list(enumerate(data)), "id long, data binary")
    got = {r.id: r.class_id for r in media.copies(df).collect()}
    assert len(pairs) > 30 and np.mean([got[i] == got[j] for i, j in pairs]) >= 0.9
    assert all(root(i) == root(c) for i, c in got.items())


def test_media_pairs_that_meet_in_one_large_bucket_only(spark, monkeypatch):
    """Tables of later rounds need not bring together what met by luck in a bucket that was too large to compare at once."""
    monkeypatch.setattr(media, "SMALL", 2)
    monkeypatch.setattr(media, "_keyed", lambda described, level: described.select("node", (F.col("node") if level else F.lit(1).cast("long")).alias("sig")))
    rng = np.random.default_rng(5)
    first, copied, last = (media.picture_of(rng.standard_normal(64)) for _ in range(3))
    rows = [(i, media.png(p)) for i, p in enumerate([first, copied, copied + rng.normal(0, 1, copied.shape), last])]
    got = {r.id: r.class_id for r in media.copies(spark.createDataFrame(rows, "id long, data binary")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 3}


def _small_album():
    rng = np.random.default_rng(12)
    base = [media.picture_of(rng.standard_normal(64)) for _ in range(4)]
    pictures = [*base, *(p + rng.normal(0, 2, p.shape) for p in (base[0], base[0], base[2]))]
    return [(i, media.png(p)) for i, p in enumerate(pictures)], {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 0, 6: 2}


def test_media_few_rows_take_few_tasks(spark):
    """Classes, open buckets and pairs of a small table are not dealt to all shuffle partitions again and again."""
    rows, want = _small_album()
    pictures = spark.createDataFrame(rows, "id long, data binary")
    launched = lambda: spark.sparkContext._jsc.sc().taskScheduler().nextTaskId()
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        first = launched()
        got = {r.id: r.class_id for r in media.copies(pictures).collect()}
        tasks = launched() - first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == want
    assert tasks < 1500, tasks


def test_media_many_rows(spark, monkeypatch):
    """The same classes where nothing is small enough for one task or a broadcast."""
    rows, want = _small_album()
    monkeypatch.setattr(common, "FEW_ROWS", -1)
    monkeypatch.setattr(media, "CARRIED", 0)
    monkeypatch.setattr(media, "SMALL", 2)
    got = {r.id: r.class_id for r in media.copies(spark.createDataFrame(rows, "id long, data binary")).collect()}
    assert got == want


@pytest.mark.parametrize("few", [-1, 1000])
def test_united_components(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_ROWS", few)
    rng = random.Random(3)
    parent = list(range(60))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    known = spark.createDataFrame([], "node long, root long")
    for edges in ([(rng.randrange(60), rng.randrange(60)) for _ in range(20)], [], [(rng.randrange(60), rng.randrange(60)) for _ in range(20)], [(5, 5)]):
        for i, j in edges:
            parent[max(root(i), root(j))] = min(root(i), root(j))
        known = common.united(known, spark.createDataFrame(edges, "a long, b long"))
        assert {r.node: r.root for r in known.collect()} == {i: root(i) for i in range(60) if root(i) != i}


def test_picture_formats():
    grey = np.arange(48.0).reshape(6, 8)
    assert np.array_equal(media.decode(media.png(grey)), grey)
    assert np.array_equal(media.decode(b"P5\n# note\n8 6\n255\n" + grey.astype(np.uint8).tobytes()), grey)
    assert media.decode(b"P6 1 1 255\n\x03\x06\x09")[0, 0] == 6
    assert media.decode(None) is None and media.decode(b"\x89PNG\r\n\x1a\nxx") is None


def test_a_worker_holds_listed_words_in_little_memory():
    pl = pseudo_likelihood
    vocabulary, common_ = [f"v{i}" for i in range(pl.WORDS)], {f"word{i}": 2 + 10**6 // (i + 1) for i in range(100_000)}
    value = pickle.loads(pickle.dumps(pl.listed(vocabulary, common_)))
    tracemalloc.start()
    held = pl._holding(value)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size < 110 * 100_000  # its words and one table; a number a word, counts by word, and both again as broadcast take half as much again
    for word, n in itertools.islice(common_.items(), 0, None, 997):
        assert held.net_id[held.place[word]] == pl.bucket(word) and held.log[held.place[word]] == np.log(n)
    assert [int(held.net_id[held.place[w]]) for w in vocabulary] == list(range(pl.WORDS)) and held.log[held.place["v7"]] == 0
    assert held.net_id[-1] == 0 and held.log[-1] == 0
    pl._release()
    assert not pl._held and pl._Held(pl.listed([], {})).place == {}
