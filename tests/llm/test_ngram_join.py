import random
import re

import numpy as np
import pytest

from phrasemill.llm import common
from phrasemill.llm import ngram_join as nj


def _brute(rows, width, p, q):
    """Components by comparing all pairs of shingle sets."""
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def _corpus(seed):
    """Families of edited copies, a passage that many texts share, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    passage = [word() for _ in range(60)]
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice([8, 30, 120, 400]))]
        if rng.random() < 0.5:
            base[3:3] = passage
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t "), (n + 3, "One"), (n + 4, "one"), (n + 5, "one two"), (n + 6, "ONE\ntwo")]


@pytest.mark.parametrize(("width", "p"), [(3, 90), (5, 80), (2, 60)])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, width, p, seed):
    rows = _corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_components(df, width, p, 100).collect()}
    assert got == _brute(rows, width, p, 100)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nj.jaccard_components(empty).count() == 0
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (7, "A B C D"), (None, "z y x"), (8, "x" * 300_000), (9, None)]
    got = sorted(map(tuple, nj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert sorted(got, key=str) == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (7, 2, 5), (None, 1, None), (8, 1, 8), (9, 0, 9)], key=str)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for n in (9, 10, 25, 60, 200, 700):
        for _ in range(20):
            base = rng.integers(1, 2**63, n + n // 9 + 1).astype(np.uint64)
            a = np.unique(base[:n])
            cut = int(rng.integers(0, max(1, n // 19) + 1))
            b = np.unique(np.concatenate([a[cut:], base[n : n + cut]]))
            if 100 * len(np.intersect1d(a, b)) < 90 * len(np.union1d(a, b)):
                continue
            sig, per = nj.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
            assert len(a) == len(b) and (a == b).all() or set(sig[: per[0]].tolist()) & set(sig[per[0] :].tolist())


def test_repeated_ids(spark):
    """An id whose rows hold several texts is one document, linked by any of them."""
    words = [f"w{i}" for i in range(60)]
    a, b, near = "p q r s t", " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(5, a), (7, a), (7, b), (8, near), (9, "u v w x y"), (9, "u v w x z"), (10, "u v w x z"), (None, b), (11, None), (11, a + " e")]
    got = sorted(map(tuple, nj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = [(5, 3, 5), (7, 3, 5), (7, 58, 5), (8, 58, 5), (9, 3, 9), (9, 3, 9), (10, 3, 9), (None, 58, 5), (11, 0, 11), (11, 4, 11)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("large", [3, 2048])
def test_hot_families(spark, monkeypatch, large):
    """Large buckets of unlinked and linked near copies are compared in place, or go through all levels and the families."""
    monkeypatch.setattr(nj, "LARGE", large)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    base, rows = [word() for _ in range(150)], []
    passage = [word() for _ in range(70)]
    for i in range(70):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            copy[rng.randrange(len(copy))] = word()
        rows.append((2 * i, " ".join(copy)))
        rows.append((2 * i + 1, " ".join([word() for _ in range(60)] + passage)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, p in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_components(df, width, p, 100).collect()}
        want = _brute(rows, width, p, 100)
        assert got == want
        assert 1 < len({c for i, (_, c) in want.items() if i % 2 == 0}) < 70


def test_near_pairs_against_all_pairs(monkeypatch):
    monkeypatch.setattr(nj, "CHUNK", 200)  # many blocks
    rng = np.random.default_rng(7)
    base = np.unique(rng.integers(1, 2**63, 60).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(40, 60)], rng.integers(1, 2**63, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(30)]
    sizes, nodes, roots = np.array([len(s) for s in sets]), rng.permutation(1000)[:30], rng.choice([1, 1, 1, 2, 3, 4], 30)
    bits = nj.sketches(np.concatenate(sets), sizes)
    got = {(int(x), int(y)) for x, y in zip(*nj.near_pairs(nodes, roots, sizes, bits, 80, 100), strict=True)}
    near, linked = set(), set()
    for i in range(30):
        for j in range(i):
            pair = (min(nodes[i], nodes[j]), max(nodes[i], nodes[j]))
            if roots[i] != roots[j] and 180 * nj.least_difference(bits[i], bits[j]) <= 20 * (sizes[i] + sizes[j]):
                near.add(pair)
            if roots[i] != roots[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])):
                linked.add(pair)
    assert linked <= got and near <= got and linked
    assert nj.near_pairs(nodes, roots * 0, sizes, bits, 80, 100)[0].size == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for n in (1, 5, 40, 300, 2000):
        base = np.unique(rng.integers(1, 2**63, n + n // 3 + 2).astype(np.uint64))
        a, b = base[:n], base[n // 5 :]
        x, y = nj.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert nj.least_difference(x, y) == nj.least_difference(y, x) <= len(np.setxor1d(a, b))
        assert nj.least_difference(x, x) == 0


def test_components_of_few_edges_take_few_jobs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pairs = [tuple(map(int, x)) for x in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(10**15, 5), (None, 3), (7, 7), (-5, 390)]
    root = {x: x for a, b in pairs if a is not None and a != b for x in (a, b)}
    for _ in pairs:
        for a, b in pairs:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    edges = spark.createDataFrame(pairs, "a long, b long")
    jobs = {}
    for few in (common.FEW_ROWS, 0):
        monkeypatch.setattr(common, "FEW_ROWS", few)
        spark.sparkContext.setJobGroup(f"components {few}", "")
        rows = common.components(edges).collect()
        assert len(rows) == len(root) and dict(map(tuple, rows)) == root
        jobs[few] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {few}"))
    spark.sparkContext.setJobGroup("tests", "")
    assert jobs.pop(0) > 20 and max(jobs.values()) <= 8
    assert common.trim(spark) in (True, False)
