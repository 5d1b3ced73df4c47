"""Exact Jaccard self-join of word-shingle sets with PartEnum signatures.

A document's set holds its distinct ``width``-word shingles as 64-bit hashes. Sets are put into
size bands such that two sets with Jaccard similarity >= p/q lie in one band or in neighbouring
ones; each band has a Hamming threshold ``k``, the largest symmetric difference a linked pair of
that band can have. The shingle domain is partitioned into ``n1 = n0 + e`` parts with
``n0 = ceil((k+1)/2)``, so that in at least ``e + 1`` parts a linked pair differs in at most one
shingle; a part is partitioned again into ``N2 = 3`` cells, of which at least two agree there. The
``n1 * C(3, 2)`` subsets of cells are enumerated as signatures: a linked pair always shares one.

Where the threshold is low, kept cells are often empty, and sets that have nothing in common would
meet there. A set with at most ``e`` parts in which kept cells are empty leaves those signatures out: of the
``e + 1`` agreeing parts one has none of them, so nothing is lost. Any other set keeps all.

Equal sets collapse to one node first. Nodes that share a signature form a bucket, and equal buckets
are taken once. Pairs of nodes are sifted by parity sketches (the bits in which two sketches differ bound
the symmetric difference from below) and then compared exactly: first every node of a bucket with its
smallest; then, in buckets of at most ``LARGE`` nodes that these links don't join to one component, all pairs
of nodes of different components, sketch against sketch where the bucket's rows meet, so that only pairs
that pass the sieve are ever written.

A larger open bucket is no group to compare in one task; its nodes go through a second, independent partition
of the domain, in which sets that met by chance part: a linked pair not found yet shares an open bucket of every
level. What is open after ``LEVELS`` partitions are many texts much alike. Stars of their
buckets form families, in which links are found exactly and still without all pairs, by differences to the
family's majority set C (shingles that more than half of its members have):

* with ``D = A xor C`` and ``e = |D|/w - |A|`` scaled to integers, A and B are linked exactly when
  ``2 |D_A & D_B|`` is at least ``e_A + e_B`` (see ``_gap``);
* the member M of least ``e`` is linked with every A of ``e_A + e_M <= 0``, and no other pair can be
  linked without a common element of D;
* the rest are joined on prefixes of their differences (additions before removals), by levels of
  ``e``, and the few resulting pairs are verified by intersection.

A family whose unlinked members all share the same differences is the worst case of the last step.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.common import arrow_rows, buckets_of, components, discard, sized, still_open, stored

WIDTH, P, Q = 3, 90, 100
CHUNK = 1 << 20
#: Independent partitions that large open buckets go through, and the most nodes of a bucket that are compared with each other.
LEVELS, LARGE = 3, 2048
#: Texts that are handed to Python at once.
AT_ONCE = 1000
#: Where kept cells hold fewer shingles on average than this, sets get one more part for each ten, and
#: those of thresholds up to ``SMALL_K`` more signatures.
DENSE, SMALL_K = 10, 22

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_BASE = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_K = [_U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INV)):
            steps = np.full(max(n, CHUNK), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def _chunk_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts in ``data``, and the number of each text."""
    n_docs, n = len(offsets) - 1, len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(n_docs, np.int64)
    word = _WORD[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    start[edge] = word[edge]
    end = word.copy()
    end[:-1] &= ~word[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = word[last]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    if not len(a):
        return np.empty(0, np.uint64), np.zeros(n_docs, np.int64)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    words = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
    doc = np.searchsorted(offsets, a, side="right") - 1
    count = np.bincount(doc, minlength=n_docs)
    first = np.zeros(n_docs + 1, np.int64)
    np.cumsum(count, out=first[1:])
    parts, owner = [], []
    if len(words) >= width:
        whole = doc[: len(doc) - width + 1] == doc[width - 1 :]
        h = np.zeros(len(words) - width + 1, np.uint64)
        for j in range(width):
            h += words[j : len(words) - width + 1 + j] * (_K[j % 4] + _U(2 * (j // 4)))
        parts.append(mix(h[whole]))
        owner.append(doc[: len(doc) - width + 1][whole])
    for d in np.flatnonzero((count > 0) & (count < width)):
        h = _U(count[d])
        with np.errstate(over="ignore"):
            for j in range(count[d]):
                h = h + words[first[d] + j] * (_K[j % 4] + _U(2 * (j // 4))) + _K[3]
        parts.append(mix(np.array([h], np.uint64)))
        owner.append(np.array([d]))
    hashes, owner = np.concatenate(parts), np.concatenate(owner)
    if len(parts) > 1:
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    sizes = np.bincount(owner, minlength=n_docs)
    at = np.zeros(n_docs + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    for d in np.flatnonzero(sizes > 1):
        hashes[at[d] : at[d + 1]].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[keep], np.bincount(owner[keep], minlength=n_docs)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, flat sorted hashes, number per row)`` for runs of rows of about ``CHUNK`` bytes."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        j = min(j, len(texts))
        yield i, *_chunk_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
        i = j


@lru_cache(maxsize=16)
def _bands(p: int, q: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper ends of the size bands up to ``largest`` and one more, and the Hamming threshold of each."""
    ends, low = [0], 1
    while ends[-1] < largest or len(ends) < 3:
        ends.append(low * q // p)
        low = ends[-1] + 1
    low = ends[-1] + 1
    ends.append(low * q // p)
    ends_ = np.array(ends, np.int64)
    # |A xor B| <= (q - p) (|A| + |B|) / (q + p)
    return ends_, (q - p) * 2 * ends_ // (q + p)


def _plan(k: int, p: int, q: int) -> tuple[int, int]:
    """Cells of a part, and how many of them a signature leaves out, for a band of Hamming threshold ``k``.

    Where the threshold is high, one of three cells. Low thresholds need more: small sets can afford more
    signatures, which then cover more of their shingles.
    """
    if 2 * (q + p) >= 3 * DENSE * (q - p) or k > SMALL_K:
        return 3, 1
    return (8, 4) if k in (3, 4) else (6, 2)


def signatures(flat: np.ndarray, sizes: np.ndarray, p: int = P, q: int = Q, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of consecutive sets: flat int64 signatures and the number per set.

    ``level`` chooses one of many independent partitions of the shingle domain.
    """
    if not len(flat):
        return np.empty(0, np.int64), np.zeros(len(sizes), np.int64)
    ends, ks = _bands(p, q, 1 << int(sizes.max()).bit_length())
    band = np.searchsorted(ends, sizes)  # ends[band - 1] < size <= ends[band]
    plans = [_plan(int(k), p, q) for k in ks]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    low, high = (flat & _U(0xFFFFFFFF)).astype(np.float64), (flat >> _U(32)).astype(np.float64)
    seed = mix(np.array([level], np.uint64))
    part_of, cell_of = mix(flat ^ _K[0] ^ seed) >> _U(11), mix(flat ^ _K[1] ^ seed) >> _U(11)
    out, who = [], []
    for step in (0, 1):
        at = np.minimum(band + step, len(ks) - 1)
        for cells, left in sorted(set(plans)):
            k = np.where(sizes > 0, ks[at], 0) * np.array([x == (cells, left) for x in plans])[at]
            n0 = np.where(k > 0, k // (left + 1) + 1, 0)  # ceil((k + 1) / (left + 1))
            # With this many shingles on average in the cells that are kept, none is hardly ever seen.
            spare = (n0 + 5) // 10 if (cells - left) * (left + 1) * (q + p) < 2 * DENSE * cells * (q - p) else np.zeros_like(n0)
            n1 = n0 + spare
            base = np.zeros(len(sizes) + 1, np.int64)
            np.cumsum(n1 * cells, out=base[1:])
            if not base[-1]:
                continue
            live = n1[owner] > 0
            own = owner[live]
            cell = base[own] + (part_of[live] % n1[own].astype(np.uint64)).astype(np.int64) * cells + (cell_of[live] % _U(cells)).astype(np.int64)
            lo = np.bincount(cell, low[live], base[-1]).astype(np.uint64).reshape(-1, cells)
            hi = np.bincount(cell, high[live], base[-1]).astype(np.uint64).reshape(-1, cells)
            doc = np.repeat(np.arange(len(sizes)), n1)
            part = np.arange(len(doc)) - base[doc] // cells
            tag = mix((at[doc].astype(np.uint64) << _U(32)) ^ part.astype(np.uint64) ^ _K[2])
            chosen = [list(c) for c in itertools.combinations(range(cells), cells - left)]
            lo, hi = (np.stack([x[:, c].sum(1) for c in chosen], 1) for x in (lo, hi))
            sig = mix(mix(lo * _K[0] + tag[:, None]) + mix(hi * _K[1] + np.arange(len(chosen), dtype=np.uint64)))
            empty = (lo | hi) == 0
            kept = ~(empty & (np.bincount(doc[empty.any(1)], minlength=len(sizes)) <= spare)[doc][:, None])
            out.append(sig[kept].view(np.int64))
            who.append(np.repeat(doc, kept.sum(1)))
    if not out:
        return np.empty(0, np.int64), np.zeros(len(sizes), np.int64)
    who_, sig_ = np.concatenate(who), np.concatenate(out)
    order = np.argsort(who_, kind="stable")
    return sig_[order], np.bincount(who_, minlength=len(sizes))


def sketches(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Parity sketches of consecutive sets: bit i tells whether an odd number of elements falls on i.

    A sketch has two to four bits an element, a power of two, so that its halves fold by exclusive or.
    """
    bits = np.array([max(64, 2 << int(n - 1).bit_length()) if n else 64 for n in sizes.tolist()], np.int64)
    start = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(bits, out=start[1:])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = start[owner] + (mix(flat ^ _K[3]) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=start[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of the two sets behind sketches ``a`` and ``b``."""
    x, y, n = int.from_bytes(a, "little"), int.from_bytes(b, "little"), min(len(a), len(b)) * 8
    for wide, other in ((len(a) * 8, 0), (len(b) * 8, 1)):
        while wide > n:
            wide //= 2
            if other:
                y = (y >> wide) ^ (y & ((1 << wide) - 1))
            else:
                x = (x >> wide) ^ (x & ((1 << wide) - 1))
    return (x ^ y).bit_count()


def _list(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    end = np.cumsum(sizes)
    return (total[end] - total[end - sizes]).view(np.int64)


def features(docs: DataFrame, width: int, with_text: bool = False) -> DataFrame:
    """``doc_id, n_shingles, d1, d2`` of each row: set size and 128-bit set digest; and its text if wanted."""
    more = ["text"] if with_text else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, flat, sizes in shingle_sets(batch.column("text"), width):
                digests = [pa.array(_sums(mix(flat ^ k), sizes)) for k in _K[2:4]]
                ids, *texts = (batch.column(k).slice(i, len(sizes)) for k in ["doc_id", *more])
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *digests, *texts], ["doc_id", "n_shingles", "d1", "d2", *more])

    schema = "doc_id long, n_shingles long, d1 long, d2 long" + ", text string" * with_text
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def signature_rows(docs: DataFrame, width: int, p: int, q: int, level: int = 0) -> DataFrame:
    """``node, sig``: the signatures of each row of ``docs(node, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            for i, flat, sizes in shingle_sets(batch.column("text"), width):
                sigs, per = signatures(flat, sizes, p, q, level)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes[i : i + len(sizes)], per)), pa.array(sigs)], ["node", "sig"])

    return docs.select("node", "text").mapInArrow(run, "node long, sig long")


def _gap(n_diff: np.ndarray, n: np.ndarray, p: int, q: int) -> np.ndarray:
    """Scaled e: A, B are linked when ``(q - p)(|A| + |B|) >= (q + p) |A xor B|``."""
    return (q + p) * n_diff - (q - p) * n


def _level(e: np.ndarray) -> np.ndarray:
    """0 for e <= 0, else 1 + floor(log2 e): the lower end of level l > 0 is 2**(l - 1)."""
    return np.where(e > 0, np.frexp(np.maximum(e, 1).astype(np.float64))[1], 0)


def _differences(members: DataFrame, p: int, q: int) -> DataFrame:
    """``family, node, e, added, removed`` from ``family, node, grams`` and the family's ``core``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                e, added, removed = [], [], []
                for grams, core in zip(part.column("grams"), part.column("core"), strict=True):
                    a, c = grams.values.to_numpy(), core.values.to_numpy() if core.is_valid else np.empty(0, np.int64)
                    for out, x, y in ((added, a, c), (removed, c, a)):
                        out.append(np.sort(np.setdiff1d(x, y, True)))
                    e.append(int(_gap(len(added[-1]) + len(removed[-1]), len(a), p, q)))
                lists = [_list(np.concatenate(x), np.array([len(y) for y in x])) for x in (added, removed)]
                yield pa.RecordBatch.from_arrays([part.column("family"), part.column("node"), pa.array(e, pa.int64()), *lists], ["family", "node", "e", "added", "removed"])

    return members.mapInArrow(run, "family long, node long, e long, added array<long>, removed array<long>")


def _repeated(rows: list[tuple], parts: list[np.ndarray], names: tuple[str, ...]) -> pa.RecordBatch:
    """One row per element of ``parts``, with the values of its part's row."""
    n = [len(x) for x in parts]
    cols = [pa.array(np.repeat(np.array(c, np.int64), n)) for c in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(parts))], [*names, "h"])


def _prefixes(members: DataFrame, p: int, q: int) -> DataFrame:
    """``family, la, lb, h, node, e, out, side``: the elements on which unlinked members can meet.

    A pair with levels la >= lb is joined under ``(family, la, lb)``; side 0 holds members of level la,
    side 1 those of level lb. ``2 (q + p) * overlap >= e_A + e_B`` bounds the overlap from the pair's
    levels, and with at least t common elements two sets meet in their first ``|D| - t + 1``.
    """
    scale = 2 * (q + p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fixed = zip(*(batch.column(k).to_pylist() for k in ("family", "node", "e", "e_min", "outlier", "levels")), strict=True)
            names = ("family", "la", "lb", "node", "e", "out", "side")
            rows, parts, size = [], [], 0
            for (family, node, e, e_min, outlier, levels), *lists in zip(fixed, batch.column("added"), batch.column("removed"), strict=True):
                d = np.concatenate([x.values.to_numpy() for x in lists])
                mine = int(_level(np.array([e]))[0])
                for other in levels if len(d) else ():
                    if mine == other == 0:
                        continue  # both are linked with the member of least e
                    t = max(1, -(-(e + (1 << (other - 1) if other else e_min)) // scale))
                    prefix = d[: max(0, len(d) - t + 1)]
                    for side in [0] if mine > other else [1] if mine < other else [0, 1]:
                        rows.append((family, max(mine, other), min(mine, other), node, e, int(outlier), side))
                        parts.append(prefix)
                        size += len(prefix)
                if size > CHUNK // 8:
                    yield _repeated(rows, parts, names)
                    rows, parts, size = [], [], 0
            if rows:
                yield _repeated(rows, parts, names)

    return members.mapInArrow(run, "family long, la long, lb long, node long, e long, out long, side long, h long")


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    """``node, n, bits`` of ``docs(node, text)``: set size and parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, flat, sizes in shingle_sets(batch.column("text"), width):
                cols = [batch.column("node").slice(i, len(sizes)), pa.array(sizes, pa.int64()), pa.array(sketches(flat, sizes), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["node", "n", "bits"])

    return docs.select("node", "text").mapInArrow(run, "node long, n long, bits binary")


def _ends(values: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """``values(node, ...)`` for either end of a pair: ``a`` and ``b`` with the other columns renamed."""
    return tuple(values.select(F.col("node").alias(end), *(F.col(k).alias(new + end) for k, new in zip(values.columns[1:], names, strict=True))) for end in "ab")


def _sifted(pairs: DataFrame, sketched: DataFrame, p: int, q: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that the sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            least = np.fromiter(map(least_difference, batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist()), np.int64, len(n))
            yield batch.select(["a", "b"]).filter(pa.array((q + p) * least <= (q - p) * n))

    at_a, at_b = _ends(sketched, "n", "bits_")
    return pairs.join(at_a, "a").join(at_b, "b").mapInArrow(run, "a long, b long")


def near_pairs(nodes: np.ndarray, roots: np.ndarray, sizes: np.ndarray, bits: list[bytes], p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of different components that the sketches don't rule out, of one bucket."""
    _, which, count = np.unique(roots, return_inverse=True, return_counts=True)
    # Members of the largest component need no look at each other.
    rest = np.flatnonzero(which != int(count.argmax()))
    if not len(rest):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words = min(len(x) for x in bits) // 8
    table = np.empty((len(bits), words), np.uint64)
    for i, x in enumerate(bits):
        table[i] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, words), 0)  # folded to the shortest
    order = np.full(len(nodes), -1)
    order[rest] = np.arange(len(rest))
    first, second, step = [], [], max(1, CHUNK // (len(bits) * words))
    for at in range(0, len(rest), step):
        own = rest[at : at + step]
        far = np.bitwise_count(table[own, None] ^ table[None]).sum(2, dtype=np.int64)
        ok = ((q + p) * far <= (q - p) * (sizes[own, None] + sizes[None])) & (which[own, None] != which[None]) & (order[None] < np.arange(at, at + len(own))[:, None])
        i, j = np.nonzero(ok)
        first.append(own[i])
        second.append(j)
    a, b = nodes[np.concatenate(first)], nodes[np.concatenate(second)]
    return np.minimum(a, b), np.maximum(a, b)


def _met(rows: DataFrame, sketched: DataFrame, p: int, q: int) -> DataFrame:
    """Distinct ``a, b``: near pairs of the buckets of ``rows(bucket, node, root)``, each of at most ``LARGE`` nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            bucket, node, root, size = (table.column(k).to_numpy() for k in ("bucket", "node", "root", "size"))
            bits = table.column("bits").to_pylist()
            edges = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1 if len(bucket) else 0, append=bucket[-1] + 1 if len(bucket) else 0))
            found = [near_pairs(node[i:j], root[i:j], size[i:j], bits[i:j], p, q) for i, j in zip(edges[:-1], edges[1:], strict=True) if j - i > 1]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            # The last bucket may go on in the next batch.
            bucket = table.column("bucket").to_numpy()
            cut = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if (bucket != bucket[-1]).any() else 0
            if cut:
                yield from pairs(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield from pairs(held)

    joined = rows.select("bucket", "node", "root").join(sketched.withColumnRenamed("n", "size"), "node").select("bucket", "node", "root", "size", "bits")
    return joined.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long").distinct()


def _linked(docs: DataFrame, near: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """Those of the pairs ``near(a, b)`` (a table) whose sets are similar enough, as a table."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, flat, sizes in shingle_sets(batch.column("text"), width):
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, len(sizes)), _list(flat.view(np.int64), sizes)], ["node", "grams"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for x, y in zip(batch.column("ga"), batch.column("gb"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, True))
                same.append(q * both >= p * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    nodes = stored(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    grams = stored(docs.join(sized(nodes), "node").select("node", "text").mapInArrow(sets, "node long, grams array<long>"))
    at_a, at_b = _ends(grams, "g")
    linked = stored(near.join(at_a, "a").join(at_b, "b").mapInArrow(compare, "a long, b long"))
    discard(docs.sparkSession, nodes, grams)
    return linked


def links(docs: DataFrame, width: int = WIDTH, p: int = P, q: int = Q) -> DataFrame:
    """Links ``(a, b)`` that make up the components of the exact join of ``docs(node, text)``.

    ``docs`` holds one row of each distinct set. Every pair of linked nodes is either returned or joined by
    a path of returned links.
    """
    spark, texts, found = docs.sparkSession, docs, None
    for level in range(LEVELS):
        buckets = stored(buckets_of(signature_rows(texts, width, p, q, level)))
        nodes = stored(buckets.select("node").distinct())
        discard(spark)  # the signatures' shuffle
        sketched = stored(_sketched(texts.join(sized(nodes), "node"), width))
        stars = buckets.select(F.col("low").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
        near = stored(_sifted(stars, sketched, p, q))
        new = _linked(texts, near, width, p, q)
        found = found.unionByName(new) if found else new
        open_ = stored(still_open(buckets, 2, found))
        discard(spark, buckets, nodes, near)
        near = stored(_met(open_.where(F.col("n") <= LARGE), sketched, p, q))
        found = found.unionByName(_linked(texts, near, width, p, q))
        large = open_.where(F.col("n") > LARGE)
        more = not large.isEmpty()
        if more:
            stars = stored(still_open(large.drop("root"), LARGE, found).select(F.col("node").alias("a"), F.col("low").alias("b")).distinct())
            more = not stars.isEmpty()
        discard(spark, open_, sketched, near, *([texts] if level else []))
        if not more:
            return found
        texts = stored(docs.join(sized(stored(stars.select(F.col("a").alias("node")).distinct())), "node"))
    return found.unionByName(_within_families(texts, stars, width, p, q))


def _within_families(docs: DataFrame, stars: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """Links ``(a, b)`` that join what is linked inside the components of ``stars(a, b)``."""
    family = stored(components(stars).select("node", F.col("root").alias("family")))
    wanted = docs.join(sized(family), "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, flat, sizes in shingle_sets(batch.column("text"), width):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(i, len(sizes)) for k in ("family", "node")] + [_list(flat.view(np.int64), sizes)],
                    ["family", "node", "grams"],
                )

    members = stored(wanted.select("family", "node", "text").mapInArrow(sets, "family long, node long, grams array<long>"))
    size = members.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    core = (
        members.select("family", F.explode("grams").alias("h"))
        .groupBy("family", "h")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(sized(size), "family")
        .where("2 * n > size")
        .groupBy("family")
        .agg(F.collect_list("h").alias("core"))  # at most twice the mean set size of the family
    )
    diff = stored(_differences(members.join(core, "family", "left").select("family", "node", "grams", "core"), p, q))
    level = F.when(F.col("e") > 0, F.length(F.bin("e"))).otherwise(0).cast("long")
    best = diff.groupBy("family").agg(
        F.min(F.struct("e", "node")).alias("best"), F.collect_set(level).alias("levels"), F.max("e").alias("e_max")
    )
    rated = diff.join(best, "family").withColumns(
        {
            "e_min": F.col("best.e"),
            "outlier": F.col("e") + F.col("best.e") > 0,
            "all_in": F.col("e_max") + F.col("best.e") <= 0,
        }
    )
    direct = rated.where("not outlier and node <> best.node").select(F.col("node").alias("a"), F.col("best.node").alias("b"))
    rest = rated.where("not all_in").select("family", "node", "e", "added", "removed", "levels", "e_min", "outlier")
    found = _prefixes(rest, p, q)
    left = found.where("side = 0").select("family", "la", "lb", "h", F.col("node").alias("a"), F.col("e").alias("ea"), "out")
    right = found.where("side = 1").select("family", "la", "lb", "h", F.col("node").alias("b"), F.col("e").alias("eb"), F.col("out").alias("out_b"))
    pairs = stored(
        left.join(right, ["family", "la", "lb", "h"])
        .where("a <> b and (la <> lb or a < b) and out + out_b > 0")
        .select("family", "a", "b", "ea", "eb")
        .distinct()
    )
    paired = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets_ = diff.join(sized(paired), "node", "left_semi").select("family", "node", F.concat("added", "removed").alias("d"))
    checked = (
        pairs.join(sets_.select("family", F.col("node").alias("a"), F.col("d").alias("da")), ["family", "a"])
        .join(sets_.select("family", F.col("node").alias("b"), F.col("d").alias("db")), ["family", "b"])
        .where(F.size(F.array_intersect("da", "db")) * F.lit(2 * (p + q)) >= F.col("ea") + F.col("eb"))
        .select("a", "b")
    )
    result = stored(direct.unionByName(checked))
    discard(docs.sparkSession, family, members, diff, pairs, paired)
    return result


def _several(feats: DataFrame) -> DataFrame:
    """``doc_id`` of the ids whose rows hold several sets."""
    of_id = feats.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id")
    return of_id.agg(F.min(F.struct("d1", "d2")).alias("lo"), F.max(F.struct("d1", "d2")).alias("hi")).where("lo <> hi").select("doc_id")


def _own_nodes(docs: DataFrame, feats: DataFrame, several: DataFrame, low: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes below every id for sets that only the ids of ``several`` hold: ``d1, d2, node``, their texts, and the edges of those ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(several, "doc_id", "left_semi")
    held = stored(features(rows, width, True).where("n_shingles > 0"))
    least = feats.agg(F.least(F.min("doc_id"), F.lit(0))).first()[0]
    loose = held.select("d1", "d2").distinct().join(low, ["d1", "d2"], "left_anti")
    loose = stored(loose.withColumn("node", F.lit(least) - 1 - F.monotonically_increasing_id()))
    texts = held.join(loose, ["d1", "d2"]).groupBy("node").agg(F.min("text").alias("text"))
    nodes = low.select("d1", "d2", "node").unionByName(loose)
    ends = held.join(nodes, ["d1", "d2"]).select("doc_id", "node").distinct()
    star = ends.groupBy("doc_id").agg(F.min("node").alias("b"))
    return loose, stored(texts), stored(ends.join(star, "doc_id").select(F.col("node").alias("a"), "b"))


def _grouped(docs: DataFrame, width: int, p: int, q: int) -> tuple[DataFrame, DataFrame]:
    """The ``features`` of the rows, and ``d1, d2, root`` of the sets that copies or links join to an id."""
    feats = stored(features(docs, width))
    several = stored(_several(feats))
    repeated = not several.isEmpty()
    single = feats.join(sized(several), "doc_id", "left_anti") if repeated else feats
    low = single.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    low = stored(low.where("node is not null"))
    # Rows other than the one that stands for its set: copies, and rows without a set or an id.
    copies = low.where("copies > 1").drop("copies")
    spare = single.where("n_shingles > 0").join(copies, ["d1", "d2"]).where("doc_id <> node").select(F.col("doc_id").alias("node"))
    spare = stored(spare.unionByName(several.select(F.col("doc_id").alias("node"))))
    own = docs.select(F.col("doc_id").cast("long").alias("node"), "text").where("node is not null").join(sized(spare), "node", "left_anti")
    if not repeated:
        joined = components(links(own, width, p, q)).where("root <> node")
        known = low
    else:
        loose, texts, edges = _own_nodes(docs, feats, several, low, width)
        joined = components(links(own.unionByName(texts), width, p, q).unionByName(edges))
        known = low.select("d1", "d2", "node").unionByName(loose)
    known = known.join(joined, "node", "left").select("d1", "d2", F.coalesce("root", "node").alias("root"), *(() if repeated else ("copies", "node")))
    if not repeated:  # a set of one row needs no entry unless it is linked
        known = known.where("copies > 1 or root <> node").drop("copies", "node")
    if repeated:  # the smallest node of a component need not be an id there
        known = stored(known)
        ids = feats.where("n_shingles > 0").join(known, ["d1", "d2"]).groupBy("root").agg(F.min("doc_id").alias("id"))
        known = known.join(ids, "root").select("d1", "d2", F.col("id").alias("root"))
    return feats, known


def jaccard_components(docs: DataFrame, width: int = WIDTH, p: int = P, q: int = Q) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs(doc_id, text, ...)``.

    Two documents link when ``q * |A & B| >= p * |A | B|``; ``component_id`` is the smallest doc_id
    that links reach. Null or wordless text: empty set, no link, its own id. Repeated rows link like
    any copies, and rows that repeat an id with other texts are one document, linked by any of them. A null
    doc_id gets the component of its text's documents, null if there are none. Extra columns are ignored,
    an empty table gives an empty result.
    """
    with arrow_rows(docs.sparkSession, AT_ONCE):
        feats, known = _grouped(docs, width, p, q)
    return feats.join(known, ["d1", "d2"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
