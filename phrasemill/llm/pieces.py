"""Sampled SentencePiece segmentation by forward filtering and backward sampling, and lossless decoding.

The text is written with ``▁`` for spaces after one dummy space, as the piece model does. A segmentation is
a path through the lattice of pieces; its weight is the product of piece probabilities, here a Zipf law of
the piece's rank, ``p ~ 1 / (rank + 3) ** alpha``. A character may also be spelled by its UTF-8 byte
pieces. Forward sums ``a[j] = sum_i a[i] p(i, j)`` give the exact posterior of the last piece before each
position, from which pieces are drawn backwards.

No piece crosses the start of a run of spaces or touches a line end, so the lattice falls apart there
and the words between are sampled on their own; the tables of a word are built once per batch of texts. Each
draw is a counter-based hash of the row key and its position, so a row's result depends on neither batch,
partition nor retry.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
CHUNK = 1 << 18
SPACE = 0x2581
#: Stands for a literal ▁ of the text: no piece has it, so that decoding can tell it from a space.
OWN_MARK = 0x110000
_SPLIT = re.compile(r" *[^ \n]+| +|\n")
_U = np.uint64


class Pieces:
    """The pieces of a SentencePiece model: ids, log weights, byte pieces, and what each id spells."""

    def __init__(self, model: bytes, alpha: float = ALPHA) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, int] = {}
        self.bytes_ = [-1] * 256
        self.spelling = [b""] * sp.get_piece_size()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_[int(piece[3:5], 16)] = i
                self.spelling[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.spelling[i] = piece.replace("▁", " ").encode()
        if min(self.bytes_) < 0:
            raise ValueError("the model has no byte pieces, so that not every text can be spelled")
        if any(re.search(r"[^▁]▁", p) or len(p) > 1 and "\n" in p for p in self.ids):
            raise ValueError("pieces of this model cross words")
        weights = (np.arange(sp.get_piece_size()) + 3.0) ** -alpha
        self.log = np.log(weights / weights.sum())
        self._trie()
        # Beyond the pieces come the byte spellings of characters, in the order in which they are met.
        self.raw_of = np.full(OWN_MARK + 1, -1, np.int32)
        self.raw: list[bytes] = []

    def spelled(self, code: np.ndarray) -> np.ndarray:
        """What spells each character by its bytes: numbers beyond the pieces."""
        if (self.raw_of[code] < 0).any():
            for c in np.unique(code[self.raw_of[code] < 0]).tolist():
                self.raw_of[c] = len(self.log) + len(self.raw)
                self.raw.append(b" " if c == SPACE else "▁".encode() if c == OWN_MARK else chr(c).encode("utf-8", "surrogatepass"))
        return self.raw_of[code]

    def log_of(self) -> np.ndarray:
        return np.concatenate([self.log, [sum(self.log[self.bytes_[b]] for b in r) for r in self.raw]])

    def emitted(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids that each piece and each byte spelling emits, and all these ids."""
        length = np.concatenate([np.ones(len(self.log), np.int64), [len(r) for r in self.raw]]).astype(np.int64)
        return length, np.concatenate([np.arange(len(self.log)), [self.bytes_[b] for r in self.raw for b in r]]).astype(np.int32)

    def _trie(self) -> None:
        """Nodes of the piece trie: ``ends`` has the piece of a node or -1; children by node and character."""
        at: dict[str, int] = {"": 0}
        for piece in self.ids:
            for k in range(1, len(piece) + 1):
                at.setdefault(piece[:k], len(at))
        self.ends = np.full(len(at), -1, np.int32)
        # Characters below 256 and the space mark have a dense table, others a sorted list of (node, character).
        self.dense = np.full((len(at), 257), -1, np.int32)
        rare = []
        for prefix, node in at.items():
            self.ends[node] = self.ids.get(prefix, -1)
            if prefix:
                c = ord(prefix[-1])
                if c < 256 or c == SPACE:
                    self.dense[at[prefix[:-1]], min(c, 256)] = node
                else:
                    rare.append((at[prefix[:-1]] << 21 | c, node))
        rare.sort()
        self.rare = np.array([r[0] for r in rare] or [-1], np.int64)
        self.rare_node = np.array([r[1] for r in rare] or [-1], np.int32)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The child of each node under each character, or -1."""
        near = (code < 256) | (code == SPACE)
        out = self.dense[node, np.minimum(code, 256)]
        if not near.all():
            far = np.flatnonzero(~near)
            key = node[far].astype(np.int64) << 21 | code[far]
            i = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
            out[far] = np.where(self.rare[i] == key, self.rare_node[i], -1)
        return out


@lru_cache(maxsize=4)
def load(model: bytes, alpha: float) -> Pieces:
    return Pieces(model, alpha)


@lru_cache(maxsize=1)
def lexicon_of(model: bytes, alpha: float) -> Lexicon:
    return Lexicon(load(model, alpha))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables(words: list[str], pieces: Pieces) -> tuple[np.ndarray, ...]:
    """Backward-sampling tables of distinct words.

    A state is a position of a word; ``final`` is each word's last. The edges into a state start at ``begin``;
    ``cum`` sums up their shares of its forward weight. ``prev`` is the state an edge leads back to, -1 at the
    word's start; ``seq`` what it emits: a piece or, beyond the pieces, the byte spelling of a character.
    Returns ``final, begin, cum, prev, seq``.
    """
    length = np.array([len(w) for w in words])
    final = np.cumsum(length) - 1
    first = final - length + 1
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    code = np.where(code == SPACE, OWN_MARK, np.where(code == 32, SPACE, code)).astype(np.int32)
    n = len(code)
    pos = (np.arange(n) - np.repeat(first, length)).astype(np.int32)
    left = np.repeat(length, length).astype(np.int32) - pos
    # Walk the trie from every position at once until all walks have died.
    state, start, seq = [], [], []
    every = np.arange(n, dtype=np.int32)
    at, node, depth = every, np.zeros(n, np.int32), 0
    while len(at):
        node = pieces.step(node, code[at + depth])
        on = node >= 0
        at, node = at[on], node[on]
        depth += 1
        hit = pieces.ends[node] >= 0
        state.append(at[hit] + depth - 1)
        start.append(at[hit])
        seq.append(pieces.ends[node[hit]])
        on = left[at] > depth
        at, node = at[on], node[on]
    which = pieces.spelled(code)
    # Long pieces first: they are the likely ones, and a draw probes its edges in this order.
    state_, start_ = np.concatenate([*state[::-1], every]), np.concatenate([*start[::-1], every])
    seq_ = np.concatenate([*seq[::-1], which])
    log = pieces.log_of()[seq_]
    order = np.argsort(state_, kind="stable")
    state_, start_, seq_, log = state_[order], start_[order], seq_[order], log[order]
    prev = np.where(pos[start_] > 0, start_ - 1, -1)
    cum, forward = np.zeros(len(state_)), np.zeros(n + 1)  # forward[-1] is the start of every word
    deep = pos[state_]
    turn = np.argsort(deep.astype(np.uint16) if deep.max() < 1 << 16 else deep, kind="stable")
    edge_stops = np.cumsum(np.bincount(deep))
    for a, b in zip(np.concatenate([[0], edge_stops[:-1]]), edge_stops, strict=True):
        own = turn[a:b]
        into = state_[own]
        heads = np.flatnonzero(np.concatenate([[True], into[1:] != into[:-1]]))
        size = np.diff(np.append(heads, len(own)))
        mass = forward[prev[own]] + log[own]
        top = np.maximum.reduceat(mass, heads)
        mass = np.exp(mass - np.repeat(top, size))
        total = np.add.reduceat(mass, heads)
        run = np.cumsum(mass)
        run = (run - np.repeat(run[heads] - mass[heads], size)) / np.repeat(total, size)
        cum[own] = run
        cum[own[heads + size - 1]] = 2.0
        forward[into[heads]] = top + np.log(total)
    begin = np.cumsum(np.bincount(state_, minlength=n)) - np.bincount(state_, minlength=n)
    return final, begin, cum, prev, seq_.astype(np.int32)


class Lexicon:
    """Tables of the words met so far in this process, up to ``LIMIT`` states; later words last for one run."""

    LIMIT = 1 << 18

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.index: dict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.tables = (*(np.empty(0, np.int64) for _ in range(2)), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int32))

    def look_up(self, texts: list[list[str]]) -> tuple[np.ndarray, tuple]:
        """The table numbers of all words, and the tables that hold them."""
        known = len(self.index)
        words = [np.fromiter(map(self.index.__getitem__, own), np.int64, len(own)) for own in texts]
        found = np.concatenate(words) if words else np.empty(0, np.int64)
        tables = self.tables
        if len(self.index) > known:
            new = list(islice(self.index, known, None))
            final, begin, cum, prev, seq = _tables(new, self.pieces)
            n = len(tables[1])
            more = (final + n, begin + len(tables[2]), cum, np.where(prev >= 0, prev + n, -1), seq)
            tables = tuple(map(np.concatenate, zip(tables, more, strict=True)))
            if len(tables[1]) < self.LIMIT:
                self.tables = tables
            else:
                for w in new:
                    del self.index[w]
        return found, tables


def sample(texts: list[str], keys: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Flat piece ids of all texts and the number per text; keys are 64-bit row keys."""
    split = [_SPLIT.findall(" " + text) if text else [] for text in texts]
    per = np.array([len(own) for own in split], np.int64)
    found, (final, begin, cum, prev, seq) = lexicon.look_up(split)
    if not len(found):
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    state, pieces = final[found], lexicon.pieces
    doc = np.repeat(np.arange(len(texts)), per)
    first = np.cumsum(per) - per
    seed = _mix(keys.astype(np.int64).view(np.uint64) + _U(0x9E3779B97F4A7C15))
    salt = _mix(seed[doc] + (np.arange(len(doc)) - first[doc]).astype(np.uint64) * _U(0xD1B54A32D192ED03))
    live, drawn, owner, step = np.arange(len(state)), [], [], 0
    while len(live):
        u = (_mix(salt + _U(step)) >> _U(34)).astype(np.float64) * 2.0**-30
        edge = begin[state]
        over = np.flatnonzero(cum[edge] <= u)
        while len(over):
            edge[over] += 1
            over = over[cum[edge[over]] <= u[over]]
        drawn.append(seq[edge])
        owner.append(live)
        state = prev[edge]
        on = state >= 0
        state, salt, live = state[on], salt[on], live[on]
        step += 1
    # Pieces were drawn from the end of each word: order by word, then by falling step.
    who = np.concatenate(owner)
    rank = np.concatenate([np.full(len(o), -k) for k, o in enumerate(owner)])
    count = np.bincount(who, minlength=len(doc))
    start = np.cumsum(count) - count
    place = start[who] + count[who] - 1 + rank
    ordered = np.empty(len(who), np.int64)
    ordered[place] = np.concatenate(drawn)
    length, flat = pieces.emitted()
    at, n = np.cumsum(length) - length, length[ordered]
    ids = flat[np.repeat(at[ordered], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    by_word = np.bincount(np.repeat(np.arange(len(doc)), count), length[ordered], len(doc)).astype(np.int64)
    return ids, np.bincount(doc, by_word, len(texts)).astype(np.int64)


def spell(ids: np.ndarray, pieces: Pieces) -> str:
    """The text of a list of piece ids."""
    raw = b"".join(map(pieces.spelling.__getitem__, ids.tolist()))
    return raw.decode("utf-8", "surrogatepass")[1:]


def _lengths(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``CHUNK`` bytes."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        size += n
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, alpha: float = ALPHA, check: str = "") -> DataFrame:
    """``docs`` with ``pieces``, an array of ids sampled under a seed made of ``key``.

    Null text gives null pieces, empty text an empty array; a null key seeds as 0. Rows with the same key
    and text get the same pieces. A column named ``pieces`` is replaced; other columns are carried along.
    ``check`` names a boolean column that tells whether the pieces, decoded, are the text (null for null).
    """
    data = Path(model).read_bytes()  # travels with the function; workers need no file
    rest = docs.drop("pieces", *[check] * bool(check))
    seed = F.coalesce(F.xxhash64(key), F.lit(0)).alias("__seed")
    names = rest.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema] + ["pieces array<int>"] + [f"`{check}` boolean"] * bool(check))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon_of(data, alpha)
        for batch in batches:
            seeds = batch.column("__seed").to_numpy()
            for a, b in _lengths(batch.column(text)):
                raw = batch.column(text).slice(a, b - a).to_pylist()
                own, null = [t or "" for t in raw], [t is None for t in raw]
                ids, per = sample(own, seeds[a:b], known)
                offsets = np.zeros(b - a + 1, np.int32)
                np.cumsum(per, out=offsets[1:])
                more = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=pa.array(null))]
                if check:
                    same = [spell(ids[i:j], known.pieces) == t for t, i, j in zip(own, offsets, offsets[1:], strict=False)]
                    more.append(pa.array(same, pa.bool_(), mask=np.array(null)))
                yield pa.RecordBatch.from_arrays([batch.column(n).slice(a, b - a) for n in names] + more, [*names, "pieces", *[check] * bool(check)])

    return rest.select("*", seed).mapInArrow(run, schema)


def decode(docs: DataFrame, pieces: str = "pieces", into: str = "decoded", model: str = MODEL) -> DataFrame:
    """``docs`` with ``into``, the text that ``pieces`` spell; null for null. Lossless for ``encode``."""
    data = Path(model).read_bytes()
    rest = docs.drop(into)
    names = rest.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema] + [f"`{into}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load(data, ALPHA)
        for batch in batches:
            lists = batch.column(pieces)
            texts = [spell(x.values.to_numpy(), known) if x.is_valid else None for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, into])

    return rest.mapInArrow(run, schema)


def segmented(docs: DataFrame, model: str = MODEL, alpha: float = ALPHA) -> DataFrame:
    """``doc_id, pieces, n_pieces, lossless`` of each row of ``docs(doc_id, text, ...)``.

    ``lossless``: whether the decoded pieces equal the text (null for a null text).
    """
    out = encode(docs.select("doc_id", "text"), model=model, alpha=alpha, check="lossless")
    return out.select("doc_id", "pieces", F.size("pieces").cast("long").alias("n_pieces"), "lossless")
