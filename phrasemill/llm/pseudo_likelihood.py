"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token is predicted from ``WINDOW`` tokens on each side; a document's score is the sum of the
conditional log-probabilities of all its tokens. The network embeds the context, has one tanh layer and a
two-step softmax (band of the vocabulary, then word of the band). It is trained here, in numpy:

* the vocabulary comes from word counts over all documents (counted per task, then summed by word); words
  beyond it share hashed buckets for the network, and a bucket's probability is dealt among its words by their
  counts (of the ``COMMON`` most frequent ones in every task, of all others from a table joined on the word; one
  count a bucket is kept for words that were never counted);
* every text is cut into words once more, to 16-bit ids that training and scoring read;
* each round, every task starts from the same parameters, masks one of ``ROUNDS`` parts of the positions of each
  of its documents, drawn by a hash of the ids, and takes gradient steps on them, so that all rounds together
  train on every position once; the tasks' parameters
  are averaged by their numbers of targets, first in ``FOLD`` partial means, then on the driver, which
  sees at most ``FOLD`` parameter vectors whatever the input;
* scoring maps over the ids of whole texts.

As tasks take their steps locally, the parameters (not the method) depend on how the rows are dealt to tasks: the
same files give the same scores, files written anew slightly different ones.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.common import arrow_rows, discard, sized, stored

WINDOW = 2
BANDS, WIDTH = 32, 64
VOCABULARY = BANDS * WIDTH
BUCKETS = 255
WORDS = VOCABULARY - BUCKETS - 1
#: The last id stands for what is beyond a text's ends.
EDGE = VOCABULARY - 1
EMBED, HIDDEN = 12, 16
ROUNDS, STEP, RATE = 2, 8192, 0.15
#: First steps of a task, which are an eighth as long.
WARM = 100
FOLD = 64
#: Words of a task's count before it is emptied.
MEMORY = 500_000
#: Words beyond the vocabulary whose counts every worker holds, and their longest: a bound of some tens of MB.
COMMON, LONGEST = 1_000_000, 40
#: Texts that are handed to Python at once.
AT_ONCE = 1000
#: Tokens that a task trains on or scores at once.
CHUNK = 1 << 17
_WORDS = re.compile(r"[^\W_]+|[^\w\s]|_")

SHAPES = {
    "embed": (VOCABULARY, EMBED),
    "mixer": (2 * WINDOW * EMBED, HIDDEN),
    "mixer_bias": (HIDDEN,),
    "band": (HIDDEN, BANDS),
    "band_bias": (BANDS,),
    "word": (BANDS, HIDDEN, WIDTH),
    "word_bias": (BANDS, WIDTH),
}


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def bucket(word: str) -> int:
    """The id of the bucket that a word beyond the vocabulary falls in."""
    return WORDS + zlib.crc32(word.encode()) % BUCKETS


@dataclass
class Network:
    """Parameters by name; forward and backward passes over arrays of contexts and targets."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 11) -> Network:
        rng = np.random.Generator(np.random.PCG64(seed))
        return cls({k: (rng.standard_normal(s) * (0.0 if "bias" in k else 0.1)).astype(np.float32) for k, s in SHAPES.items()})

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        p, at = {}, 0
        for k, s in SHAPES.items():
            p[k] = flat[at : at + int(np.prod(s))].reshape(s).astype(np.float32)
            at += int(np.prod(s))
        return cls(p)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in SHAPES])

    def _hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.p["embed"][context].reshape(len(context), -1)
        return x, np.tanh(x @ self.p["mixer"] + self.p["mixer_bias"])

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target in its context."""
        _, h = self._hidden(context)
        out = _log_softmax_at(h @ self.p["band"] + self.p["band_bias"], target // WIDTH)
        order = np.argsort((target // WIDTH).astype(np.uint8), kind="stable")
        ends = np.cumsum(np.bincount(target // WIDTH, minlength=BANDS))
        for band, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            if a < b:
                rows = order[a:b]
                out[rows] += _log_softmax_at(h[rows] @ self.p["word"][band] + self.p["word_bias"][band], target[rows] % WIDTH)
        return out

    def gradient(self, context: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean negative log-probability."""
        # In the order of bands, so that each band's rows are a slice.
        order = np.argsort((target // WIDTH).astype(np.uint8), kind="stable")
        context, target = context[order], target[order]
        n, p, own = len(target), self.p, target // WIDTH
        x, h = self._hidden(context)
        bounded, ones = _bounded(p), np.ones(n, h.dtype)
        d_band = _softmax_minus(h @ p["band"] + p["band_bias"], own, bounded) / n
        g = {"band": h.T @ d_band, "band_bias": ones @ d_band, "word": np.zeros(SHAPES["word"], np.float32), "word_bias": np.zeros(SHAPES["word_bias"], np.float32)}
        d_h = d_band @ p["band"].T
        ends = np.cumsum(np.bincount(own, minlength=BANDS))
        for band, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            if a < b:
                d = _softmax_minus(h[a:b] @ p["word"][band] + p["word_bias"][band], target[a:b] % WIDTH, bounded)
                d *= 1 / n
                g["word"][band], g["word_bias"][band] = h[a:b].T @ d, ones[a:b] @ d
                d_h[a:b] += d @ p["word"][band].T
        d_z = d_h * (1 - h * h)
        g["mixer"], g["mixer_bias"] = x.T @ d_z, ones @ d_z
        d_x = (d_z @ p["mixer"].T).reshape(-1, EMBED)
        flat = context.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        heads = np.flatnonzero(np.diff(flat[order], prepend=-1))
        g["embed"] = np.zeros(SHAPES["embed"], np.float32)
        g["embed"][flat[order][heads]] = np.add.reduceat(d_x[order], heads, axis=0)
        return g

    def train(self, context: np.ndarray, target: np.ndarray, seen: dict[str, np.ndarray]) -> None:
        """One Adagrad step; ``seen`` keeps the squared gradients."""
        for k, g in self.gradient(context, target).items():
            seen[k] = seen.get(k, 1e-6) + g * g
            self.p[k] -= RATE * g / np.sqrt(seen[k])


class Scorer:
    """Log-probabilities of runs of tokens. Each place's part of the first layer is tabled by token beforehand."""

    def __init__(self, net: Network) -> None:
        p = net.p
        mixer = p["mixer"].reshape(2 * WINDOW, EMBED, HIDDEN)
        self.part = [p["embed"] @ m for m in mixer]
        self.part[0] = self.part[0] + p["mixer_bias"]
        self.p = p
        self.shift = not _bounded(p)

    def __call__(self, flat: np.ndarray, at: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        """As ``log_probs`` of the windows of ``flat`` around the positions ``at``, which are ascending."""
        out = np.empty(len(at))
        for i in range(0, len(at), block):
            own = at[i : i + block]
            lo, hi = own[0] - WINDOW, own[-1] + WINDOW + 1
            run = flat[lo:hi]
            n = len(run) - 2 * WINDOW
            h = self.part[0][run[:n]]
            for k, part in zip([k for k in range(-WINDOW, WINDOW + 1) if k][1:], self.part[1:], strict=True):
                h += part[run[WINDOW + k : WINDOW + k + n]]
            h = np.tanh(h[own - own[0]])
            out[i : i + block] = self._of(h, flat[own])
        return out

    def _of(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        band, word = target // WIDTH, target % WIDTH
        out = self._at(h @ self.p["band"] + self.p["band_bias"], band)
        order = np.argsort(band.astype(np.uint8), kind="stable")
        h, word = h[order], word[order]
        inside = np.empty(len(target))
        ends = np.cumsum(np.bincount(band, minlength=BANDS))
        for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            if a < b:
                inside[a:b] = self._at(h[a:b] @ self.p["word"][k] + self.p["word_bias"][k], word[a:b])
        out[order] += inside
        return out

    def _at(self, logits: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.shift:
            return _log_softmax_at(logits, at)
        chosen = logits[np.arange(len(at)), at].astype(np.float64)
        return chosen - np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], np.float32))


def _log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    logits -= logits.max(1, keepdims=True)
    chosen = logits[np.arange(len(at)), at].astype(np.float64)
    return chosen - np.log(np.exp(logits, out=logits).sum(1))


def _softmax_minus(logits: np.ndarray, at: np.ndarray, bounded: bool) -> np.ndarray:
    """Softmax of each row less the indicator of its place ``at``, in place; bounded logits need no shift."""
    if not bounded:
        logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits *= (1 / (logits @ np.ones(logits.shape[1], logits.dtype)))[:, None]
    logits[np.arange(len(at)), at] -= 1
    return logits


def _bounded(p: dict[str, np.ndarray]) -> bool:
    """Whether no logit can be so large that its exponential overflows."""
    top = max(float(np.abs(p["band"]).sum(0).max() + np.abs(p["band_bias"]).max()), float(np.abs(p["word"]).sum(1).max() + np.abs(p["word_bias"]).max()))
    return top <= 80


def padded(ids: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first row, padded ids, positions of tokens in them, number of tokens per row)`` for runs of about ``CHUNK`` tokens."""
    ids = ids.cast(pa.large_binary())
    offsets = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] // 2
    data = np.frombuffer(ids.buffers()[2] or b"", np.uint16)
    i = 0
    while i < len(ids):
        j = min(len(ids), max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1))
        per = np.diff(offsets[i : j + 1])
        at = np.arange(per.sum()) + WINDOW * (1 + np.repeat(np.arange(j - i), per))
        flat = np.full(len(at) + WINDOW * (j - i + 1), EDGE, np.int64)
        flat[at] = data[offsets[i] : offsets[j]]
        yield i, flat, at, per
        i = j


def around(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    return flat[at[:, None] + np.array([k for k in range(-WINDOW, WINDOW + 1) if k])]


def drawn(ids: list[bytes], per: np.ndarray, round_: int, rounds: int = ROUNDS) -> np.ndarray:
    """Which tokens of the rows a round trains on; each belongs to one of ``rounds`` rounds."""
    salt = np.repeat(np.array([zlib.crc32(x) for x in ids], np.uint64), per)
    place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    draw = (salt + place.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (draw >> np.uint64(40)) % np.uint64(rounds) == round_


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` over all rows; every task counts first and empties its counter when it is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = Counter()
        _release()  # a worker outlives the query before

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counter), pa.string()), pa.array(list(counter.values()), pa.int64())], ["word", "n"])
            counter.clear()
            return batch

        for batch in batches:
            for value in batch.column(text):
                counter.update(words(value.as_py() or ""))
                if len(counter) > MEMORY:
                    yield emit()
        yield emit()

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """``common``: counts of the most frequent words beyond the vocabulary, if above 1; ``rare``: ``word, n`` of the others that were
    counted more than once, if there are any; ``totals``: counts of each bucket."""

    vocabulary: list[str]
    flat: np.ndarray
    common: dict[str, int] = field(default_factory=dict)
    rare: DataFrame | None = None
    totals: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))


def lexicon(docs: DataFrame, text: str = "text") -> Model:
    """The words of all rows, and a network as initialised."""
    with arrow_rows(docs.sparkSession, AT_ONCE):
        counts = stored(count_words(docs, text))
    order = [F.desc("n"), "word"]
    vocabulary = [r.word for r in counts.orderBy(*order).limit(WORDS).collect()]
    model = Model(vocabulary, Network.new().flat())
    known = F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string"))  # at most WORDS rows
    others = counts.join(known, "word", "left_anti")
    top = others.where(F.col("n") > 1).where(F.length("word") <= LONGEST).orderBy(*order).limit(COMMON).toArrow()
    listed, n = top.column("word").to_pylist(), top.column("n").to_pylist()
    model.common = dict(zip(listed, n, strict=True))
    long = F.length("word") > LONGEST
    if len(listed) == COMMON and COMMON:  # words as frequent as the last one listed are told apart by name
        rest = others.where(long | (F.col("n") < n[-1]) | ((F.col("n") == n[-1]) & (F.col("word") > listed[-1])))
    else:
        rest = others.where(long) if COMMON else others
    rest = rest.where("n > 1")
    model.rare = None if rest.isEmpty() else rest
    for row in others.groupBy((F.crc32(F.col("word").cast("binary")) % BUCKETS).alias("bucket")).agg(F.sum("n").alias("n")).collect():
        model.totals[row.bucket] += row.n
    return model


def listed(vocabulary: list[str], common: dict[str, int]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The words, a line each, and each one's code; by code the network's id and the log count. The last code is that of other words."""
    ids = np.array([*range(len(vocabulary)), *map(bucket, common)], np.int64)
    n = np.concatenate([np.ones(len(vocabulary), np.int64), np.fromiter(common.values(), np.int64, len(common))])
    # Words of the same id and count share a code: far fewer codes than words.
    both, code = np.unique(n * VOCABULARY + ids, return_inverse=True)
    return "\n".join([*vocabulary, *common]), code.astype(np.int32), np.append(both % VOCABULARY, 0).astype(np.uint16), np.append(np.log(both // VOCABULARY), 0.0)


class _Held:
    """What a worker makes of the broadcast words, once: codes by word, which are one object a code, and by code the network's id and the log count."""

    def __init__(self, value: tuple[str, np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.value = value
        lines, code, self.net_id, self.log = value
        codes = list(range(len(self.log)))
        parts = (code[i : i + CHUNK].tolist() for i in range(0, len(code), CHUNK))
        self.place = dict(zip(lines.split("\n") if lines else [], map(codes.__getitem__, itertools.chain.from_iterable(parts)), strict=True))


_held: list[_Held] = []


def _holding(value: tuple[str, np.ndarray, np.ndarray, np.ndarray]) -> _Held:
    if not _held or _held[0].value is not value:
        _release()  # before the next one is made
        _held.append(_Held(value))
    return _held[0]


def _release() -> None:
    """A function of the module: the list that a pickled function names would be another one."""
    _held.clear()


def encoded(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, key, ids, more, words, times`` (a table): 16-bit ids of each row's tokens, the summed log counts of its
    common words, and how often it holds each of the other words beyond the vocabulary."""
    # Bounded by WORDS and COMMON words of at most LONGEST characters; workers keep what they make of it until another step begins.
    words_ = docs.sparkSession.sparkContext.broadcast(listed(model.vocabulary, model.common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _holding(words_.value)
        place, net_id, log = held.place, held.net_id, held.log
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            blobs, more, beyond = [], [], []
            for value in batch.column(text):
                own = words(value.as_py() or "")
                at = np.fromiter(map(place.get, own, itertools.repeat(-1)), np.int32, len(own))
                ids = net_id[at]
                others = np.flatnonzero(at < 0).tolist()
                if others:
                    ids[others] = [bucket(own[i]) for i in others]
                blobs.append(ids.tobytes())
                more.append(float(log[at].sum()))
                beyond.append(Counter([own[i] for i in others]))
            rows = pa.array(np.arange(row, row + len(blobs)))
            row += len(blobs)
            lists = pa.array([list(c) for c in beyond], pa.list_(pa.string())), pa.array([list(c.values()) for c in beyond], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, batch.column(key), pa.array(blobs, pa.binary()), pa.array(more, pa.float64()), *lists], ["row", key, "ids", "more", "words", "times"])

    kind = docs.schema[key].dataType.simpleString()
    with arrow_rows(docs.sparkSession, AT_ONCE):
        return stored(docs.select(key, text).mapInArrow(run, f"row long, `{key}` {kind}, ids binary, more double, words array<string>, times array<long>"))


def train(rows: DataFrame, model: Model, rounds: int = ROUNDS) -> None:
    """Trains the network of ``model`` on all positions of ``rows(ids)``. Without any token it stays as initialised."""
    for round_ in range(rounds):
        start = model.flat

        def run(batches: Iterator[pa.RecordBatch], start=start, round_=round_) -> Iterator[pa.RecordBatch]:
            _release()
            net, seen, total, taken = Network.of(start), {}, 0, 0
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def learn(last: bool) -> None:
                nonlocal taken
                while held:
                    size = STEP if taken >= WARM else STEP // 8
                    if not last and sum(len(t) for _, t in held) < size:
                        return
                    c, t = (np.concatenate(x) for x in zip(*held, strict=True)) if len(held) > 1 else held[0]
                    net.train(c[:size], t[:size], seen)
                    taken += 1
                    held[:] = [(c[size:], t[size:])] if len(t) > size else []

            for batch in batches:
                for first, flat, at, per in padded(batch.column("ids")):
                    at = at[drawn(batch.column("ids").slice(first, len(per)).to_pylist(), per, round_, rounds)]
                    if not len(at):
                        continue
                    at = np.random.Generator(np.random.PCG64(len(at))).permutation(at)
                    total += len(at)
                    for i in range(0, len(at), STEP):
                        held.append((around(flat, at[i : i + STEP]), flat[at[i : i + STEP]]))
                        learn(False)
            learn(True)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([net.flat().tobytes()], pa.binary())], ["n", "flat"])

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = 0.0, 0
            for batch in batches:
                for k, raw in zip(batch.column("n").to_pylist(), batch.column("flat"), strict=True):
                    total, n = total + k * np.frombuffer(raw.as_py(), np.float32).astype(np.float64), n + k
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], ["n", "flat"])

        schema = "n long, flat binary"
        parts = rows.select("ids").mapInArrow(run, schema).repartition(FOLD).mapInArrow(mean, schema).collect()
        n = sum(r.n for r in parts)
        if n:
            model.flat = sum(r.n / n * np.frombuffer(r.flat, np.float32).astype(np.float64) for r in sorted(parts, key=lambda r: (r.n, bytes(r.flat)))).astype(np.float32)


def score(rows: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``key, n_tokens, log_prob, mean_log_prob`` of each of the ``encoded`` rows; the mean is null without tokens."""
    start = model.flat
    # A word's share of its bucket is n / (total + 1), n being 1 for words that were never counted.
    below = np.concatenate([np.zeros(WORDS), np.log(model.totals + 1), [0.0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release()
        scorer = Scorer(Network.of(start))
        for batch in batches:
            sums, count = [np.empty(0)], [np.empty(0, np.int64)]
            for _, flat, at, per in padded(batch.column("ids")):
                logs = scorer(flat, at) - below[flat[at]]
                sums.append(np.bincount(np.repeat(np.arange(len(per)), per), logs, len(per)))
                count.append(per)
            total = np.concatenate(sums) + batch.column("more").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column(key), pa.array(np.concatenate(count)), pa.array(total)], ["row", key, "n_tokens", "log_prob"])

    kind = rows.schema[key].dataType.simpleString()
    scored = rows.select("row", key, "ids", "more").mapInArrow(run, f"row long, `{key}` {kind}, n_tokens long, log_prob double")
    if model.rare is not None:
        beyond = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
        shares = beyond.join(sized(model.rare), "word").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("more"))
        scored = scored.join(shares, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob")
    return scored.select(key, "n_tokens", "log_prob", mean)


def fit(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> Model:
    """Lexicon and trained network of all rows."""
    model = lexicon(docs, text)
    rows = encoded(docs.select(F.lit(0).alias("doc_id"), text), model, "doc_id", text)
    train(rows, model, rounds)
    discard(docs.sparkSession, rows)
    return model


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """The scores of ``docs(doc_id, text, ...)`` under a network trained on all of them.

    Null, empty and wordless texts: no token, log_prob 0, mean null. Repeated rows score alike but for the
    last digits of single precision (and weigh as often in training). An empty table gives an empty result; other columns are ignored.
    """
    model = lexicon(docs)
    rows = encoded(docs, model)
    train(rows, model)
    return score(rows, model)
