"""Language identification in two steps: the language family, then one-versus-one linear SVMs inside it.

Features are relative frequencies of hashed letter bigrams and trigrams of the lower-cased text (anything
but letters counts as a gap). The family comes from one-versus-rest linear SVMs over families, the
language from a vote of the family's pairwise SVMs. All SVMs are fitted in numpy by dual coordinate
descent on a bounded sample of labelled rows; prediction maps over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: ISO 639-1 codes of closely related languages. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
}
DIM = 4096
#: Bound of the training sample, per language.
SAMPLE_PER_LANG = 600
#: Bound of the languages that are learned: the commonest labels. Rows of others are predicted all the same.
MAX_LANGS = 200
CHUNK = 1 << 18


def family_of(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes.split()), f"only {lang}")


_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code point to itself if it is a letter, else to 0."""
    if not _letters:
        _letters.append(np.fromiter((i if chr(i).isalpha() else 0 for i in range(0x110000)), np.uint32, 0x110000))
    return _letters[0]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed grams of joined texts, the gram count of each text and its number of letters."""
    # Lower-casing may change a text's length, so lengths are taken after it; two gaps end every text, one is first.
    low = [t.lower() for t in texts]
    ends = np.cumsum([len(t) + 2 for t in low]) + 1
    joined = " " + "  ".join(low) + "  "
    code = _letter_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    h = code * np.uint32(0x9E3779B1)
    two = h[:-1] * np.uint32(31) + code[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(31) + code[2:] * np.uint32(0xC2B2AE35)
    live = code[1:-1] > 0
    # A gram is kept if its second character is a letter: it never spans two words.
    at = np.flatnonzero(live)
    doc = np.searchsorted(ends, at + 1, side="right")
    shift = np.uint32(32 - DIM.bit_length() + 1)
    grams = np.concatenate([(two[at] * np.uint32(0x27D4EB2F)) >> shift, (three[at] * np.uint32(0x165667B1)) >> shift])
    letters = np.bincount(doc, minlength=len(texts))
    return grams, np.concatenate([doc, doc]), letters


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``CHUNK`` characters and at most 256 rows."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or i + 1 - start >= 256:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def vectors(texts: list[str]) -> np.ndarray:
    """Square-rooted relative frequencies: rows of unit length, or 0 without letters."""
    out = np.zeros((len(texts), DIM), np.float32)
    for a, b in _runs(texts):
        grams, doc, letters = _grams(texts[a:b])
        count = np.bincount(doc * DIM + grams, minlength=(b - a) * DIM).reshape(b - a, DIM)
        out[a:b] = np.sqrt(count / np.maximum(2 * letters, 1)[:, None])
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, cost: float = 8.0, epochs: int = 30) -> tuple[np.ndarray, float, float]:
    """Weights, bias and slope of an L2-loss linear SVM on ``rows`` of ``x`` (all if None), by dual coordinate descent.

    Classes weigh alike. The slope turns margins into probabilities; it is a one-parameter logistic fit. ``x`` is not
    copied.
    """
    rows = np.arange(len(x)) if rows is None else rows
    n = len(y)
    each = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum()))) * cost
    # The bias is the weight of a feature that is always 1.
    w, bias, alpha = np.zeros(x.shape[1], np.float64), 0.0, np.zeros(n)
    diag = 0.5 / each
    curve = np.array([x[r] @ x[r] for r in rows], np.float64) + 1 + diag
    rng = np.random.Generator(np.random.PCG64(7))
    for _ in range(epochs):
        for i in rng.permutation(n):
            own = x[rows[i]]
            g = y[i] * (own @ w + bias) - 1 + diag[i] * alpha[i]
            new = max(alpha[i] - g / curve[i], 0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += step * own
                bias += step
                alpha[i] = new
    margin, slope = y * (np.array([x[r] @ w for r in rows]) + bias), 1.0
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(slope * margin, -30, 30)))
        slope = float(np.clip(slope + (p * margin).sum() / max((p * (1 - p) * margin**2).sum(), 1e-6), 0.5, 8.0))
    return w.astype(np.float32), float(bias), slope


@dataclass
class LanguageModel:
    """Linear classifiers: one per family (none for a single family), one per pair inside a family."""

    families: dict[str, list[str]] = field(default_factory=dict)
    family_svm: dict[str, tuple] = field(default_factory=dict)
    pair_svm: dict[tuple[str, str], tuple] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> LanguageModel:
        own, model = np.array(langs), cls()
        for lang in sorted(set(langs)):
            model.families.setdefault(family_of(lang), []).append(lang)
        fam = np.array([family_of(g) for g in langs])
        if len(model.families) > 1:
            for name in model.families:
                model.family_svm[name] = fit_svm(x, np.where(fam == name, 1.0, -1.0))
        for members in model.families.values():
            for a, b in combinations(members, 2):
                rows = np.flatnonzero((own == a) | (own == b))
                model.pair_svm[a, b] = fit_svm(x, np.where(own[rows] == a, 1.0, -1.0), rows)
        return model

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` and 0 without letters or without a learned language."""
        svms = [*self.family_svm.values(), *self.pair_svm.values()]
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.families:
            return lang, score
        w = np.stack([s[0] for s in svms], 1) if svms else np.zeros((DIM, 1), np.float32)
        bias, slope = np.array([s[1] for s in svms] or [0.0]), np.array([s[2] for s in svms] or [1.0])
        for a, b in _runs(texts):
            grams, doc, letters = _grams(texts[a:b])
            # sum of w * sqrt(count): counts of (text, gram) cells of this run
            count = np.bincount(doc * DIM + grams, minlength=(b - a) * DIM).reshape(b - a, DIM)
            x = np.sqrt(count.astype(np.float32) / np.maximum(2 * letters, 1).astype(np.float32)[:, None])
            prob = 1 / (1 + np.exp(-np.clip((x @ w + bias) * slope, -30, 30)))
            for i in np.flatnonzero(letters):
                lang[a + i], score[a + i] = self._decide(prob[i])
        return lang, score

    def _decide(self, prob: np.ndarray) -> tuple[str, float]:
        n_fam = len(self.family_svm)
        names = list(self.families)
        share = prob[:n_fam] / max(prob[:n_fam].sum(), 1e-9) if n_fam else np.ones(1)
        at = int(np.argmax(share))
        members = self.families[names[at]]
        wins = {g: [0.0, 0.0] for g in members}
        for (a, b), p in zip(self.pair_svm, prob[n_fam:], strict=False):
            if a in wins:
                wins[a][0] += p >= 0.5
                wins[b][0] += p < 0.5
                wins[a][1] += p
                wins[b][1] += 1 - p
        best = max(members, key=lambda g: (wins[g], g))
        inside = wins[best][1] / (len(members) - 1) if len(members) > 1 else 1.0
        return best, float(np.clip(share[at] * inside, 0.0, 1.0))


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null and lang is not null")


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, most: int = MAX_LANGS) -> LanguageModel:
    """A model from at most ``per_lang`` rows of each of the ``most`` commonest languages of ``docs(doc_id, text, lang)``.

    The sample is what comes first by a hash of doc_id and text; only feature vectors reach the driver. Texts
    without letters are passed over. No labelled row gives a model that predicts ``und`` everywhere.
    """
    counts = {r[0]: r[1] for r in _labelled(docs).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()}
    if not counts:
        return LanguageModel()
    # A few more than are wanted, since a hash doesn't draw the exact number; the first of them are taken.
    share = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, min(1.0, (1.2 * per_lang + 50) / n))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    drawn = _labelled(docs).withColumn("draw", draw).where(F.col("draw") < share[F.col("lang")] * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _runs(texts):
                x = [v.tobytes() if v.any() else None for v in vectors(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, b - a), batch.column("draw").slice(a, b - a), pa.array(x, pa.binary())], ["lang", "draw", "x"])

    rows = drawn.select("lang", "draw", "text").mapInArrow(run, "lang string, draw long, x binary").where("x is not null")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "x"))
    sample = rows.withColumn("place", first).where(F.col("place") <= per_lang).orderBy("lang", "place").select("lang", "x").toArrow()
    if not sample.num_rows:
        return LanguageModel()
    data = sample.column("x").combine_chunks()
    start = np.frombuffer(data.buffers()[1], np.int32)[data.offset]
    x = np.frombuffer(data.buffers()[2], np.float32, sample.num_rows * DIM, start).reshape(-1, DIM)
    return LanguageModel.fit(x, sample.column("lang").to_pylist())


def predict(docs: DataFrame, model: LanguageModel, pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with two columns more, from its column ``text``; columns of these names are replaced."""
    rest = docs.drop(pred, score)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema] + [f"`{pred}` string", f"`{score}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, p = model.predict([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(p, pa.float64())], [*batch.schema.names, pred, score])

    return rest.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; false for a null id, which is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> LanguageModel:
    """The model of the rows that are not held out."""
    return fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0), per_lang)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row of ``docs(doc_id, text, lang, ...)``.

    Null text and text without a letter: ``und``, score 0. Null languages are not learned. Repeated rows
    are predicted alike. An empty table gives an empty result; other columns are ignored.
    """
    out = predict(docs.select("doc_id", "text"), learned(docs), "lang_pred", "score")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
