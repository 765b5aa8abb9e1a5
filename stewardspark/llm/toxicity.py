"""Toxicity: a convolutional text classifier in numpy.

Hashed word embeddings (a word adds up its own bucket and those of its beginnings, so unseen
compounds of known parts are not blank), filters of several widths, max pooling over the
whole text and a logistic output, trained by Adam on a bounded sample of labelled rows. Each
filter looks only at words near each other, and pooling keeps its strongest response, so a
text of any length is read slice by slice. The cut between toxic and clean is calibrated per language;
the language is guessed from the text's own words, never read from a column.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field as default

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import bounded_sample, column, field, held_out, with_results

# Labelled rows that the model is fitted on, half of each label where there are enough.
SAMPLE_ROWS = 4_000
BUCKETS = 1 << 15
DIMENSIONS = 16
WIDTHS = (1, 2, 3)
# Lengths of the word beginnings that have buckets of their own.
PREFIXES = (4, 5, 6, 7)
FILTERS = 8
EPOCHS = 6
BATCH = 16
# Words convolved at once, and words remembered by a task between batches.
SLICE = 100_000
REMEMBERED = 200_000

_WORD = re.compile(r"\w+")
_OVERLAP = max(WIDTHS) - 1


def _buckets(word: str) -> list[int]:
    """The word and its beginnings; 0 is the padding, beginnings it lacks included."""
    parts = [f"{word}>"] + [f"<{word[:n]}" if len(word) >= n else "" for n in PREFIXES]
    return [1 + zlib.crc32(p.encode("utf-8", "replace")) % (BUCKETS - 1) if p else 0 for p in parts]


class Words:
    """Numbers of words, and the buckets of each; number 0 is the padding."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.buckets: list[list[int]] = [[0] * (1 + len(PREFIXES))]

    def __call__(self, text: str | None) -> np.ndarray:
        found = _WORD.findall(text.lower()) if text else []
        ids = list(map(self.known.get, found))
        for k, number in enumerate(ids):
            if number is None:
                number = self.known.get(found[k])
                if number is None:
                    number = self.known[found[k]] = len(self.buckets)
                    self.buckets.append(_buckets(found[k]))
                ids[k] = number
        return np.array(ids, np.int32)


@dataclass
class Model:
    embed: np.ndarray
    filters: list[np.ndarray]  # per width: (width, dimensions, filters)
    offsets: list[np.ndarray]
    output: np.ndarray
    bias: float = 0.0
    languages: list[str] = default(default_factory=list)
    profile: np.ndarray = default(default_factory=lambda: np.zeros((BUCKETS, 1), np.float32))
    scale: float = 1.0
    cuts: np.ndarray = default(default_factory=lambda: np.zeros(1))

    def vectors(self, buckets: np.ndarray) -> np.ndarray:
        return self.embed[buckets].sum(axis=1)

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """Filter outputs per width at every position of a padded run of word vectors."""
        out = []
        for w, offset in zip(self.filters, self.offsets):
            n = len(x) - w.shape[0] + 1
            y = x[:n] @ w[0]
            for j in range(1, w.shape[0]):
                y += x[j : j + n] @ w[j]
            out.append(y + offset)
        return out

    def raw(self, x: np.ndarray) -> float:
        """Output before calibration for the word vectors of a text.

        Pooling keeps the strongest response of each filter, at least zero.
        """
        best = np.zeros(len(WIDTHS) * FILTERS, self.embed.dtype)
        pad = np.zeros((_OVERLAP, DIMENSIONS), self.embed.dtype)
        x = np.concatenate((pad, x, pad))
        for start in range(0, len(x) - _OVERLAP, SLICE):
            part = x[start : start + SLICE + _OVERLAP]
            best = np.maximum(best, np.concatenate([y.max(axis=0) for y in self.responses(part)]))
        return float(best @ self.output + self.bias)


class Scorer:
    """A model with the vectors of the words met so far."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.words, self.filled = Words(), 0
        self.vectors = np.zeros((1024, DIMENSIONS), np.float32)
        self.profile = np.zeros((1024, self.model.profile.shape[1]), np.float32)

    def parts(self, text: str | None) -> tuple[float, int]:
        """Raw output and guessed language of a text."""
        if len(self.words.buckets) > REMEMBERED:
            self.forget()
        ids = self.words(text)
        new = np.array(self.words.buckets[self.filled :], np.int32)
        if len(new):
            end = self.filled + len(new)
            while end > len(self.vectors):
                self.vectors = np.concatenate((self.vectors, np.zeros_like(self.vectors)))
                self.profile = np.concatenate((self.profile, np.zeros_like(self.profile)))
            self.vectors[self.filled : end] = self.model.vectors(new)
            self.profile[self.filled : end] = self.model.profile[new[:, 0]]
            self.filled = end
        raw = self.model.raw(self.vectors[ids])
        known = len(ids) and self.model.languages
        return raw, int(self.profile[ids].sum(axis=0, dtype=np.float64).argmax()) if known else 0

    def score(self, text: str | None) -> float:
        """Between 0 and 1, with the cut of the guessed language at one half."""
        raw, language = self.parts(text)
        z = self.model.scale * (raw - self.model.cuts[language])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class _Adam:
    def __init__(self, shape):
        self.m, self.v, self.t = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0

    def step(self, value, grad, rate):
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        value -= rate * fix * self.m / (np.sqrt(self.v) + 1e-7)


def train(texts: list[str], labels: list[int], langs: list[str | None], seed: int = 0) -> Model:
    """Fits on four fifths of the rows, calibrates the cuts on the rest.

    Without rows of both labels every text scores the same: 1 if all are toxic, else 0.
    """
    rng = np.random.default_rng(seed)
    reader = Words()
    docs = [reader(t) for t in texts]
    buckets = np.array(reader.buckets, np.int32)
    y = np.array(labels, float)
    model = Model(
        rng.normal(0, 0.3, (BUCKETS, DIMENSIONS)).astype(np.float32),
        [rng.normal(0, 0.2, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32),
    )
    model.embed[0] = 0
    if len(set(labels)) < 2:
        model.output[:] = 0
        model.bias = 20.0 if labels and labels[0] else -20.0
        return model
    order = rng.permutation(len(docs))
    unseen, seen = order[: len(order) // 5], order[len(order) // 5 :]
    weight = np.where(y == 1, 0.5 / max(y[seen].mean(), 1e-6), 0.5 / max(1 - y[seen].mean(), 1e-6))
    steps = [_Adam(p.shape) for p in (model.embed, *model.filters, *model.offsets, model.output)]
    bias_step = _Adam(())
    bias = np.zeros((), np.float32)
    for epoch in range(EPOCHS):
        rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
        shuffled = rng.permutation(seen)
        for at in range(0, len(shuffled), BATCH):
            model.bias = float(bias)
            grads = [np.zeros(s.m.shape, np.float32) for s in steps]
            bias_grad = 0.0
            for i in shuffled[at : at + BATCH]:
                bias_grad += _backward(model, buckets[docs[i]], y[i], weight[i] / BATCH, grads)
            values = (model.embed, *model.filters, *model.offsets, model.output)
            _sparse(steps[0], values[0], grads[0], rate)
            for step, value, grad in zip(steps[1:], values[1:], grads[1:]):
                step.step(value, grad, rate)
            bias_step.step(bias, np.float32(bias_grad), rate)
    model.bias = float(bias)
    _profile(model, [buckets[docs[i], 0] for i in seen], [langs[i] for i in seen])
    _calibrate(model, [texts[i] for i in unseen], y[unseen])
    return model


def _sparse(step: _Adam, value: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """Adam on the rows that got a gradient only."""
    rows = np.flatnonzero(grad.any(axis=1))
    rows = rows[rows != 0]
    g = grad[rows]
    step.v[rows] = 0.9 * step.v[rows] + 0.1 * g * g
    value[rows] -= rate * g / (np.sqrt(step.v[rows]) + 1e-6)


def _backward(model: Model, words: np.ndarray, label: float, weight: float, grads: list) -> float:
    """Adds the gradient of one text (buckets per word).

    Only the position that won a filter learns from it.
    """
    pad = np.zeros((_OVERLAP, words.shape[1]), np.int32)
    words = np.concatenate((pad, words, pad))
    x = model.vectors(words)
    outs = model.responses(x)
    places = [y.argmax(axis=0) for y in outs]
    tops = [y[p, np.arange(FILTERS)] for y, p in zip(outs, places)]
    pooled = np.maximum(np.concatenate(tops), 0)
    z = float(pooled @ model.output + model.bias)
    error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
    grads[-1] += error * pooled
    back = error * model.output * (pooled > 0)
    for k, w in enumerate(model.filters):
        g = back[k * FILTERS : (k + 1) * FILTERS]
        for f in np.flatnonzero(g):
            window = slice(places[k][f], places[k][f] + w.shape[0])
            grads[1 + k][:, :, f] += g[f] * x[window]
            np.add.at(grads[0], words[window], g[f] * w[:, None, :, f])
        grads[1 + len(WIDTHS) + k] += g
    return error


def _profile(model: Model, docs: list[np.ndarray], langs: list[str | None]) -> None:
    """Smoothed log frequency of word buckets per language."""
    model.languages = sorted({v for v in langs if v is not None})
    if not model.languages:
        return
    counts = np.full((BUCKETS, len(model.languages)), 0.1)
    for ids, lang in zip(docs, langs):
        if lang is not None:
            counts[:, model.languages.index(lang)] += np.bincount(ids, minlength=BUCKETS)
    model.profile = np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _best_cut(raw: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the most right answers, by F1."""
    order = np.argsort(raw)
    raw, y = raw[order], y[order]
    cuts = np.concatenate(([raw[0] - 1], (raw[1:] + raw[:-1]) / 2, [raw[-1] + 1]))
    hit = np.concatenate((np.cumsum(y[::-1])[::-1], [0]))  # toxic rows above each cut
    chosen = np.arange(len(raw), -1, -1)
    f1 = 2 * hit / np.maximum(chosen + y.sum(), 1)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    gap = np.concatenate(([0], np.diff(raw), [0]))
    return float(cuts[best[gap[best].argmax()]])


def _calibrate(model: Model, texts: list[str | None], y: np.ndarray) -> None:
    """A cut per guessed language, drawn towards the common cut where rows are few."""
    model.cuts = np.zeros(max(1, len(model.languages)))
    if len(texts) == 0 or len(set(y)) < 2:
        return
    scorer = Scorer(model)
    found = [scorer.parts(t) for t in texts]
    raw, lang = np.array([r for r, _ in found]), np.array([k for _, k in found])
    common = _best_cut(raw, y)
    for k in range(len(model.cuts)):
        own = lang == k
        toxic = int(y[own].sum())
        if toxic and toxic < own.sum():
            trust = toxic / (toxic + 20)
            model.cuts[k] = trust * _best_cut(raw[own], y[own]) + (1 - trust) * common
        else:
            model.cuts[k] = common
    side = model.cuts[lang]
    model.scale = min(
        np.geomspace(0.1, 10, 30),
        key=lambda s: np.logaddexp(0, np.where(y == 1, -1, 1) * s * (raw - side)).mean(),
    )


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
    lang: str = "lang", label: str = "toxic", sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """A model from at most about ``sample_rows`` labelled rows outside the held-out fold.

    The language only steers the calibration; a null one is left out of it.
    """
    marked = labels.where(~held_out(doc_id) & column(label).isNotNull()).select(
        column(doc_id).alias("i"), column(label).cast("int").alias("y")
    ).dropDuplicates(["i"])
    chosen = bounded_sample(marked, F.col("y"), sample_rows, [F.col("i"), F.col("y")], F.col("i"))
    if not chosen:
        return train([], [], [])
    spark = docs.sparkSession
    # At most twice sample_rows ids and labels: small enough to send to every task.
    small = F.broadcast(spark.createDataFrame(chosen, marked.schema))
    rows = (
        docs.select(column(doc_id).alias("i"), column(text).alias("t"), column(lang).alias("l"))
        .join(small, "i").limit(2 * sample_rows).collect()
    )
    rows.sort(key=lambda r: (str(r["i"]), r["t"] or "", r["l"] or ""))
    return train([r["t"] for r in rows], [r["y"] for r in rows], [r["l"] for r in rows])


def rate(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``row`` with ``score`` (0 to 1) and ``predicted`` (1 from a score of one half).

    A null text is read as empty; an empty text gets the score of a text without words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(row):
        scorer = Scorer(shared.value)
        score = [scorer.score(t) for t in field(row, text)]
        return [pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())]

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return with_results(docs, scores, fields)
