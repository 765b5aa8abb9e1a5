"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are byte n-grams inside words (a blank marks a word's edge). Training is mini-batch
stochastic gradient descent in numpy on a bounded sample; a temperature and a rejection
threshold are then calibrated on rows of the sample that the model has not seen. Since the
average and the last layer are linear, prediction sums one small row of logits per subword.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import bounded_sample, column, field, held_out, with_results

UNKNOWN = "und"
# Rows that the model is fitted on, spread evenly over the languages.
SAMPLE_ROWS = 4_000
BUCKET_BITS = 15
DIMENSIONS = 16
SIZES = (2, 3, 4)
EPOCHS = 6
# Share of rightly labelled unseen rows that the rejection threshold may turn away.
REJECTED_SHARE = 0.002
# Bytes turned into subwords at once; longer texts are added up slice by slice.
SLICE = 1 << 20

_LETTER = re.compile(r"[^\W\d_]")
# ASCII bytes other than letters become blanks; bytes beyond ASCII belong to letters.
_BLANKED = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _clean(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(_BLANKED) + b" "


def subwords(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams inside words, and where each starts."""
    data = np.frombuffer(raw, np.uint8)
    blank = np.concatenate(([0], np.cumsum(data == 32, dtype=np.int32)))
    buckets, starts = [], []
    code = np.zeros(len(data), np.uint64)
    for size in range(1, max(SIZES) + 1):
        keep = len(data) - size + 1
        if keep <= 0:
            break
        code = code[:keep] * np.uint64(257) + data[size - 1 :] + np.uint64(1)
        if size not in SIZES:
            continue
        inner = blank[size - 1 : size - 1 + keep] - blank[1 : 1 + keep]  # blanks strictly inside
        edges = blank[size : size + keep] - blank[:keep]
        at = np.flatnonzero((inner == 0) & (edges < 2))
        hashed = (code[at] * _MULTIPLIER) >> np.uint64(64 - BUCKET_BITS)
        buckets.append(hashed.astype(np.int32))
        starts.append(at)
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(starts)


def _slices(raw: bytes):
    """Slices of a cleaned text, cut at blanks where there is one."""
    start = 0
    while start < len(raw):
        end = min(len(raw), start + SLICE)
        if end < len(raw):
            cut = raw.rfind(b" ", start + 1, end)
            end = cut if cut > start else end
        yield raw[start : end + 1]
        start = end


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # bucket by language: embeddings times the last layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Calibrated class probabilities; each row depends on its own text alone."""
        total = np.zeros((len(texts), len(self.languages)))
        count = np.zeros(len(texts))
        chunk: list[tuple[int, bytes]] = []
        size = 0

        def flush():
            nonlocal chunk, size
            if not chunk:
                return
            ends = np.cumsum([len(raw) for _, raw in chunk])
            buckets, starts = subwords(b"".join(raw for _, raw in chunk))
            owner = np.array([k for k, _ in chunk])[np.searchsorted(ends, starts, "right")]
            count[:] += np.bincount(owner, minlength=len(texts))
            for c in range(total.shape[1]):
                total[:, c] += np.bincount(owner, self.logits[buckets, c], minlength=len(texts))
            chunk, size = [], 0

        for k, text in enumerate(texts):
            for raw in _slices(_clean(text)):
                chunk.append((k, raw))
                size += len(raw)
                if size >= SLICE:
                    flush()
        flush()
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 0) -> Model:
    """Fits on four fifths of the rows and calibrates on the rest.

    One language is predicted always; no rows at all give a model that only says ``und``.
    """
    languages = sorted(set(labels))
    k, width = len(languages), 1 << BUCKET_BITS
    if k == 0:
        return Model([], np.zeros((width, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    unseen = order[: len(order) // 5]
    seen = order[len(order) // 5 :]
    features = {i: np.unique(subwords(_clean(texts[i]))[0], return_counts=True) for i in seen}
    target = {i: languages.index(labels[i]) for i in range(len(texts))}
    embed = rng.normal(0, 0.1, (width, DIMENSIONS))
    layer, bias = rng.normal(0, 0.1, (DIMENSIONS, k)), np.zeros(k)
    for epoch in range(EPOCHS):
        rate = 2.0 * (1 - epoch / EPOCHS)
        for i in rng.permutation(seen):
            buckets, counts = features[i]
            if not len(buckets):
                continue
            share = counts / counts.sum()
            mean = share @ embed[buckets]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[target[i]] -= 1
            back = layer @ error
            layer -= 0.1 * rate * np.outer(mean, error)
            bias -= 0.01 * rate * error
            # The gradient of an average is tiny per bucket; scaling it back up keeps the pace.
            embed[buckets] -= rate * np.minimum(1.0, 50 * share)[:, None] * 0.1 * back[None, :]
    model = Model(languages, (embed @ layer).astype(np.float32), bias)
    if len(unseen) and k > 1:
        _calibrate(model, [texts[i] for i in unseen], np.array([target[i] for i in unseen]))
    return model


def _calibrate(model: Model, texts: list[str], target: np.ndarray) -> None:
    raw = np.log(np.maximum(model.probabilities(texts), 1e-300))

    def scaled(t: float) -> np.ndarray:
        z = raw / t
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    at = np.arange(len(target))
    model.temperature = min(
        np.geomspace(0.05, 20, 60),
        key=lambda t: -np.log(np.maximum(scaled(t)[at, target], 1e-12)).mean(),
    )
    p = scaled(model.temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == target])
    if len(right):
        model.threshold = float(right[int(REJECTED_SHARE * len(right))])


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """A model from at most about ``sample_rows`` labelled rows outside the held-out fold."""
    usable = docs.where(column(text).isNotNull() & column(lang).isNotNull() & ~held_out(doc_id))
    rows = bounded_sample(
        usable.select(column(text).alias("t"), column(lang).alias("l"), column(doc_id).alias("i")),
        F.col("l"), sample_rows, [F.col("l"), F.col("t")], F.col("i"),
    )
    rows = [r for r in rows if _LETTER.search(r["t"])]
    return train([r["t"] for r in rows], [r["l"] for r in rows])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``row`` with ``lang_pred``, ``score`` and ``rejected``.

    A text that is null, empty or without a letter is ``und`` with score 0, and rejected.
    Any other text gets a learned language; it is rejected when its calibrated score is
    below the model's threshold. Ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(row):
        known, texts = shared.value, field(row, text)
        lettered = [k for k, t in enumerate(texts) if t and _LETTER.search(t)]
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rejected = [True] * len(texts)
        if known.languages and lettered:
            p = known.probabilities([texts[k] for k in lettered])
            best = p.argmax(axis=1)
            for k, b, value in zip(lettered, best, p[np.arange(len(best)), best]):
                lang[k], score[k] = known.languages[b], float(min(1.0, value))
                rejected[k] = score[k] < known.threshold
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]

    fields = [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
    return with_results(docs, predict, fields)


def accepted(docs: DataFrame, **names) -> DataFrame:
    """The documents whose language is recognised, columns unchanged.

    Without any labelled text there is no language to recognise, and no document is kept.
    """
    return identify(docs, fit(docs, **names), names.get("text", "text")).where("NOT rejected").select("row.*")
