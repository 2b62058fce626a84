"""Toxicity by a character n-gram linear classifier with naive Bayes log-count ratios.

Features are the hashed 3- to 5-character n-grams that occur in a lower-cased text, each scaled by the
log ratio of its shares among toxic and clean training rows.  A logistic regression over the scaled
features is fitted on the driver from a bounded sample of labelled rows: ``sample_rows`` rows, in the
order of a hash of their id; of a text of more than ``sample_chars`` characters, a window of that length
whose place follows from a hash of the id.  Which n-grams are kept (by how many standard errors their
ratio differs from none) and how strongly weights are held back are chosen by the likelihood of rows
outside the fitted folds, equal texts in one fold, so that labels are not learnt by heart.  Scoring reads whole texts
of all documents, without a shuffle; the model that is broadcast has at most ``features`` weights.

Defined cases: null and empty texts have no features and get the model's base rate; without labels of
both classes every score is the share of toxic rows, 0 without any; repeated label rows count as often
as they occur; labels other than 0 and 1 are ignored; columns other than id and text are not read; an
input column with the name of the score gives way to it.
"""

from __future__ import annotations

import itertools
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomix.llm.arrow import map_text
from fathomix.llm.textbytes import odd_numbers

ORDERS = (3, 4, 5)
BITS = 20
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 20_000
FEATURES = 12_000
#: Rows that hold an n-gram at least, if it is to be a feature.
LEAST_ROWS = 4
#: Standard errors and penalties that are tried, on so many folds.
CUTS, PENALTIES, FOLDS = (3.0, 4.0, 5.5), (1e-4, 1e-3), 4
THRESHOLD = 0.3


def gram_buckets(text: str | None) -> np.ndarray:
    """The hash buckets of all n-grams of a text, repeats included."""
    x = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    times = [int(a) & 0xFFFFFFFF for a in odd_numbers(max(ORDERS), 21)]
    parts = []
    h = np.zeros(len(x), np.uint32)
    for k in range(max(ORDERS)):
        n = len(x) - k
        if n <= 0:
            break
        h = h[:n] + (x[k:] + np.uint32(0x9E37)) * np.uint32(times[k])
        if k + 1 in ORDERS:
            g = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * k)
            parts.append((g ^ (g >> np.uint32(12))) >> np.uint32(32 - BITS))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


@dataclass
class Model:
    """Weights of the features that were kept; slot is -1 for all other buckets."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float

    def of_buckets(self, buckets: np.ndarray) -> float:
        slots = self.slot[buckets]
        z = self.bias + float(self.weight[np.unique(slots[slots >= 0])].sum())
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    def score(self, text: str | None) -> float:
        return self.of_buckets(gram_buckets(text))


def _strength(counts: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log ratio, its difference from none in standard errors) of each bucket, of the rows of each class that hold it."""
    p, q = counts[1] + 1.0, counts[0] + 1.0
    ratio = np.log(p / (y.sum() + 2)) - np.log(q / (len(y) - y.sum() + 2))
    return ratio, np.where(counts.sum(axis=0) >= LEAST_ROWS, np.abs(ratio) / np.sqrt(1 / p + 1 / q), 0)


def _regression(docs: list[np.ndarray], y: np.ndarray, counts: np.ndarray, cut: float, l2: float, features: int, rounds: int) -> Model:
    """A logistic regression over the scaled n-grams whose ratio differs from none by ``cut`` standard errors."""
    ratio, strength = _strength(counts, y)
    kept = np.flatnonzero(strength > cut)
    kept = np.sort(kept[np.argsort(-strength[kept], kind="stable")[:features]])
    slot = np.full(1 << BITS, -1, np.int32)
    slot[kept] = np.arange(len(kept))
    cols = [s[s >= 0] for s in (slot[d] for d in docs)]
    owner = np.repeat(np.arange(len(docs)), [len(c) for c in cols])
    col = np.concatenate(cols)
    value = ratio[kept]
    share = y.mean()
    w, m, v, b = np.zeros(len(kept)), np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), math.log(share / (1 - share))
    for t in range(1, rounds + 1):
        z = np.bincount(owner, (w * value)[col], len(docs)) + b
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        grad = np.append(np.bincount(col, error[owner], len(kept)) * value / len(docs) + l2 * w, error.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.04 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(slot, w * value, float(b))


def fit(rows: list[tuple[str | None, int]], features: int = FEATURES, rounds: int = 150) -> Model:
    """A model of rows (text, 0 or 1); its strictness is chosen on folds of them.

    Texts are read twice: once to count n-grams, and once for those that some model may use, so that
    what is held is small.
    """
    y = np.array([r[1] for r in rows], np.float64)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return Model(np.full(1 << BITS, -1, np.int32), np.zeros(0), 500.0 if share else -500.0)
    fold = np.array([zlib.crc32((t or "").encode("utf-8", "surrogatepass")) % FOLDS for t, _ in rows])
    parts = np.zeros((FOLDS, 2, 1 << BITS), np.int32)
    with np.errstate(over="ignore"):
        for (text, label), f in zip(rows, fold, strict=True):
            parts[f, int(label), np.unique(gram_buckets(text))] += 1
        total = parts.sum(axis=0)
        usable = _strength(total, y)[1] > min(CUTS)
        for f in range(FOLDS):
            usable |= _strength(total - parts[f], y[fold != f])[1] > min(CUTS)
        docs = [np.unique(b[usable[b]]).astype(np.int32) for b in (gram_buckets(t) for t, _ in rows)]
    loss = dict.fromkeys(itertools.product(CUTS, PENALTIES), 0.0)
    for f in range(FOLDS):
        inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if not len(outside) or not 0 < y[inside].sum() < len(inside):
            continue
        for cut, l2 in loss:
            model = _regression([docs[i] for i in inside], y[inside], total - parts[f], cut, l2, features, rounds)
            p = np.array([model.of_buckets(docs[i]) for i in outside])
            loss[cut, l2] -= np.log(np.clip(np.where(y[outside] > 0, p, 1 - p), 1e-9, None)).sum()
    cut, l2 = min(loss, key=lambda k: (loss[k], -k[0], -k[1]))
    return _regression(docs, y, total, cut, l2, features, rounds)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", held_out=None, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model of a bounded sample of the labelled rows outside ``held_out``, a condition on doc_id."""
    use = labels.filter(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y"))
    if held_out is not None:
        use = use.filter(~held_out("__id"))
    # Ids in hash order; more of them than needed, as some texts are missing.
    ids = use.orderBy(F.xxhash64("__id"), "__id").limit(2 * sample_rows)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(ids), "__id")
    place = F.pmod(F.xxhash64("__id"), F.greatest(F.char_length("__text") - sample_chars, F.lit(0)) + 1).cast("int") + 1
    rows = rows.withColumn("__text", F.when(F.char_length("__text") > sample_chars, F.substring("__text", place, F.lit(sample_chars))).otherwise(F.col("__text")))
    rows = rows.orderBy(F.xxhash64("__id"), F.xxhash64("__text"), "__y").limit(sample_rows).select("__text", "__y").toArrow()
    return fit(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` columns of docs and the score of each whole text."""
    # Plain arrays: a broadcast is pickled by reference, and workers may have no copy of this library.
    shared = docs.sparkSession.sparkContext.broadcast((model.slot, model.weight, model.bias))

    def make():
        model = Model(*shared.value)
        return lambda texts: [[model.score(t) for t in texts.to_pylist()]]

    return map_text(docs, text, [T.StructField(name, T.DoubleType())], make, docs.columns if keep is None else keep)
