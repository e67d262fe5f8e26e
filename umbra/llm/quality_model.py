"""Quality classifier: a factorisation machine, trained in numpy.

Features of a text: its words, hashed into 2**BITS slots and counted on a log scale with unit length; structure
statistics (marks, capitals, digits, repeated words and lines, word and line lengths, ...); and metadata that is no
label, language, source or id: the text's size in bytes, words and lines. Every pair of features interacts through
RANK-dimensional factors; the pair sum is taken in linear time as half of (sum of v x)^2 minus the sum of (v x)^2.

The model is fitted in one task on a bounded sample (PER_CLASS labelled rows of each class, held-out fold left
out), by AdaGrad on the logistic loss; sizes of model and sample don't grow with the corpus. Scoring streams whole
texts through Arrow batches, and nothing is shuffled.

Null and empty texts have only the structure features and get a score like any other. Without labelled rows of both
classes every score is the smoothed share of good rows (0.5 with none). Repeated rows are scored alike; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from umbra.llm.tables import fitted, fold, training_sample
from umbra.llm.words import SPACED, Words, mix, words

BITS = 15
RANK = 8
PER_CLASS = 2500
EPOCHS = 12
THRESHOLD = 0.3
FOLDS, HELD = 5, 0
STRUCTURE = 20
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!\"'(),-./:;?[]_{}~@^`+=\\")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


@dataclass
class Features:
    """Rows of hashed words (slots, values, borders) and of structure statistics."""

    slots: np.ndarray
    values: np.ndarray
    borders: np.ndarray
    structure: np.ndarray


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def features(w: Words) -> Features:
    """Features of a chunk of texts; w's bytes are as they stand in the texts."""
    n = len(w.bounds) - 1
    text = w.text_of_words()
    number = np.diff(w.bounds).astype(np.float64)
    size = np.diff(w.offsets).astype(np.float64)
    # distinct words of each text: sort by (text, hash)
    order = np.lexsort((w.hashes, text))
    h, t = w.hashes[order], text[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(fresh)
    counts = np.diff(np.append(at, len(h))).astype(np.float64)
    owner = t[at]
    distinct = np.bincount(owner, minlength=n).astype(np.float64)
    most = np.zeros(n)
    np.maximum.at(most, owner, counts)
    value = np.log1p(counts)
    norm = np.sqrt(np.bincount(owner, weights=value * value, minlength=n))
    slots = (h[at] >> np.uint64(64 - BITS)).astype(np.int64)
    borders = np.searchsorted(owner, np.arange(n + 1))
    # neighbours: equal words side by side, repeated pairs
    same = np.zeros(len(text), dtype=bool)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (text[1:] == text[:-1])
    with np.errstate(over="ignore"):
        pair = mix(w.hashes[1:] * np.uint64(31) + w.hashes[:-1]) if len(text) > 1 else np.zeros(0, np.uint64)
    inner = text[1:] == text[:-1]
    p, pt = pair[inner], text[1:][inner]
    po = np.lexsort((p, pt))
    p, pt = p[po], pt[po]
    again = np.zeros(len(p), dtype=bool)
    again[1:] = (p[1:] == p[:-1]) & (pt[1:] == pt[:-1])
    repeats = np.bincount(pt[again], minlength=n)
    upper = per_text(_UPPER[w.data], w.offsets)
    symbols = per_text(_SYMBOL[w.data], w.offsets)
    marks = per_text(_MARK[w.data], w.offsets)
    digits = per_text(_DIGIT[w.data], w.offsets)
    lines = per_text(w.data == 10, w.offsets) + 1
    beyond = per_text(w.data >= 0x80, w.offsets)
    exclaim = per_text(w.data == 33, w.offsets)
    bars = per_text(w.data == 124, w.offsets)
    stops = per_text(w.data == 46, w.offsets)
    long = np.bincount(text[(w.ends - w.starts) > 20], minlength=n)
    safe, words_ = np.maximum(size, 1), np.maximum(number, 1)
    structure = np.stack(
        [
            np.ones(n),
            np.log1p(size) / 10,
            np.log1p(number) / 8,
            np.log1p(lines) / 5,
            size / words_ / 20,
            words_ / lines / 100,
            distinct / words_,
            most / words_,
            np.bincount(text[same], minlength=n) / words_,
            repeats / words_,
            upper / safe,
            symbols / safe * 3,
            marks / safe * 3,
            digits / safe * 3,
            beyond / safe,
            exclaim / words_,
            bars / words_,
            stops / words_,
            long / words_,
            (number < 10).astype(float),
        ],
        axis=1,
    )
    return Features(slots, value / np.maximum(norm[owner], 1e-9), borders, np.minimum(structure, 4.0))


@dataclass
class Machine:
    """Weights and factors: the first 2**BITS rows for words, then STRUCTURE rows."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, f: Features) -> np.ndarray:
        n = len(f.borders) - 1
        base = 1 << BITS
        line = sums(self.linear[f.slots] * f.values, f.borders) + (f.structure * self.linear[base:]).sum(axis=1)
        pairs = np.zeros(n)
        for k in range(self.factors.shape[1]):
            v, u = self.factors[f.slots, k] * f.values, self.factors[base:, k]
            total = sums(v, f.borders) + (f.structure * u).sum(axis=1)
            squares = sums(v * v, f.borders) + ((f.structure * u) ** 2).sum(axis=1)
            pairs += total * total - squares
        return self.bias + line + 0.5 * pairs


def sums(x: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sum of each row's values; a row's sum doesn't depend on its neighbours."""
    out = np.add.reduceat(np.append(x, 0.0), borders[:-1]) if len(borders) > 1 else np.zeros(0)
    out[np.diff(borders) == 0] = 0
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(sample: list[tuple[str, int]], epochs: int = EPOCHS, rank: int = RANK, rate: float = 0.05, decay: float = 1e-5, seed: int = 11) -> Machine:
    """Training in numpy; sample: (text, 0 or 1)."""
    base = 1 << BITS
    rng = np.random.Generator(np.random.PCG64(seed))
    y = np.array([label for _, label in sample], dtype=np.float64)
    good = (y.sum() + 1) / (len(y) + 2)
    m = Machine(float(np.log(good / (1 - good))), np.zeros(base + STRUCTURE), np.zeros((base + STRUCTURE, rank)))
    if len(set(y.tolist())) < 2:
        return m
    m.factors = rng.normal(0, 0.02, m.factors.shape)
    g_line, g_fact = np.full(len(m.linear), 1e-2), np.full(m.factors.shape, 1e-2)
    parts = [(f, y[w.first : w.first + len(w.bounds) - 1]) for w in words(pa.array([t for t, _ in sample]), SPACED, lower=False, size=1 << 20) for f in (features(w),)]
    rows = [
        (f.slots[f.borders[i] : f.borders[i + 1]], f.values[f.borders[i] : f.borders[i + 1]], f.structure[i], label)
        for f, labels in parts
        for i, label in enumerate(labels)
    ]
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            slots, values, structure, label = rows[i]
            at = np.concatenate([slots, np.arange(base, base + STRUCTURE)])
            x = np.concatenate([values, structure])
            v = m.factors[at]
            vx = v * x[:, None]
            total = vx.sum(axis=0)
            z = m.bias + m.linear[at] @ x + 0.5 * float((total * total).sum() - (vx * vx).sum())
            err = float(sigmoid(np.array(z))) - label
            g = err * x + decay * m.linear[at]
            gv = err * x[:, None] * (total[None, :] - vx) + decay * v
            g_line[at] += g * g
            g_fact[at] += gv * gv
            m.linear[at] -= rate * g / np.sqrt(g_line[at])
            m.factors[at] -= rate * gv / np.sqrt(g_fact[at])
            m.bias -= 0.01 * err
    return m


def scorer(machine: Machine, into: str):
    """A mapInArrow function: rows that hold a text to the same columns and into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sigmoid(machine.logits(features(w))) for w in words(batch.column("text"), SPACED, lower=False)]
            score = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, into])

    return run


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine:
    return fitted(training_sample(documents, labels, "quality", per_class, FOLDS, HELD), fit)


def score_quality(rows: DataFrame, machine: Machine, into: str = "quality_score") -> DataFrame:
    """rows, which hold a text, with their score in the new column into."""
    schema = StructType([*rows.schema.fields, StructField(into, DoubleType())])
    return rows.mapInArrow(scorer(machine, into), schema)


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score_quality(documents.select("doc_id", "text"), train(documents, labels))
    predicted = (F.col("quality_score") >= THRESHOLD).cast("int")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), F.col("quality_score").alias("score"), predicted.alias("predicted"))
