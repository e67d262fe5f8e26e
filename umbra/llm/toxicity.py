"""Toxicity classifier: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters by itself, as an embedding (hashed), and by its characters: the last state of a small recurrent unit that
spells its last LETTERS bytes, the mean of the embeddings of its hashed byte n-grams within word borders, and the largest of
their first parts, so that inflected and unseen forms share what their stems have taught. A forward and a backward gated recurrent unit run over windows of
WINDOW words, each STEP words after the last, an attention layer pools their states, and a logistic unit scores the
window. All overlapping windows of the whole text are scored; the text's score is that of its worst window.

Training: labels stand for whole texts, so each round takes of a toxic text its worst window so far (at first the one
with the largest log odds), of a clean text its worst and a random one, and descends by Adam. The embeddings begin as
log odds of their slots in the sample and are trained along. The sample is bounded (PER_CLASS labelled texts of each
class, held-out fold left out) and fitted on the driver; scoring streams whole texts through Arrow batches without a
shuffle. Words' gate inputs are taken once for each distinct word of a chunk.

Null, empty and word-less texts are one empty window, whose pooled state is zero. Without labelled rows of both
classes every score is the share of toxic rows. Repeated rows are scored alike; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from umbra.llm.tables import fitted, fold, training_sample
from umbra.llm.words import ALNUM, Words, grams, mix, words

WINDOW = 24
STEP = 12
HIDDEN = 8
EMBED = 4
#: Slots are plenty: in a long text, words and n-grams that share slots with telling ones would add up.
WORD_BITS = 18
CHAR_BITS = 20
GRAMS = (3, 5)
PER_CLASS = 1200
ROUNDS = 4
LEAST_STEPS = 300
THRESHOLD = 0.5
FOLDS, HELD = 5, 0
#: Bytes of text that are scored at once.
CHUNK = 1 << 20
BAG = 2 * EMBED + 2
#: Of the unit that spells a word: bytes read, size of their embedding and of its state.
LETTERS, LETTER, SPELL = 16, 6, 6
INPUT = BAG + SPELL
#: Standard errors taken off a slot's log odds, so that rare words don't look telling by chance.
CAUTION = 1.5
#: Learning rate of the embeddings against that of the network.
SLOW = 0.1


def char_slots(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, borders): hashed byte n-grams of words with a mark at each end; every word has one at least."""
    sizes = ends - starts + 2
    begin = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.full(begin[-1] + max(GRAMS), 1, dtype=np.uint64)
    inner = np.arange(begin[-1]) - np.repeat(begin[:-1], sizes)
    real = (inner > 0) & (inner < np.repeat(sizes, sizes) - 1)
    at = np.repeat(starts, sizes) + inner - 1
    flat[: begin[-1]][real] = data[at[real]]
    word = np.repeat(np.arange(len(starts)), sizes)
    slots, owners = [], []
    for n in GRAMS:
        code = np.full(begin[-1], n, dtype=np.uint64)
        for j in range(n):
            code = code * np.uint64(257) + flat[j : j + begin[-1]]
        room = inner + n <= np.repeat(np.maximum(sizes, n), sizes)
        room &= inner <= np.repeat(np.maximum(sizes - n, 0), sizes)
        slots.append((mix(code[room]) >> np.uint64(64 - CHAR_BITS)).astype(np.int64))
        owners.append(word[room])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(slots)[order], np.searchsorted(owner[order], np.arange(len(starts) + 1))


def spelling(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(LETTERS, words): the words' last bytes, so that each ends in the last row; -1 before them."""
    at = ends[None, :] - LETTERS + np.arange(LETTERS)[:, None]
    inside = at >= starts[None, :]
    return np.where(inside, data[np.where(inside, at, 0)].astype(np.int16), np.int16(-1)) if len(starts) else np.zeros((LETTERS, 0), np.int16)


class Vocabulary:
    """Distinct words of a chunk: slots of the words and of their n-grams; index: each word's number."""

    def __init__(self, w: Words):
        _, first, self.index = np.unique(w.hashes, return_index=True, return_inverse=True)
        self.words = (w.hashes[first] >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        self.chars, self.borders = char_slots(w.data, w.starts[first], w.ends[first]) if len(first) else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        self.lengths = np.minimum((w.ends - w.starts)[first], 40)
        self.letters = spelling(w.data, w.starts[first], w.ends[first])

    def inputs(self, word_table: np.ndarray, char_table: np.ndarray) -> np.ndarray:
        """The words' own parts: all but what their spelling adds."""
        n = len(self.words)
        out = np.zeros((n, BAG), dtype=np.float32)
        if n:
            rows = char_table[self.chars]
            out[:, :EMBED] = word_table[self.words]
            out[:, EMBED : 2 * EMBED] = np.add.reduceat(rows, self.borders[:-1], axis=0) / np.diff(self.borders)[:, None]
            out[:, -2] = np.maximum.reduceat(rows[:, 0], self.borders[:-1])
            out[:, -1] = self.lengths / 20
        return out


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words, numbers of words, texts) of all overlapping windows; a text without words has one empty window."""
    n = np.diff(bounds)
    number = np.maximum(0, -(-(n - WINDOW) // STEP)) + 1
    text = np.repeat(np.arange(len(n)), number)
    k = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    first = bounds[:-1][text] + k * STEP
    return first, np.clip(bounds[1:][text] - first, 0, WINDOW), text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters p: tables, gates (input, state and bias of update, reset and candidate; forward, backward and spelling), attention, output."""

    def __init__(self, seed: int = 5):
        r = np.random.Generator(np.random.PCG64(seed))
        g = lambda *s, scale=0.3: r.normal(0, scale, s).astype(np.float32)
        self.p = {"word": g(1 << WORD_BITS, EMBED, scale=0.02), "char": g(1 << CHAR_BITS, EMBED, scale=0.02)}
        for d in "fb":
            self.p |= {f"W{d}": g(INPUT, 3 * HIDDEN), f"U{d}": g(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"byte": g(256, LETTER), "Ws": g(LETTER, 3 * SPELL), "Us": g(SPELL, 3 * SPELL), "bs": np.zeros(3 * SPELL, np.float32)}
        self.p |= {"A": g(2 * HIDDEN, HIDDEN), "v": g(HIDDEN), "o": g(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        self.constant: float | None = None

    def run(self, d: str, gates: np.ndarray, index: np.ndarray, live: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States (time, row, unit) of one direction (s: the last state only); gates: inputs' parts, index (time, row) into them."""
        steps, n = index.shape
        u = self.p[f"U{d}"]
        k = len(u)
        h = np.zeros((n, k), np.float32)
        out = np.empty((steps, n, k), np.float32) if d != "s" else None
        tape = []
        for t in range(steps) if d != "b" else range(steps - 1, -1, -1):
            s, gate = h @ u, gates[index[t]]
            zr = sigmoid(gate[:, : 2 * k] + s[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            c = np.tanh(gate[:, 2 * k :] + r * s[:, 2 * k :])
            new = (c + z * (h - c)) * live[t][:, None]
            if keep:
                tape.append((t, h, s, z, r, c))
            h = new
            if out is not None:
                out[t] = h
        return out if out is not None else h, tape

    def back(self, d: str, index: np.ndarray, live: np.ndarray, tape: list, d_out: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of U and of the gate table (size rows), from those of the states (s: of the last one)."""
        u = self.p[f"U{d}"]
        k = len(u)
        g_u, g_table = np.zeros_like(u), np.zeros((size, 3 * k), u.dtype)
        carry = d_out if d == "s" else np.zeros((index.shape[1], k), u.dtype)
        for t, before, s, z, r, c in reversed(tape):
            dn = (carry if d == "s" else d_out[t] + carry) * live[t][:, None]
            dc = dn * (1 - z) * (1 - c * c)
            dz = dn * (before - c) * z * (1 - z)
            dr = dc * s[:, 2 * k :] * r * (1 - r)
            ds = np.concatenate([dz, dr, dc * r], axis=1)
            np.add.at(g_table, index[t], np.concatenate([dz, dr, dc], axis=1))
            g_u += before.T @ ds
            carry = dn * z + ds @ u.T
        return g_u, g_table

    def spell(self, letters: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Last states of the unit that reads words' bytes."""
        gates = np.concatenate([self.p["byte"] @ self.p["Ws"] + self.p["bs"], np.zeros((1, 3 * SPELL), np.float32)])
        return self.run("s", gates, letters, (letters >= 0).astype(np.float32), keep)

    def spell_gradient(self, letters: np.ndarray, tape: list, d_states: np.ndarray) -> dict[str, np.ndarray]:
        g_u, g_table = self.back("s", letters, (letters >= 0).astype(np.float32), tape, d_states, 257)
        g = g_table[:-1]
        return {"Us": g_u, "bs": g.sum(axis=0), "Ws": self.p["byte"].T @ g, "byte": g @ self.p["Ws"].T}

    def inputs(self, v: Vocabulary) -> np.ndarray:
        return np.concatenate([v.inputs(self.p["word"], self.p["char"]), self.spell(v.letters)[0]], axis=1)

    def gate_tables(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Gate inputs of each distinct word, and of none (the last row)."""
        return {d: np.concatenate([x @ self.p[f"W{d}"] + self.p[f"b{d}"], np.zeros((1, 3 * HIDDEN), np.float32)]) for d in "fb"}

    def forward(self, tables: dict[str, np.ndarray], index: np.ndarray, keep: bool = False):
        """Logits of windows; index (time, row): numbers of words, -1 for none."""
        live = (index >= 0).astype(np.float32)
        states, tapes = zip(*(self.run(d, tables[d], index, live, keep) for d in "fb"), strict=True)
        h = np.concatenate(states, axis=2)
        a = np.tanh(h @ self.p["A"])
        e = a @ self.p["v"] + np.where(live > 0, 0, -1e9).astype(np.float32)
        w = np.exp(e - e.max(axis=0)) * live
        w /= np.maximum(w.sum(axis=0), 1e-9)
        pooled = (w[:, :, None] * h).sum(axis=0)
        logit = pooled @ self.p["o"] + self.p["c"][0]
        return logit, (live, tapes, h, a, w, pooled)

    def gradient(self, x: np.ndarray, index: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weighted logistic loss, and of the inputs x (distinct words)."""
        tables = self.gate_tables(x)
        logit, (live, tapes, h, a, w, pooled) = self.forward(tables, index, keep=True)
        d_logit = ((sigmoid(logit) - y) * weight).astype(np.float32)
        g = {"o": pooled.T @ d_logit, "c": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.p["o"]
        d_h = w[:, :, None] * d_pooled[None]
        d_w = (h * d_pooled[None]).sum(axis=2)
        d_e = w * (d_w - (w * d_w).sum(axis=0))
        g["v"] = np.einsum("tn,tnk->k", d_e, a)
        d_a = d_e[:, :, None] * self.p["v"] * (1 - a * a)
        g["A"] = np.einsum("tni,tnk->ik", h, d_a)
        d_h += d_a @ self.p["A"].T
        d_x = np.zeros((len(x) + 1, INPUT), np.float32)
        for i, d in enumerate("fb"):
            g_u, g_table = self.back(d, index, live, tapes[i], d_h[:, :, i * HIDDEN : (i + 1) * HIDDEN], len(tables[d]))
            g[f"U{d}"], g[f"b{d}"], g[f"W{d}"] = g_u, g_table[:-1].sum(axis=0), x.T @ g_table[:-1]
            d_x += g_table @ self.p[f"W{d}"].T
        return g, d_x[:-1]

    def score(self, w: Words) -> np.ndarray:
        """Score of each text of a chunk: its worst window's."""
        n = len(w.bounds) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        v = Vocabulary(w)
        return sigmoid(self.worst(v, w.bounds)[0])

    def worst(self, v: Vocabulary, bounds: np.ndarray, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """(logit, window number) of the worst window of each text."""
        tables = self.gate_tables(self.inputs(v))
        first, size, text = windows(bounds)
        logits = np.concatenate([self.forward(tables, window_index(v, first[a : a + rows], size[a : a + rows]))[0] for a in range(0, len(first), rows)])
        top = np.full(len(bounds) - 1, -np.inf)
        np.maximum.at(top, text, logits)
        at = np.zeros(len(top), dtype=np.int64)
        best = np.flatnonzero(logits == top[text])[::-1]
        at[text[best]] = best
        return top, at


def window_index(v: Vocabulary, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = first[None, :] + np.arange(WINDOW)[:, None]
    inside = np.arange(WINDOW)[:, None] < size[None, :]
    return np.where(inside, v.index[np.minimum(at, len(v.index) - 1)], -1) if len(v.index) else np.full(at.shape, -1)


def learn_words(net: Network, sample: list[tuple[str, int]], y: np.ndarray, start: bool = True) -> tuple[Vocabulary, np.ndarray]:
    """The sample's vocabulary and text borders; sets the tables' first parts to log odds. A chunk of texts at a time."""
    sizes = {"word": 1 << WORD_BITS, "char": 1 << CHAR_BITS}
    bad, good = ({k: np.zeros(n) for k, n in sizes.items()} for _ in range(2))
    hashes, ends, parts, seen = [], [np.zeros(1, dtype=np.int64)], [], np.zeros(0, dtype=np.uint64)
    for w in words(pa.array([t for t, _ in sample]), ALNUM, size=1 << 20):
        own = Vocabulary(w)
        text = w.text_of_words()
        # of each text its distinct words, then their n-grams
        pair = np.unique(text * len(own.words) + own.index)
        text, number = pair // len(own.words), pair % len(own.words)
        grams_ = np.diff(own.borders)[number]
        at = np.repeat(own.borders[:-1][number] - (np.cumsum(grams_) - grams_), grams_) + np.arange(grams_.sum())
        for k, slots, texts in (("word", own.words[number], text), ("char", own.chars[at], np.repeat(text, grams_))):
            once = np.unique(texts * sizes[k] + slots)
            label = y[w.first + once // sizes[k]]
            bad[k] += np.bincount(once % sizes[k], weights=label, minlength=sizes[k])
            good[k] += np.bincount(once % sizes[k], weights=1 - label, minlength=sizes[k])
        keys = np.unique(w.hashes)
        new = ~np.isin(keys, seen)
        seen = np.union1d(seen, keys)
        parts.append((keys[new], own, np.flatnonzero(new)))
        hashes.append(w.hashes)
        ends.append(ends[-1][-1] + w.bounds[1:])
    for k in sizes:
        if start:
            net.p[k][:, 0] = log_odds(bad[k], good[k], y)
        net.p[k][bad[k] + good[k] == 0] = 0  # what the sample doesn't hold says nothing
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys)
    v = Vocabulary.__new__(Vocabulary)
    v.words = np.concatenate([own.words[n] for _, own, n in parts])[order]
    v.lengths = np.concatenate([own.lengths[n] for _, own, n in parts])[order]
    v.letters = np.concatenate([own.letters[:, n] for _, own, n in parts], axis=1)[:, order]
    grams_ = [own.chars[own.borders[i] : own.borders[i + 1]] for _, own, n in parts for i in n]
    grams_ = [grams_[i] for i in order]
    v.borders = np.concatenate([[0], np.cumsum([len(g) for g in grams_], dtype=np.int64)])
    v.chars = np.concatenate(grams_) if grams_ else np.zeros(0, np.int64)
    v.index = np.searchsorted(keys[order], np.concatenate(hashes)).astype(np.int32)
    return v, np.concatenate(ends)


def log_odds(bad: np.ndarray, good: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each slot, by the toxic and clean texts that have it: the log odds that a text with it is toxic, less their error."""
    odds = np.log((bad + 0.5) / (y.sum() + 1)) - np.log((good + 0.5) / ((1 - y).sum() + 1))
    error = np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    return np.clip(odds - CAUTION * error, 0, 4).astype(np.float32)


def without_copies(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Of each label's near copies (by the least 5-word hashes) one, as copies would make chance words look telling."""
    seen: set[tuple[int, int, int]] = set()
    out = []
    for w in words(pa.array([t for t, _ in sample], pa.string()), ALNUM):
        for t in range(len(w.bounds) - 1):
            g = grams(w.hashes[w.bounds[t] : w.bounds[t + 1]], 5)
            keys = [(sample[w.first + t][1], i, int(mix(g ^ np.uint64(i)).min())) for i in range(3)] if len(g) else []
            if not any(k in seen for k in keys):
                out.append(sample[w.first + t])
            seen.update(keys)
    return out


def fit(sample: list[tuple[str, int]], rounds: int = ROUNDS, rate: float = 0.01, batch: int = 32, seed: int = 3, start: bool = True) -> Network:
    """A network trained on (text, 0 or 1)."""
    net = Network(seed)
    sample = without_copies(sample)
    y = np.array([label for _, label in sample], dtype=np.float32)
    if len(set(y.tolist())) < 2:
        net.constant = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0
        return net
    v, bounds = learn_words(net, sample, y, start)
    rng = np.random.Generator(np.random.PCG64(seed))
    first, size, owner = windows(bounds)
    borders = np.searchsorted(owner, np.arange(len(y) + 1))
    x = v.inputs(net.p["word"], net.p["char"])
    hint = np.concatenate([[0], np.cumsum((x[:, 0] + x[:, BAG - 2])[v.index])])
    lead = hint[first + size] - hint[first]
    worst = np.array([a + int(np.argmax(lead[a:b])) for a, b in zip(borders[:-1], borders[1:], strict=True)])
    moments = {k: [np.zeros_like(q), np.zeros_like(q)] for k, q in net.p.items() if k not in ("word", "char")}
    squares = {k: np.full(net.p[k].shape, 1e-6, np.float32) for k in ("word", "char")}
    step = 0
    # few rows: more rounds, for as many steps
    for round_ in range(min(12, max(rounds, LEAST_STEPS * batch // (2 * len(y)) + 1))):
        if round_:
            worst = net.worst(v, bounds)[1]
        clean = np.flatnonzero(y == 0)
        other = (borders[clean] + rng.random(len(clean)) * np.diff(borders)[clean]).astype(np.int64)
        rows = np.concatenate([worst, other])
        labels = np.concatenate([y, np.zeros(len(clean), np.float32)])
        order = rng.permutation(len(rows))
        share = np.sqrt(len(rows) / (2 * np.array([(labels == 0).sum(), (labels == 1).sum()], dtype=np.float32)))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            index = window_index(v, first[rows[own]], size[rows[own]])
            used, local = np.unique(index, return_inverse=True)
            local = local.reshape(index.shape)
            if used[0] < 0:
                used, local = used[1:], local - 1
            states, tape = net.spell(v.letters[:, used], keep=True)
            x = np.concatenate([part_inputs(net, v, used), states], axis=1)
            grads, d_x = net.gradient(x, local, labels[own], share[labels[own].astype(int)] / len(own))
            grads |= net.spell_gradient(v.letters[:, used], tape, d_x[:, BAG:])
            for k, (rows_, g) in table_gradients(v, used, d_x).items():
                squares[k][rows_] += g * g
                net.p[k][rows_] -= SLOW * rate * g / np.sqrt(squares[k][rows_])
            step += 1
            for k, g in grads.items():
                m, s = moments[k]
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)
    return net


def part_inputs(net: Network, v: Vocabulary, used: np.ndarray) -> np.ndarray:
    part = Vocabulary.__new__(Vocabulary)
    sizes = np.diff(v.borders)[used]
    part.words, part.lengths = v.words[used], v.lengths[used]
    part.borders = np.concatenate([[0], np.cumsum(sizes)])
    part.chars = v.chars[np.repeat(v.borders[used] - part.borders[:-1], sizes) + np.arange(part.borders[-1])]
    return part.inputs(net.p["word"], net.p["char"])


def table_gradients(v: Vocabulary, used: np.ndarray, d_x: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(rows, gradients) of the word and character tables; the largest first part passes none on."""
    sizes = np.diff(v.borders)[used]
    begin = np.cumsum(sizes) - sizes
    slots = v.chars[np.repeat(v.borders[used] - begin, sizes) + np.arange(sizes.sum())]
    chars = np.repeat(d_x[:, EMBED : 2 * EMBED] / sizes[:, None], sizes, axis=0)
    out = {}
    for k, at, g in (("word", v.words[used], d_x[:, :EMBED]), ("char", slots, chars)):
        rows, inverse = np.unique(at, return_inverse=True)
        total = np.zeros((len(rows), EMBED), np.float32)
        np.add.at(total, inverse, g)
        out[k] = rows, total
    return out


def scorer(net: Network, into: str):
    """A mapInArrow function: rows that hold a text to the same columns and into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [net.score(w) for w in words(batch.column("text"), ALNUM, size=CHUNK)]
            score = np.concatenate(found).astype(np.float64) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, into])

    return run


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network:
    return fitted(training_sample(documents, labels, "toxic", per_class, FOLDS, HELD), fit)


def score_toxicity(rows: DataFrame, net: Network, into: str = "toxicity_score") -> DataFrame:
    """rows, which hold a text, with their score in the new column into."""
    schema = StructType([*rows.schema.fields, StructField(into, DoubleType())])
    return rows.mapInArrow(scorer(net, into), schema)


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score_toxicity(documents.select("doc_id", "text"), train(documents, labels))
    predicted = (F.col("toxicity_score") >= THRESHOLD).cast("int")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), F.col("toxicity_score").alias("score"), predicted.alias("predicted"))
