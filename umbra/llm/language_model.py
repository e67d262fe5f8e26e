"""Scores of whole texts by a weighted backoff automaton of smoothed n-grams.

Tokens are lower-cased words and one end token a text. The automaton's states are the root, each word of the training
texts, and each word pair that stands there MIN_STATE times at least. A state s has an arc for each word w that follows it
in training, of weight (1 - b) c(sw) / c(s) + b p(w | s'), where s' is s without its first word, and a failure arc to s' of the
stored weight b for all other words; 1 - b is TRUST of the state's order times c(s) / (c(s) + KAPPA). The root's arcs weigh
p(w) by absolute discounting; all unseen words together take what the discount frees. So the weights out of each state
sum to 1. An arc for w leads to the longest state that ends what has been read. A left-to-right traversal carries the
state, takes its arc for the next token, or its failure arc until there is one, and adds the log10 weights.

No table of n-grams is collected or broadcast. Texts are tokenized once, in numbered batches that are written to the
checkpoint folder. A batch sends its distinct n-grams and their training counts, packed by hash bucket, to the bucket's
task, which adds up all batches' counts and answers each batch with the counts of what it asked for: first words and
pairs, then the triples whose first pair is a state. With the answers a batch holds just the part of the automaton that
its texts walk through. Buckets grow in number with the corpus, so no task grows; a bucket is a range of n-gram hashes, so
a frequent word or pair is one number of each batch like any other. A batch sends a row for each bucket that it has
n-grams of, so never more rows than n-grams.

Null and empty texts are one end token; a very long text is a batch of its own, whose size bounds memory. Repeated rows
are counted each time. Without training rows every token is unseen and weighs 1. An empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.tables import fold_of
from umbra.llm.words import SPACED, Words, mix, words
from umbra.session import cut, let_go

#: Of states of one and two words: weight of what follows them in training, and pseudo-counts; occurrences that make a pair a state.
TRUST, KAPPA = (0.3, 0.6), (2.0, 2.0)
MIN_STATE = 2
DISCOUNT = 0.75
FOLDS, HELD = 7, 2
#: Bytes of text of a batch, and of all texts for each bucket.
BATCH = 8 << 20
BYTES_A_BUCKET = 8 << 20
#: Hash of the end token; it also stands for the state before the first word.
END = np.uint64(0x0E4D)
_NEXT = np.uint64(0x9E3779B97F4A7C15)

WORD, PAIR, TRIPLE, TEXTS, TOKENS, KNOWN = range(6)
PACKED = "batch bigint, kind int, bucket int, keys binary, counts binary"


def squeeze(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u4").tobytes(), 1)


def stretch(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype="<u4").astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """The numbers' bytes, all first ones, then all second ones, ...: high bytes of small numbers compress away."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, "<u8"), dtype=np.uint64)


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the chunk's tokens with an end after each text, the texts' borders)."""
    texts = len(w.bounds) - 1
    out = np.full(len(w.hashes) + texts, END, dtype=np.uint64)
    out[np.arange(len(w.hashes)) + w.text_of_words()] = w.hashes
    return out, w.bounds + np.arange(texts + 1)


def in_training(ids: list, folds: int, held: int) -> np.ndarray:
    """Whether each row teaches; rows without an id are in fold 0."""
    return np.array([(0 if i is None else fold_of(i, folds)) != held for i in ids], dtype=bool)


def tokenizing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to batches of texts as token numbers: keys holds the distinct tokens' hashes, counts the rest."""
    for batch in batches:
        for w in words(batch.column(1), SPACED, size=BATCH):
            t, bounds = tokens(w)
            distinct, inverse, counts = np.unique(t, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")  # frequent tokens get small numbers
            rank = np.empty(len(order), dtype=np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            ids = batch.column(0).slice(w.first, len(w.bounds) - 1).to_pylist()
            body = zlib.compress(pickle.dumps((ids, bounds, planes(rank[inverse]))), 1)
            yield pa.RecordBatch.from_arrays([pa.array([distinct[order].tobytes()], pa.binary()), pa.array([body], pa.binary())], names=["keys", "counts"])


@dataclass
class Batch:
    """A batch's texts: ids, borders, token hashes, and of each token the hash of its word, pair and triple with what comes before."""

    ids: list
    bounds: np.ndarray
    grams: list[np.ndarray]

    @classmethod
    def of(cls, keys: bytes, body: bytes) -> Batch:
        ids, bounds, numbers = pickle.loads(zlib.decompress(body))
        word = np.frombuffer(keys, dtype=np.uint64)[from_planes(numbers, "<u4")]
        before = np.roll(word, 1)
        before[bounds[:-1]] = END
        pair = mix(before * _NEXT + word)
        # the first token of a text has no pair before it; the pair of the end before is like no other
        triple = mix(np.roll(pair, 1) * _NEXT + (word ^ np.uint64(TRIPLE)))
        return cls(ids, bounds, [word, pair, triple])

    def first(self) -> np.ndarray:
        """Whether each token is the first of its text."""
        out = np.zeros(len(self.grams[0]), dtype=bool)
        out[self.bounds[:-1]] = True
        return out

    def teaches(self, folds: int, held: int) -> np.ndarray:
        return np.repeat(in_training(self.ids, folds, held), np.diff(self.bounds))


def questions(number: int, kind: int, hashes: np.ndarray, learn: np.ndarray, buckets: int) -> tuple[list, ...]:
    """PACKED columns: the distinct hashes with their training counts by bucket.

    Sorted keys fall into buckets by their high bits, so a bucket's keys are one slice of them.
    """
    keys, inverse = np.unique(hashes, return_inverse=True)
    counts = np.bincount(inverse, weights=learn, minlength=len(keys))
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    border = np.searchsorted(bucket, np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(border)).tolist()
    slices = [slice(border[b], border[b + 1]) for b in some]
    return [number] * len(some), [kind] * len(some), some, [pack_keys(keys[x]) for x in slices], [squeeze(counts[x]) for x in slices]


_kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
_names = [c.split()[0] for c in PACKED.split(", ")]


def asking(buckets: int, folds: int, held: int):
    """A mapInArrow function: written batches to their words and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for number, keys, body in zip(*(rows.column(c).to_pylist() for c in ("batch", "keys", "counts")), strict=True):
                b = Batch.of(keys, body)
                learn = b.teaches(folds, held)
                for kind in (WORD, PAIR):
                    asked = questions(number, kind, b.grams[kind], learn, buckets)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(asked, _kinds, strict=True)], names=_names)

    return run


def answer(part: pd.DataFrame) -> pd.DataFrame:
    """One bucket's questions of one kind to the answers: for each batch the sums of its keys' counts; and the bucket's totals."""
    keys = [unpack_keys(k) for k in part["keys"]]
    counts = [stretch(c) for c in part["counts"]]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    kind, bucket = int(part["kind"].iloc[0]), int(part["bucket"].iloc[0])
    rows = [(b, kind, bucket, b"", squeeze(sums[inverse[e - len(k) : e]])) for b, k, e in zip(part["batch"].tolist(), keys, ends.tolist(), strict=True)]
    if kind == WORD:
        rows += [(int(sums.sum()), TOKENS, bucket, b"", b""), (int((sums > 0).sum()), KNOWN, bucket, b"", b"")]
    return pd.DataFrame(rows, columns=_names)


def read_group(part: pd.DataFrame) -> tuple[int, Batch, dict[int, np.ndarray]]:
    """A batch's rows to its number, its texts and of each kind the counts of its sorted distinct n-grams."""
    kinds = {int(k): g.sort_values("bucket") for k, g in part.groupby("kind")}
    text = kinds.pop(TEXTS).iloc[0]
    return int(text["batch"]), Batch.of(text["keys"], text["counts"]), {k: np.concatenate([stretch(c) for c in g["counts"]]) for k, g in kinds.items()}


def asking_triples(buckets: int, folds: int, held: int):
    """An applyInPandas function: a batch with the counts of its words and pairs to its triples whose first pair is a state."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        number, b, counts = read_group(part)
        at = triples_of(b, counts[PAIR][np.unique(b.grams[PAIR], return_inverse=True)[1]])
        return pd.DataFrame(dict(zip(_names, questions(number, TRIPLE, b.grams[TRIPLE][at], b.teaches(folds, held)[at], buckets), strict=True)))

    return run


def triples_of(b: Batch, pair_counts: np.ndarray) -> np.ndarray:
    """Places of the tokens that are read in the state of the pair before them."""
    return np.flatnonzero((np.roll(pair_counts, 1) >= MIN_STATE) & ~b.first())


@dataclass
class Automaton:
    """States: fail and back are each one's failure arc, its target and log10 weight. Arcs: weight and next, by n-gram number.

    arcs holds of each order the arc for each token of the batch, -1 where there is none: the arc that a state of that
    order, which is what was read last, has for the token. The root (state 0) has one for every token. next is given by
    token, as it is the longest state that ends there, whatever arc has led to it.
    """

    fail: np.ndarray
    back: np.ndarray
    order: np.ndarray
    weight: np.ndarray
    next: np.ndarray
    arcs: list[np.ndarray]
    start: int

    def walk(self, first: np.ndarray) -> np.ndarray:
        """Log10 weight of each token.

        As next doesn't depend on the way there, all tokens step at once, each from its forerunner's next, or from the start.
        """
        state = np.roll(self.next, 1)
        state[first] = self.start
        total = np.zeros(len(state))
        left = np.arange(len(state))
        while len(left):
            s = state[left]
            arc = np.choose(self.order[s], [a[left] for a in self.arcs])
            found = arc >= 0
            total[left[found]] += self.weight[arc[found]]
            left, s = left[~found], s[~found]
            total[left] += self.back[s]
            state[left] = self.fail[s]
        return total


def automaton(b: Batch, counts: dict[int, np.ndarray], total: int, known: int, trust: tuple[float, float] = TRUST, kappa: tuple[float, float] = KAPPA, discount: float = DISCOUNT) -> tuple[Automaton, np.ndarray]:
    """The part that the batch's texts walk through, and each token's count."""
    names, word = np.unique(b.grams[WORD], return_inverse=True)
    pair = np.unique(b.grams[PAIR], return_inverse=True)[1]
    c1, c2 = counts[WORD], counts[PAIR]
    first = b.first()
    end = int(np.searchsorted(names, END))
    before = np.roll(word, 1)
    before[first] = end
    # states: the root, the known words, the frequent pairs
    word_state = np.where(c1 > 0, np.cumsum(c1 > 0), 0)
    words_ = int((c1 > 0).sum())
    pair_state = np.where(c2 >= MIN_STATE, words_ + np.cumsum(c2 >= MIN_STATE), -1)
    of_pair = np.zeros(len(c2), dtype=np.int64)  # a token at which each pair ends
    of_pair[pair] = np.arange(len(pair))
    frequent = c2 >= MIN_STATE
    fail = np.concatenate([[0], np.zeros(words_, dtype=np.int64), word_state[word[of_pair[frequent]]]])
    size = np.concatenate([[0.0], c1[c1 > 0], c2[frequent]])
    order = np.repeat([0, 1, 2], [1, words_, int(frequent.sum())])
    goes_on = [lambda c, t=t, k=k: t * c / (c + k) for t, k in zip(trust, kappa, strict=True)]
    with np.errstate(divide="ignore"):
        back = np.log10(1 - np.choose(order, [np.ones(len(size)), *(g(size) for g in goes_on)]))
    # arcs: of the root for all words, of words, of pairs
    n = max(total, 1)
    p1 = np.where(c1 > 0, (c1 - discount) / n, discount * known / n if total else 1.0)
    step = lambda order, c, of, lower: (g := goes_on[order](of)) * c / np.maximum(of, 1) + (1 - g) * lower
    p2 = step(0, c2, c1[before[of_pair]], p1[word[of_pair]])
    at = triples_of(b, c2[pair])
    keys, inverse = np.unique(b.grams[TRIPLE][at], return_inverse=True)
    c3 = counts.get(TRIPLE, np.zeros(0, dtype=np.int64))
    one = np.zeros(len(keys), dtype=np.int64)
    one[inverse] = at
    # p2 of a pair that never stands in training is what the failure arc of its first word leaves
    p3 = step(1, c3, c2[pair[one - 1]], p2[pair[one]])
    triple = np.full(len(word), -1)
    triple[at] = np.where(c3[inverse] > 0, len(c1) + len(c2) + inverse, -1)
    arcs = [word, np.where(c2[pair] > 0, len(c1) + pair, -1), triple]
    longest = np.where(pair_state[pair] >= 0, pair_state[pair], word_state[word])
    return Automaton(fail, back, order, np.log10(np.concatenate([p1, p2, p3])), longest, arcs, int(word_state[end])), c1[word]


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def scoring(total: int, known: int, folds: int, held: int):
    """An applyInPandas function: a batch's texts and answers to its texts' scores."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        _, b, counts = read_group(part)
        a, c = automaton(b, counts, total, known)
        base = np.log10((c + 1) / (total + known + 1))
        score, base, seen = (np.add.reduceat(x, b.bounds[:-1]) for x in (a.walk(b.first()), base, (c > 0).astype(np.int64)))
        columns = [pd.array(b.ids, dtype="Int64"), ~in_training(b.ids, folds, held), np.diff(b.bounds), seen, total, base, score]
        return pd.DataFrame(dict(zip([c.split()[0] for c in RESULT.split(", ")], columns, strict=True)))

    return run


def score_texts(documents: DataFrame, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = documents.select("doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(16, math.ceil(size / BYTES_A_BUCKET))
    made = rows.mapInArrow(tokenizing, "keys binary, counts binary")
    texts = cut(made.select(F.monotonically_increasing_id().alias("batch"), F.lit(TEXTS).alias("kind"), F.lit(0).alias("bucket"), "keys", "counts"))
    answers = cut(texts.mapInArrow(asking(buckets, folds, held), PACKED).groupBy("kind", "bucket").applyInPandas(answer, PACKED))
    let_go(rows, rounds=5)
    sums = {r["kind"]: r["n"] for r in answers.where(F.col("kind").isin(TOKENS, KNOWN)).groupBy("kind").agg(F.sum("batch").alias("n")).collect()}
    total, known = sums.get(TOKENS, 0), sums.get(KNOWN, 0)
    answers = answers.where(F.col("kind").isin(WORD, PAIR))
    asked = texts.unionByName(answers.where(F.col("kind") == PAIR)).groupBy("batch").applyInPandas(asking_triples(buckets, folds, held), PACKED)
    triples = cut(asked.groupBy("kind", "bucket").applyInPandas(answer, PACKED))
    del asked
    let_go(rows, rounds=5)
    return texts.unionByName(answers).unionByName(triples).groupBy("batch").applyInPandas(scoring(total, known, folds, held), RESULT)
