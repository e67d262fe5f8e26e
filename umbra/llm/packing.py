"""Best-fit packing planned over a histogram of lengths.

Documents become token ids (a public tokenizer's, then one end id 0); only those longer than a sequence are cut.
Best-fit decreasing runs over counts of lengths on the driver: at most `capacity` counts in, and a plan out whose
size depends on the capacity alone, not on the number of documents. Pieces then take their planned slots by their
rank within their length. The rank needs no window over a whole length: each task numbers its own pieces by length,
the tasks' histograms give each task's first rank (one row for each task and length), and the two meet by a join.

Tokens are cached by word; a worker's cache is bounded by CACHE entries and one batch chunk's own words. Null and empty texts are one piece of the end id alone. Repeated rows are packed each. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.words import LOWER, chunks, span_hashes
from umbra.session import cut

CAPACITY = 2048
END = 0
CACHE = 600_000

#: Kinds of bytes; of those beyond ASCII only Latin-1 letters are told apart, by their two bytes.
SPACE, LETTER, DIGIT, MARK, ODD = range(5)
KINDS = np.full(256, ODD, dtype=np.uint8)
KINDS[0x21:0x7F] = MARK
KINDS[[0x20, *range(0x09, 0x0E)]] = SPACE
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KINDS[0x30:0x3A] = DIGIT
KINDS[[ord("'"), ord("<")]] = ODD

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Texts to token ids with a cache of units, by 64-bit hash.

    A unit is a run of letters (ASCII or Latin-1), a run of ASCII marks, or a digit: this tokenizer, which lower-cases,
    makes each one word of its own. A stretch between white space that holds anything else (other characters, an
    apostrophe, "<", controls) is one unit and goes to the tokenizer as it stands.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.clear()

    def clear(self) -> None:
        self.row: dict[int, int] = {}
        self.parts: list[np.ndarray] = []
        self.flat = np.zeros(0, dtype=np.uint32)
        self.begin = np.zeros(1, dtype=np.int64)

    def units(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, kinds, starts, lengths, hashes) of the units of the texts."""
        raw = raw[offsets[0] : offsets[-1]]
        kind = KINDS[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        follow = raw[lead + 1]
        lead = lead[(follow >= 0x80) & (follow != 0x97) & (follow != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offsets - offsets[0]] = True
        solid = kind != SPACE
        fresh = solid.copy()
        fresh[1:] &= ~solid[:-1] | edge[1:-1]
        stretch = np.flatnonzero(fresh)
        data = LOWER[raw]
        odd = kind == ODD
        if odd.any():
            whole = np.logical_or.reduceat(odd, stretch)
            odd = np.repeat(whole, np.diff(np.append(stretch, len(raw)))) & solid[stretch[0] :]
            at = np.flatnonzero(odd) + stretch[0]
            kind[at] = ODD
            data[at] = raw[at]
        fresh[1:] |= solid[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
        starts = np.flatnonzero(fresh)
        if not len(starts):
            return data, kind, starts, starts, np.zeros(0, dtype=np.uint64)
        lengths = np.add.reduceat(solid.astype(np.int64), starts)
        return data, kind, starts, lengths, span_hashes(data, solid, starts, lengths)

    def learn(self, new: list[tuple[int, str, bool]]) -> None:
        """new: (hash, unit, whether it is one word for certain)."""
        self.parts = [self.flat]
        sizes: list[int] = []
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            sure = [x for x in part if x[2]]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(x[1] for x in sure)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(sure):
                part, sure = [(h, u, False) for h, u, _ in part], []
            for (h, _, _), n in zip(sure, np.diff(ends, prepend=0).tolist(), strict=True):
                self.row[h] = len(self.begin) - 1 + len(sizes)
                sizes.append(n)
            if sure:
                self.parts.append(ids)
            rest = [x for x in part if not x[2]]
            for (h, _, _), e in zip(rest, self.tokenizer.encode_batch_fast([x[1] for x in rest], add_special_tokens=False), strict=True):
                self.row[h] = len(self.begin) - 1 + len(sizes)
                sizes.append(len(e.ids))
                self.parts.append(np.array(e.ids, dtype=np.uint32))
        self.flat = np.concatenate(self.parts)
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes, dtype=np.int64)])

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, borders) of the texts raw[offsets[t]:offsets[t + 1]]."""
        data, kind, starts, lengths, hashes = self.units(raw, offsets) if offsets[-1] > offsets[0] else (None, None, np.zeros(0, np.int64), None, np.zeros(0, np.uint64))
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.row) > CACHE:
            self.clear()
        names = keys.tolist()
        new = [i for i, k in enumerate(names) if k not in self.row]
        if new:
            text = data.tobytes()
            self.learn([(names[i], text[starts[j] : starts[j] + lengths[j]].decode("utf-8", "replace"), kind[starts[j]] != ODD) for i in new for j in (first[i],)])
        rows = np.fromiter(map(self.row.__getitem__, names), dtype=np.int64, count=len(names))[inverse]
        sizes = self.begin[rows + 1] - self.begin[rows]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1])) + np.repeat(self.begin[rows] - (ends - sizes), sizes)
        borders = np.append(0, ends)[np.searchsorted(starts, offsets - offsets[0])]
        return self.flat[at], borders


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECES = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint, task int, rank bigint"


def cut_pieces(path: str, capacity: int = CAPACITY):
    """A mapInArrow function: documents to pieces, numbered within their length by this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for raw, offsets, at in chunks(batch.column(1)):
                ids, borders = enc.encode(raw, offsets)
                text = ids.astype("<u4").tobytes()
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "task", "rank")}
                for t, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)):
                    whole = text[4 * a : 4 * b] + end
                    for n, start in enumerate(range(0, len(whole), 4 * capacity)):
                        own = whole[start : start + 4 * capacity]
                        length = len(own) // 4
                        for k, v in zip(out, (docs[at + t], n, start // 4, length, zlib.crc32(own), task, int(seen[length])), strict=True):
                            out[k].append(v)
                        seen[length] += 1
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return run


@dataclass(frozen=True)
class Run:
    """Pieces of one length with rank in [first, first + count): sequence `sequence + k // each`, place `offset + length * (k % each)`."""

    length: int
    first: int
    count: int
    sequence: int
    each: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing over counts: the longest lengths first, each piece in the fullest sequence that holds it.

    Sequences with equal room are kept as intervals of numbers, so a step touches groups, never single pieces.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, number)
    out: list[Run] = []
    fresh = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        for r in range(length, capacity + 1):
            each = r // length
            groups, room[r] = room[r], []
            for g, (sequence, number) in enumerate(groups):
                if not left:
                    room[r].extend(groups[g:])
                    break
                take = min(left, number * each)
                out.append(Run(length, rank, take, sequence, each, capacity - r))
                full, part = divmod(take, each)
                if full:
                    room[r - each * length].append((sequence, full))
                if part:
                    room[r - part * length].append((sequence + full, 1))
                rest = number - full - bool(part)
                if rest:
                    room[r].append((sequence + full + bool(part), rest))
                left, rank = left - take, rank + take
        if left:
            each = capacity // length
            full, part = divmod(left, each)
            out.append(Run(length, rank, left, fresh, each, 0))
            if full:
                room[capacity - each * length].append((fresh, full))
            if part:
                room[capacity - part * length].append((fresh + full, 1))
            fresh += full + bool(part)
        # equal rooms left by different groups: neighbours become one interval
        for r in range(capacity + 1):
            if len(room[r]) > 1:
                room[r] = joined(room[r])
    return out


def joined(groups: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, number in sorted(groups):
        if out and sum(out[-1]) == first:
            out[-1] = (out[-1][0], out[-1][1] + number)
        else:
            out.append((first, number))
    return out


def place(runs: list[Run]):
    """A mapInArrow function: pieces with their rank within their length to (sequence_id, offset)."""
    order = sorted(runs, key=lambda r: (r.length, r.first))
    table = np.array([(r.length, r.first, r.sequence, r.each, r.offset) for r in order], dtype=np.int64).reshape(-1, 5)
    bounds = np.searchsorted(table[:, 0], np.arange(table[:, 0].max(initial=0) + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            at = np.empty(len(length), dtype=np.int64)
            for n in np.unique(length):
                own = length == n
                a, b = bounds[n], bounds[n + 1]
                at[own] = a + np.searchsorted(table[a:b, 1], rank[own], side="right") - 1
            k = rank - table[at, 1]
            sequence = table[at, 2] + k // table[at, 3]
            offset = table[at, 4] + length * (k % table[at, 3])
            keep = [batch.column(c) for c in ("doc_id", "piece", "start")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(length), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row."""
    pieces = cut(documents.select("doc_id", "text").mapInArrow(cut_pieces(tokenizer, capacity), PIECES))
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("first")).alias("rank"))
    return ranked.mapInArrow(place(plan(histogram, capacity)), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
