"""Benchmark decontamination by winnowing.

Of each text's K-word hashes the least (rightmost of equals) in every run of W consecutive ones is kept as a
fingerprint. Two texts that share WINDOW = K + W - 1 consecutive words share a whole run and so keep the same
fingerprint of it: no shared window is missed. Items of fewer than WINDOW words are one window each; for them every run
of just their length is its own fingerprint.

Training and test fingerprints meet in two steps, at every size the same ones. A table of 2**BITS bits, set where a
benchmark fingerprint falls, goes to the documents with the scan (its size is fixed; a fuller one only lets more pass);
windows whose fingerprint passes are joined by their own hash with the benchmark's windows. A hit is extended by the
windows before and after it that join as well; what they cover together is a span. So equal fingerprints cost no
pairs, and the join is salted by nothing but Spark's own splitting: of the benchmark's windows each stands there once.
Documents' texts are read once and never shuffled; rows meet their spans by the hash of their text, on which alone
the result depends, so null and repeated doc_ids are like any others.

Null and empty texts have no words and no hits; an empty benchmark hits nothing; repeated rows are treated alike;
items with equal texts all count, an item_id counts once, and an item without an id marks words but isn't counted.
Other columns are ignored. Words are compared by 64-bit hashes. Memory is bounded by a chunk of texts or one very long
text, and by the windows of one text that are in the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.words import ALNUM, Words, grams, mix, words
from umbra.session import broadcast_if_small, cut

WINDOW = 10
K = 5
BITS = 24
#: Rows of benchmark windows or of texts with hits that are broadcast (some 32 bytes each), joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000
ITEMS = "item_id string, length int, print bigint, window bigint"
FOUND = "doc_id bigint, text_hash bigint, n_words bigint, windows array<struct<at:int,length:int,window:bigint>>"
SPANS = "text_hash bigint, spans array<int>"


def windows(w: Words, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, fingerprints, hashes) of all runs of length words inside the chunk's texts.

    A window's fingerprint is its least k-gram hash, rightmost of equals, so that consecutive windows mostly share one.
    """
    n = len(w.hashes)
    if n < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    text = w.text_of_words()
    places = np.flatnonzero(text[: n - length + 1] == text[length - 1 :])
    whole = grams(w.hashes, length) ^ mix(np.array([length], dtype=np.uint64))
    prints = np.lib.stride_tricks.sliding_window_view(grams(w.hashes, k), length - k + 1).min(axis=1)
    return places, prints[places], whole[places]


def gram_size(length: int, window: int, k: int) -> int:
    """Words of the fingerprints of windows of length words."""
    return k if length >= window else length


def item_windows(window: int, k: int):
    """A mapInArrow function: (item_id, text) to the items' windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), ALNUM):
                sizes = np.minimum(np.diff(w.bounds), window)
                for length in np.unique(sizes[sizes > 0]).tolist():
                    places, prints, whole = windows(w, length, gram_size(length, window, k))
                    owner = w.text_of_words()[places]
                    mine = sizes[owner] == length
                    ids = batch.column(0).take(pa.array(owner[mine] + w.first))
                    columns = [ids, pa.array(np.full(mine.sum(), length), pa.int32()), pa.array(prints[mine].view(np.int64)), pa.array(whole[mine].view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["item_id", "length", "print", "window"])

    return run


def bit_table(items: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, those of the items' fingerprints set: by the first bits of their hashes."""
    place = F.shiftrightunsigned("print", 64 - bits)
    held = items.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    held = held.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("value"))
    out = np.zeros(max(1, 1 << bits >> 6), dtype=np.int64)
    for r in held.toLocalIterator():
        out[r["word"]] = r["value"]
    return out.view(np.uint64)


def scan(table: np.ndarray, bits: int, lengths: list[int], window: int, k: int):
    """A mapInArrow function over (doc_id, text, text_hash): the rows with those of their windows whose fingerprint is in the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, owner, at, size, found = [], [], [], [], []
            for w in words(batch.column(1), ALNUM):
                n.append(np.diff(w.bounds))
                text = w.text_of_words()
                for length in lengths:
                    places, prints, whole = windows(w, length, gram_size(length, window, k))
                    slot = prints >> np.uint64(64 - bits)
                    hit = np.flatnonzero((table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1))
                    owner.append(text[places[hit]] + w.first)
                    at.append(places[hit] - w.bounds[:-1][text[places[hit]]])
                    size.append(np.full(len(hit), length))
                    found.append(whole[hit])
            rows = batch.num_rows
            join = lambda parts, kind: np.concatenate(parts).astype(kind, copy=False) if parts else np.zeros(0, kind)
            owner, at, size, found = join(owner, np.int64), join(at, np.int32), join(size, np.int32), join(found, np.uint64)
            order = np.argsort(owner, kind="stable")
            struct = pa.StructArray.from_arrays([pa.array(at[order]), pa.array(size[order]), pa.array(found[order].view(np.int64))], names=["at", "length", "window"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[order], np.arange(rows + 1)), pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(join(n, np.int64)), lists], names=["doc_id", "text_hash", "n_words", "windows"])

    return run


def merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_hash, places: begin << 32 | length of hit windows) to flat begin, end of the spans they cover."""
    for batch in batches:
        spans = []
        for places in batch.column(1).to_pylist():
            p = np.unique(np.array(places, dtype=np.int64))
            begin, end = p >> 32, np.maximum.accumulate((p >> 32) + (p & 0xFFFFFFFF))
            first = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
            spans.append(np.stack([begin[first], end[np.append(first[1:], len(p)) - 1]], axis=1).ravel().tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.int32()))], names=["text_hash", "spans"])


def hits(documents: DataFrame, benchmark: DataFrame, window: int, k: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row's (doc_id, text_hash, n_words); of each text that is hit (text_hash, at, length, window) and the benchmark's windows."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    items = cut(items.mapInArrow(item_windows(window, k), ITEMS).distinct(), light=True)
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = cut(rows.mapInArrow(scan(bit_table(items, bits), bits, lengths, window, k), FOUND))
    texts = found.where(F.size("windows") > 0).groupBy("text_hash").agg(F.first("windows").alias("windows"))
    each = texts.select("text_hash", F.explode("windows").alias("w")).select("text_hash", "w.*")
    known = items.select("window").distinct()
    return found.select("doc_id", "text_hash", "n_words"), cut(each.join(broadcast_if_small(known, BROADCAST_ROWS), "window"), light=True), items


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, bits: int = BITS) -> DataFrame:
    """doc_id, n_words, spans (flat begin, end word numbers of hit runs), items (sorted ids with occurring windows) of every row."""
    rows, hit, items = hits(documents, benchmark, window, k, bits)
    places = hit.select("text_hash", F.shiftleft(F.col("at").cast("bigint"), 32).bitwiseOR(F.col("length").cast("bigint")).alias("place"))
    spans = places.groupBy("text_hash").agg(F.collect_set("place").alias("places")).mapInArrow(merging, SPANS)
    named = items.where(F.col("item_id").isNotNull()).select("window", "item_id")
    names = hit.select("text_hash", "window").distinct().join(named, "window").groupBy("text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    both = cut(spans.join(names, "text_hash", "left"), light=True)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    joined = rows.join(both, "text_hash", "left")
    return joined.select("doc_id", "n_words", F.coalesce("spans", none("int")).alias("spans"), F.coalesce("items", none("string")).alias("items"))


def clean_rows(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, bits: int = BITS) -> DataFrame:
    """The documents, with all their columns, whose texts hold no window of the benchmark."""
    hit = cut(hits(documents, benchmark, window, k, bits)[1].select(F.col("text_hash").alias("_hit")).distinct(), light=True)
    return documents.join(broadcast_if_small(hit, BROADCAST_ROWS), F.xxhash64("text") == F.col("_hit"), "left_anti")


def contamination(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest columns of decontaminate(): n_hit counts words inside hit runs."""
    found = decontaminate(documents, benchmark, **options)
    pairs = F.transform(F.filter("spans", lambda x, i: i % 2 == 0), lambda x, i: F.get("spans", 2 * i + 1) - x)
    n_hit = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
