"""Near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Equal sets are one class, named by a number of its
own. Of each class a signature of T minwise values is kept. In an independent tree every class starts at the root; a
node picks signature places and sends each class on to the child of its minwise value there. At the root it picks one or
two places (1 / similarity on average), deeper always two, so that a pair at the threshold misses a tree with 0.15 or
little more at any depth; TREES independent trees and the signatures' own spread lose it with 3e-6, six levels deep 8e-6. A node of up to SMALL classes is compared exhaustively, by
signatures. In a larger one all classes are compared with LEADERS of them; where up to FEW differ from the first and its
like, those are compared with the whole node in blocks; otherwise the node branches again (to DEPTH, then in blocks). Nodes whose
classes already belong together are dropped, so large groups of near copies stay linear.

Signatures only say which classes may belong together. Each such bundle's whole sets then meet once, and links are
confirmed there by exact integer arithmetic on intersections; what a link has joined isn't compared again. A bundle of
more than BUNDLE shingles is dealt to blocks that share HUBS of its classes; classes outside the bundle's main component
then meet all blocks. So no task gets an unbounded group, and no pairs within groups are written. Components are found by
contraction with checkpoints; nothing but whether something is left reaches the driver.

Null, empty and word-less texts have the empty set, n_shingles 0, and link with nothing; texts of fewer words than a
shingle are one shingle. Rows with a null id are returned with a null component, but their texts link others. Rows of a
repeated id keep their own texts' sets, and each gets the component of its text. Very long texts: one is one unit of
work; memory grows with the longest. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.words import SPACED, grams, mix, words
from umbra.session import broadcast_if_small, cut, let_go

WORDS = 5
PERCENT = 85
T = 64
TREES = 8
#: Classes of a node that is compared exhaustively, and of a block's targets and probes.
SMALL, TARGETS, PROBES = 512, 512, 2048
#: Leaders of a larger node, and classes unlike them up to which it is compared in blocks at once.
LEADERS, FEW = 8, 2048
DEPTH = 24
#: Pairs of signatures that agree in a smaller part are left out: 5.2 standard errors below the threshold, 40 of 64 values.
#: A pair just at the threshold is lost so with 2.4e-6 (binomial), in every tree alike.
SKETCH_MARGIN = 0.23
AGREE = int(np.ceil(T * (PERCENT / 100 - SKETCH_MARGIN)))
#: Shingles of a bundle, or a block of one, that is confirmed in one group (8 bytes each).
BUNDLE = 1 << 20
HUBS = 8
#: Classes to confirm that are broadcast to the documents (some 150 bytes each as a hash table), joined by a shuffle beyond.
BROADCAST_ROWS = 500_000
_rng = np.random.Generator(np.random.PCG64(7))
MULTIPLIERS = _rng.integers(0, 2**63, T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _rng.integers(0, 2**63, T, dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for w in words(texts, SPACED):
        g = grams(w.hashes, WORDS)
        for t in range(len(w.bounds) - 1):
            a, b = int(w.bounds[t]), int(w.bounds[t + 1])
            if b - a >= WORDS:
                yield np.unique(g[a : b - WORDS + 1])
            elif b > a:
                h = np.uint64(b - a)
                for x in w.hashes[a:b]:
                    h = mix(np.array([h * np.uint64(0x9E3779B97F4A7C15) + x], dtype=np.uint64))[0]
                yield np.array([h], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)


def signature(s: np.ndarray) -> bytes:
    """T minwise values of 32 bits."""
    out = np.empty(T, dtype=np.uint64)
    for i in range(0, T, 8):
        out[i : i + 8] = (s[None, :] * MULTIPLIERS[i : i + 8, None] + ADDENDS[i : i + 8, None]).min(axis=1)
    return (out >> np.uint64(32)).astype("<u4").tobytes()


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, text_hash) to SKETCH rows."""
    for batch in batches:
        n, key, sig = [], [], []
        with np.errstate(over="ignore"):
            for s in shingle_sets(batch.column(1)):
                n.append(len(s))
                if len(s):
                    m = mix(s)
                    key.append(np.array([m.sum(dtype=np.uint64), np.bitwise_xor.reduce(m)], dtype="<u8").tobytes() + len(s).to_bytes(4, "little"))
                    sig.append(signature(s))
                else:
                    key.append(None)
                    sig.append(None)
        columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "key", "sig"])


SKETCH = "doc_id bigint, text_hash bigint, n_shingles bigint, key binary, sig binary"
NODE_ROWS = "node bigint, id bigint, lab bigint"
PAIRS = "a bigint, b bigint"


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, T)


def places_of(node: np.ndarray, deep: bool) -> tuple[np.ndarray, np.ndarray]:
    """The node's first signature place, and its second or -1: at the root on average 100 / PERCENT places, deeper two."""
    h = mix(node ^ np.uint64(0x5851F42D4C957F2D))
    first = (h % np.uint64(T)).astype(np.int64)
    second = (first + 1 + ((h >> np.uint64(8)) % np.uint64(T - 1)).astype(np.int64)) % T
    more = (h >> np.uint64(32)) % np.uint64(1000) < np.uint64(round(1000 * (100 / PERCENT - 1)))
    return first, np.where(more | deep, second, -1)


def branch(node: np.ndarray, sig: np.ndarray, deep: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, child nodes), once for the first and once for the second places."""
    for place in places_of(node, deep):
        rows = np.flatnonzero(place >= 0)
        value = sig[rows, place[rows]].astype(np.uint64)
        with np.errstate(over="ignore"):
            child = mix(mix(node[rows] + place[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ value)
        yield rows, child


def branching(trees: int):
    """A mapInArrow function: classes (id, sig) at the roots of so many trees, or for 0 (node, id, lab, sig) at their nodes, to the children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, ids = matrix(batch.column("sig")), batch.column("id")
            lab = ids if trees else batch.column("lab")
            roots = [np.full(batch.num_rows, mix(np.array([r + 1], dtype=np.uint64))[0], dtype=np.uint64) for r in range(trees)]
            for node in roots or [batch.column("node").to_numpy().view(np.uint64)]:
                for rows, child in branch(node, sig, not trees):
                    if len(rows):
                        take = pa.array(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), ids.take(take), lab.take(take)], names=["node", "id", "lab"])

    return run


def in_groups(make: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """A mapInArrow function: make() on rows sorted by grp, each call with one whole group; groups are of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("grp").to_numpy()
            border = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for lo, hi in zip(border[:-1], border[1:], strict=True):
                if held and g[lo] != last:
                    yield from make(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = g[lo]
        if held:
            yield from make(pa.Table.from_batches(held))

    return run


def closure(lab: np.ndarray, target: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links (row, row) that join what belongs together; rows of one lab do so from the start.

    near(i, rows) gives those of rows that belong with i. Of each two rows one at least must be a target to be compared.
    """
    outside = np.arange(len(lab))
    while len(outside):
        mine = lab[outside] == lab[outside[0]]
        queue, outside = outside[mine].tolist(), outside[~mine]
        while queue and len(outside):
            i = queue.pop()
            found = near(i, outside if target[i] else outside[target[outside]])
            if len(found):
                yield from ((i, int(j)) for j in found)
                joined = np.isin(lab[outside], lab[found])
                queue += outside[joined].tolist()
                outside = outside[~joined]


def plausible(n: np.ndarray, sig: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    """near() of closure() by signatures and set sizes."""

    def near(i: int, rows: np.ndarray) -> np.ndarray:
        rows = rows[100 * np.minimum(n[rows], n[i]) >= PERCENT * np.maximum(n[rows], n[i])]
        return rows[(sig[rows] == sig[i]).sum(axis=1) >= AGREE]

    return near


def linked(sets: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """near() of closure() by the whole sets, exactly."""
    size = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(size) - size
    mark = np.zeros(len(values), dtype=bool)

    def near(i: int, rows: np.ndarray) -> np.ndarray:
        rows = rows[100 * np.minimum(size[rows], size[i]) >= PERCENT * np.maximum(size[rows], size[i])]
        if not len(rows):
            return rows
        own = flat[begin[i] : begin[i] + size[i]]
        mark[own] = True
        lengths = size[rows]
        border = np.cumsum(lengths) - lengths
        at = np.repeat(begin[rows] - border, lengths) + np.arange(lengths.sum())
        both = np.add.reduceat(mark[flat[at]].astype(np.int64), border)
        mark[own] = False
        return rows[100 * both >= PERCENT * (size[i] + lengths - both)]

    return near


def pairs(ids: np.ndarray, found: Iterator[tuple[int, int]]) -> pa.RecordBatch:
    ab = np.array(list(found), dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids[ab[:, 0]]), pa.array(ids[ab[:, 1]])], names=["a", "b"])


def bundles_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs that may be linked, enough to join the group's bundles. t: grp, id, lab, target, n, sig."""
    ids, lab, n, target = (t.column(c).to_numpy() for c in ("id", "lab", "n", "target"))
    yield pairs(ids, closure(lab, target, plausible(n, matrix(t.column("sig").combine_chunks()))))


def links_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links of a group, enough to join its components. t: grp, id, lab, target, text; repeated rows count once."""
    ids, target = (t.column(c).to_numpy() for c in ("id", "target"))
    order = np.lexsort((~target, ids))  # of a class's rows, the target first
    order = order[np.diff(ids[order], prepend=ids[order[0]] - 1) != 0]
    t = t.take(pa.array(order))
    ids, lab, target = ids[order], t.column("lab").to_numpy(), target[order]
    with np.errstate(over="ignore"):
        sets = [s for chunk in t.column("text").chunks for s in shingle_sets(chunk)]
    yield pairs(ids, closure(lab, target, linked(sets)))


def beside_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of nodes with their leaders (id, lab, n, sig) to LED rows: those that may be linked to a leader get its lab, and the link."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node, ids, lab, n = (batch.column(c).to_numpy() for c in ("node", "id", "lab", "n"))
        sig, lab = matrix(batch.column("sig")), lab.copy()
        main, link = np.zeros_like(lab), np.full(len(lab), -1)
        _, first, which = np.unique(node, return_index=True, return_inverse=True)
        leader = np.zeros_like(ids)
        for k, at in enumerate(first.tolist()):
            rows = np.flatnonzero(which == k)
            leaders = batch.column("leaders")[at].as_py()
            lsig = np.stack([np.frombuffer(x["sig"], dtype="<u4") for x in leaders])
            ln, lid = np.array([x["n"] for x in leaders]), np.array([x["id"] for x in leaders])
            alike = lambda s, m: ((s[:, None, :] == lsig).sum(axis=2) >= AGREE) & (100 * np.minimum(m[:, None], ln) >= PERCENT * np.maximum(m[:, None], ln))
            own = [x["lab"] for x in leaders]
            among = alike(lsig, ln)
            for j in range(1, len(leaders)):
                if among[j, :j].any():
                    own[j] = own[int(np.argmax(among[j, :j]))]
            near = alike(sig[rows], n[rows]) & (ids[rows, None] != lid)
            at = np.argmax(near, axis=1)
            # a leader goes with an earlier one only
            itself = lid == ids[rows, None]
            some = near.any(axis=1) & ~(itself.any(axis=1) & (at > np.argmax(itself, axis=1)))
            main[rows] = own[0]
            lab[rows[some]] = np.array(own)[at[some]]
            leader[rows] = lid[at]
            link[rows[some]] = 1
        columns = [batch.column("node"), batch.column("id"), pa.array(lab), pa.array(main), batch.column("n"), batch.column("sig"), pa.array(link > 0), pa.array(leader)]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in LED.split(", ")])


LED = "node bigint, id bigint, lab bigint, main bigint, n bigint, sig binary, joined boolean, leader bigint"


def scrambled(x: Column) -> Column:
    """A bijection of 64-bit integers, so that least names stand at random places."""
    for _ in range(2):
        x = x.bitwiseXOR(F.shiftleft(x, 13))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
        x = x.bitwiseXOR(F.shiftleft(x, 17))
    return x


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): of all ids that stand in edges (a, b) the name of their component, one of its ids.

    In each round every id points to its least neighbour, pointers are followed twice more, and the edges go on between
    what they point to. Names being scrambled, a path loses most of its ids in each round, whatever its order.
    """
    ups = []
    left = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), light=True)
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("up")), light=True)
        for _ in range(2):
            up = up.join(up.select(F.col("id").alias("up"), F.col("up").alias("top")), "up").select("id", F.col("top").alias("up"))
        ups.append(up := cut(up, light=True))
        on_a, on_b = up.select(F.col("id").alias("a"), F.col("up").alias("ua")), up.select(F.col("id").alias("b"), F.col("up").alias("ub"))
        left = left.join(on_a, "a").join(on_b, "b").where("ua <> ub")
        left = cut(left.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), light=True)
    if not ups:
        return left.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    label = ups[0].withColumnRenamed("up", "comp")
    for up in ups[1:]:
        label = label.join(up.select(F.col("id").alias("comp"), "up"), "comp", "left").select("id", F.coalesce("up", "comp").alias("comp"))
    return cut(label, light=True)


def grouped(rows: DataFrame) -> DataFrame:
    """Rows of a group in one partition, side by side; dealt by a hash of grp, as a join by grp itself would let Spark leave out
    both steps and then, as it runs, the join's own order as well."""
    return rows.repartition(F.xxhash64("grp")).sortWithinPartitions("grp")


def blocks(rows: DataFrame) -> DataFrame:
    """Nodes (node, id, lab, main, n, sig, size, rest) in groups of bounded size: rows outside the main lab meet every row of the node once."""
    joined = rows.withColumn("nt", F.ceil(F.col("rest") / TARGETS).cast("int")).withColumn("np", F.ceil(F.col("size") / PROBES).cast("int"))
    return crossed(joined, "node", F.col("lab") != F.col("main"), ["lab", "n", "sig"])


def crossed(rows: DataFrame, key: str, rest: Column, columns: list[str]) -> DataFrame:
    """Rows in nt x np groups for each key: those of the rest are targets in one nt-th of the groups, all are probes in one np-th."""
    own = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    t = rows.where(rest).select(key, "id", *columns, own("nt", 1).alias("t"), every("np").alias("p"), F.lit(True).alias("target"))
    p = rows.select(key, "id", *columns, every("nt").alias("t"), own("np", 2).alias("p"), F.lit(False).alias("target"))
    # a row that is a target and a probe of one group stands there twice, as one id with one lab
    return t.unionByName(p).select(F.xxhash64(key, "t", "p").alias("grp"), "id", "target", *columns)


def plausible_links(classes: DataFrame, trees: int = TREES, small: int = SMALL, few: int = FEW) -> DataFrame:
    """(a, b): pairs of classes (id, n, sig) that may be linked, enough to join all that may."""
    sized = classes.select("id", "n", "sig")
    rows = classes.select("id", "sig").mapInArrow(branching(trees), NODE_ROWS)
    by_hash = [F.min_by(F.struct("id", "lab", "n", "sig"), F.struct(F.xxhash64("id", "node", F.lit(k)), "id")) for k in range(LEADERS)]
    out = None
    for depth in range(DEPTH + 1):
        # nodes whose classes already have one lab are done
        stats = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("lab").alias("lo"), F.max("lab").alias("hi"))
        stats = cut(stats.where("lo <> hi").select("node", "size"), light=True)
        whole = rows.join(stats.where(F.col("size") <= small).select("node"), "node", "left_semi").join(sized, "id")
        groups = whole.select(F.col("node").alias("grp"), "id", F.lit(True).alias("target"), "lab", "n", "sig")
        large = stats.where(F.col("size") > small).select("node")
        if large.isEmpty():
            edges = cut(grouped(groups).mapInArrow(in_groups(bundles_of), PAIRS))
            return edges if out is None else out.unionByName(edges)
        full = cut(rows.join(large, "node", "left_semi").join(sized, "id").select("node", "id", "lab", "n", "sig"))
        leaders = full.groupBy("node").agg(F.array_distinct(F.array(*by_hash)).alias("leaders"))
        led = cut(full.join(leaders, "node").mapInArrow(beside_leaders, LED))
        found = led.where("joined").select(F.col("id").alias("a"), F.col("leader").alias("b"))
        left = led.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("lab") != F.col("main")).alias("rest")).where("rest > 0")
        led = led.join(left, "node")
        many = F.col("rest") > (few if depth < DEPTH else float("inf"))
        edges = cut(grouped(groups.unionByName(blocks(led.where(~many)))).mapInArrow(in_groups(bundles_of), PAIRS).unionByName(found))
        out = edges if out is None else out.unionByName(edges)
        rows = cut(led.where(many).select("node", "id", "lab", "sig").mapInArrow(branching(0), NODE_ROWS))
        del stats, whole, groups, full, leaders, led, left
        let_go(classes)
        if rows.isEmpty():
            return out
    return out


def texts_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc, text_hash, id, ...) with the text of one of their rows, written once."""
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("own_hash"))
    same = (F.col("text_hash") == F.col("own_hash")) & F.col("doc").eqNullSafe(F.col("doc_id"))
    return cut(rows.join(broadcast_if_small(wanted, BROADCAST_ROWS), same).drop("doc_id", "own_hash", "doc", "text_hash").dropDuplicates(["id"]))


def confirmed(documents: DataFrame, classes: DataFrame, label: DataFrame, bundle: int = BUNDLE) -> DataFrame:
    """(a, b): links of classes (id, n, doc, text_hash) within bundles (id, comp), enough to join each component."""
    members = cut(classes.select("id", "n", "doc", "text_hash").join(label, "id"), light=True)
    sizes = members.groupBy("comp").agg(F.sum("n").alias("total"), *[F.min_by("id", F.xxhash64("id", F.lit(k))).alias(f"h{k}") for k in range(HUBS)])
    sizes = cut(sizes.select("comp", "total", F.array_distinct(F.array(*[f"h{k}" for k in range(HUBS)])).alias("hubs")), light=True)
    held = texts_of(documents, members.select("id", "comp", "n", "doc", "text_hash"))
    whole = held.join(sizes.where(F.col("total") <= bundle).select("comp"), "comp")
    one_group = lambda df: df.select("grp", "id", F.col("id").alias("lab"), F.lit(True).alias("target"), "text")
    links = cut(grouped(one_group(whole.withColumnRenamed("comp", "grp"))).mapInArrow(in_groups(links_of), PAIRS))
    del whole
    let_go(classes)
    parts = F.ceil(F.col("total") / bundle).cast("int")
    big = cut(held.join(sizes.where(F.col("total") > bundle).select("comp", "hubs", parts.alias("np")), "comp"))
    if big.isEmpty():
        return links
    is_hub = F.array_contains("hubs", F.col("id"))
    own = big.withColumn("p", F.when(is_hub, F.sequence(F.lit(0), F.col("np") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), "np").cast("int"))))
    dealt = own.select("id", "text", "comp", F.explode("p").alias("p")).withColumn("grp", F.xxhash64("comp", "p"))
    first = cut(grouped(one_group(dealt)).mapInArrow(in_groups(links_of), PAIRS))
    # what is outside a bundle's main component meets all of the bundle's blocks
    labels = big.drop("hubs").join(components(first).withColumnRenamed("comp", "lab"), "id", "left").withColumn("lab", F.coalesce("lab", "id"))
    labels = cut(labels)
    main = labels.groupBy("comp", "lab").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    main = main.groupBy("comp").agg(F.max_by("lab", F.struct("c", "lab")).alias("main"), (F.sum("s") - F.max_by("s", F.struct("c", "lab"))).alias("rest")).where("rest > 0")
    sized = labels.join(main, "comp").withColumn("nt", F.ceil(F.col("rest") / bundle).cast("int"))
    rest = grouped(crossed(sized, "comp", F.col("lab") != F.col("main"), ["lab", "text"])).mapInArrow(in_groups(links_of), PAIRS)
    return links.unionByName(first).unionByName(cut(rest))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text) of every row."""
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    sketched = cut(rows.mapInArrow(sketch, SKETCH))
    one = F.min(F.struct("doc_id", "text_hash")).alias("one")
    by_key = sketched.where("key IS NOT NULL").groupBy("key").agg(one, F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    named = scrambled(F.monotonically_increasing_id()).alias("id")
    classes = cut(by_key.select(named, "key", "least", "copies", "n", "sig", F.col("one.doc_id").alias("doc"), F.col("one.text_hash").alias("text_hash")))
    let_go(classes)
    bundles = plausible_links(classes.select("id", "n", "sig"))
    let_go(classes)
    bundles = components(bundles)
    let_go(classes)
    links = confirmed(documents, classes, bundles)
    let_go(classes)
    label = components(links)
    let_go(classes)
    least = classes.select("id", "least").join(label, "id")
    least = least.join(least.groupBy("comp").agg(F.min("least").alias("component")), "comp").select("id", "component")
    found = classes.select("id", "key", "least", "copies").join(least, "id", "left").where("copies > 1 OR component IS NOT NULL")
    found = found.select("key", F.coalesce("component", "least").alias("component"))
    out = sketched.select("doc_id", "n_shingles", "key", "text_hash").join(found, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")
