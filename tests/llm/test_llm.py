"""The llm operators against brute force on small tables, with nulls, empty and repeated rows, and clashing extra columns."""

import hashlib
import itertools
import math
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from umbra.llm import chat, html_text, language_model, licenses, near_dups, packing, quality_model, quality_rules, toxicity, winnowing
from umbra.llm.labelled_pages import PAGES, _page
from umbra.llm.words import ALNUM, SPACED, mix, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED_RE, ALNUM_RE = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "Gamma", "delta", "É", "über", "x1", "the", "of"]) + str(r.randint(0, 9)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = [prose(i, 5 + 7 * i) for i in range(12)]
    near = base[9].split()
    near[3] = "changed"
    odd = [None, "", " \t\n", "one", "a b", "line\nline\n\nline x\n", "a b c d e a b c d e f", "\x00weird\x1f É×÷ <|endoftext|> ''s", prose(99, 3000), base[5], base[5], " ".join(near), "MIT License and mit  license", "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."]
    return [*base, *odd]


@pytest.fixture(scope="module")
def documents(spark, texts):
    rows = [(i, t, "en", "s", 0, "clash") for i, t in enumerate(texts)] + [(None, texts[3], "en", "s", 0, "clash")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def test_words_equal_the_pattern(texts):
    array = pa.array(texts, pa.string())
    for flags, pattern, lower in ((SPACED, SPACED_RE, True), (ALNUM, ALNUM_RE, True)):
        got = []
        for w in words(array, flags, lower, size=100):
            for t in range(len(w.bounds) - 1):
                got.append([w.data[w.starts[i] : w.ends[i]].tobytes().decode() for i in range(w.bounds[t], w.bounds[t + 1])])
        assert got == [pattern.findall((t or "").translate(LOW)) for t in texts]


def test_quality_rules(spark, documents, texts):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id bigint, quality int, toxic int")
    got = by_id(quality_rules.quality_rules(documents, labels))
    for i, t in enumerate(texts):
        t = t or ""
        w = SPACED_RE.findall(t)
        windows = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        twice = {x for x, c in Counter(windows).items() if c > 1}
        covered = {j + d for j, x in enumerate(windows) if x in twice for d in range(5)}
        lines = [x for x in t.split("\n") if SPACED_RE.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= quality_rules.THRESHOLD)
    assert quality_rules.quality_rules(documents.limit(0), labels).count() == 0
    assert all(r["llr"] == 0 for r in quality_rules.quality_rules(documents, labels.limit(0)).collect())


def spark_hash(*values):
    """Spark's xxhash64 of strings or longs; nulls are skipped."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), h)
            h = h - (1 << 64) if h >> 63 else h
            h &= (1 << 64) - 1
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("place_bits", [24, 3])
def test_quality_rules_by_brute_force(spark, documents, texts, monkeypatch, place_bits):
    """The log-likelihood ratio from the counts of buckets, and repeats of texts with more places than fit beside a hash."""
    monkeypatch.setattr(quality_rules, "PLACE_BITS", place_bits)
    target = [9, 10, 11, 20, 21]
    labels = spark.createDataFrame([(i, 1, 0) for i in target] + [(1, 0, 0), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = by_id(quality_rules.quality_rules(documents, labels))
    grams = []
    for t in [*texts, texts[3]]:
        h = [spark_hash(w) for w in SPACED_RE.findall(t or "")]
        grams.append([*h, *(spark_hash(x, h[i + 1] if i + 1 < len(h) else None) for i, x in enumerate(h))])
    sampled = len({g for gs in grams for g in gs if g % quality_rules.SAMPLE == 0})
    buckets = quality_rules.buckets_for(quality_rules.SAMPLE * sampled)
    raw, good = Counter(g % buckets for gs in grams for g in gs), Counter(g % buckets for i in target for g in grams[i])
    share = good.total() / raw.total()
    ratio = {b: math.floor(quality_rules.SCALE * math.log((good[b] + 1) / (c * share + 1)) + 0.5) if c > 1 else 0 for b, c in raw.items()}
    for i, gs in enumerate(grams[:-1]):
        assert got[i]["llr"] == pytest.approx(sum(ratio[g % buckets] for g in gs) / quality_rules.SCALE / max(1, len(gs)), abs=1e-3), i
    for i, t in enumerate(texts):
        w = SPACED_RE.findall(t or "")
        twice = {x for x, c in Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)).items() if c > 1}
        assert got[i]["n_repeat_words"] == len({j + d for j in range(len(w) - 4) if tuple(w[j : j + 5]) in twice for d in range(5)})


def test_quality_rules_with_many_ngrams(spark, monkeypatch):
    """More distinct n-grams than any fixed table of buckets keeps apart, and several passes."""
    r = random.Random(3)
    rows = [(i, " ".join(f"w{r.randrange(60000)}" for _ in range(300))) for i in range(3000)] + [(3000 + i, " ".join(f"junk{r.randrange(60)}" for _ in range(20))) for i in range(20)]
    rows += [rows[7], rows[3001], (None, rows[3002][1])]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(2000)] + [(3000 + i, 0, 0) for i in range(10)], "doc_id bigint, quality int, toxic int")
    got = quality_rules.quality_rules(documents, labels).select("doc_id", "llr", "kept").collect()
    assert len(got) == len(rows)
    assert not any(x["kept"] for x in got if x["doc_id"] is None or x["doc_id"] >= 3000)
    assert all(x["kept"] for x in got if x["doc_id"] is not None and x["doc_id"] < 3000)
    monkeypatch.setattr(quality_rules, "LARGE", 1 << 15)
    passes = quality_rules.quality_rules(documents, labels, block=1 << 19).select("doc_id", "llr", "kept").collect()
    assert sorted(got, key=str) == sorted(passes, key=str)


def test_quality_rules_read_the_documents_as_often_for_more_buckets(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(7 * i + j) % 50}" for j in range(30))) for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int")

    def run(least):
        monkeypatch.setattr(quality_rules, "LEAST", least)
        seen = spark.sparkContext.accumulator(0)

        def counted(row):
            seen.add(1)
            return row

        documents = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(counted), "doc_id bigint, text string")
        return len(quality_rules.quality_rules(documents, labels).collect()), seen.value

    assert run(1 << 24) == run(1 << 26)


def test_quality_rules_split_each_text_once_a_pass_and_write_a_slice_once(spark, monkeypatch):
    """No filter repeats the split, hashes are compiled, and both sides of a slice's join read one shuffle."""
    documents = spark.createDataFrame([(0, "a b\tc\rd a"), (1, None)], "doc_id bigint, text string")
    rows = quality_rules.grams_of(documents, quality_rules.row_key().alias("id"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array_remove(") == 1 and "lambda" not in plan
    assert rows.count() == 10
    monkeypatch.setattr(quality_rules, "ZIPPED", 3)
    assert [r["n_repeat_words"] for r in quality_rules.base_columns(spark.createDataFrame([(0, "a b c d e " * 3)], "doc_id bigint, text string")).collect()] == [15]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rare = rows.select(F.col("g").bitwiseAND(F.lit(7)).alias("b"), "id", F.lit(None).cast("struct<raw bigint, target bigint>").alias("counts"))
        out = quality_rules.summed_slice(rare.repartition(8, "b"), 0.5)
        assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


@pytest.mark.parametrize("bits", [24, 6])
def test_decontamination(spark, documents, texts, bits):
    words_of = lambda t: ALNUM_RE.findall((t or "").translate(LOW))
    items = [(0, " ".join(words_of(texts[8])[4:18])), (1, "one"), (2, None), (3, ""), (4, " ".join(words_of(texts[11])[:10])), (5, " ".join(words_of(texts[11])[:10])), (6, "not there at all")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = by_id(winnowing.contamination(documents, benchmark, bits=bits))
    for i, t in enumerate(texts):
        w, hit, found = words_of(t), set(), set()
        for item, x in items:
            q = words_of(x)
            n = min(10, len(q))
            for j in range(len(q) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == q[j : j + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item))
        want = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
        assert got[i][1:] == want, i
    assert not any(r["contaminated"] for r in winnowing.contamination(documents, benchmark.limit(0)).collect())


@pytest.mark.parametrize("bits", [24, 6])
def test_decontamination_of_null_and_repeated_ids(spark, bits):
    hot, other = " ".join(f"h{i}" for i in range(12)), " ".join(f"o{i}" for i in range(12))
    documents = spark.createDataFrame([(None, hot), (1, hot), (1, other)], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(0, hot), (0, hot), (None, hot), (None, other), (1, " ".join(f"n{i}" for i in range(12)))], "item_id bigint, text string")
    got = {(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in winnowing.contamination(documents, benchmark, bits=bits).collect()}
    assert got == {(None, 12, 12, 1), (1, 12, 12, 1), (1, 12, 12, 0)}
    left = winnowing.clean_rows(documents.unionByName(spark.createDataFrame([(1, "n0 n1"), (None, None)], documents.schema)), benchmark, bits=bits).collect()
    assert sorted(map(str, left)) == ["Row(doc_id=1, text='n0 n1')", "Row(doc_id=None, text=None)"]


def test_decontamination_of_equal_words_is_linear(spark):
    documents = spark.createDataFrame([(1, "w " * 200000), (2, "w " * 9)], "doc_id bigint, text string")
    got = winnowing.contamination(documents, spark.createDataFrame([("a", "w " * 200000)], "item_id string, text string")).collect()
    assert {tuple(r)[:4] for r in got} == {(1, 200000, 200000, 1), (2, 9, 0, 0)}


def test_packing(documents, texts):
    from tokenizers import Tokenizer

    rows = packing.pack(documents, TOKENIZER, capacity=64).where("doc_id IS NOT NULL").collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want = {(n, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], dtype="<u4").tobytes())) for n, s in enumerate(range(0, len(ids), 64))}
        assert {(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i} == want
    assert packing.pack(documents.limit(0), TOKENIZER).count() == 0


def test_plan_fills_sequences():
    r = random.Random(4)
    for _ in range(20):
        histogram = {r.randint(1, 50): r.randint(1, 40) for _ in range(25)} | {50: 7}
        used = Counter()
        spans: dict[int, list] = {}
        for run in packing.plan(histogram, 50):
            used[run.length] += run.count
            for k in range(run.count):
                spans.setdefault(run.sequence + k // run.each, []).append((run.offset + run.length * (k % run.each), run.length))
        assert used == Counter(histogram)
        for s in spans.values():
            s.sort()
            assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(s[-1]) <= 50
        assert len(spans) <= -(-sum(n * c for n, c in histogram.items()) // 50) * 1.15 + 1


def test_near_duplicates(documents, texts):
    got = by_id(near_dups.near_duplicates(documents))
    sets = []
    for t in texts:
        w = SPACED_RE.findall((t or "").translate(LOW))
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert [tuple(got[i])[:4] for i in range(len(texts))] == [(i, len(s), comp[i], comp[i] == i) for i, s in enumerate(sets)]
    assert near_dups.near_duplicates(documents.limit(0)).count() == 0


def brute_components(rows):
    """Least doc_id reachable of each row, over all pairs of sets."""
    sets = []
    for _, t in rows:
        w = SPACED_RE.findall(t.translate(LOW))
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))))
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sizes = np.array([len(s) for s in sets])
    for i, s in enumerate(sets):
        both = np.bincount(np.concatenate([holders[x] for x in s]), minlength=len(rows))
        for j in np.flatnonzero(100 * both >= 85 * (len(s) + sizes - both)):
            a, b = find(i), find(int(j))
            up[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {doc: least[find(i)] for i, (doc, _) in enumerate(rows)}


def pair_at_threshold(r, name, common=()):
    """Two texts of 296 shingles, 272 of which they share: a similarity of exactly 0.85."""
    w = [*common, *(f"v{r.randrange(20000)}" for _ in range(300 - len(common)))]
    return " ".join(w), " ".join([*w[:-24], *(f"z{name}_{k}" for k in range(24))])


def test_near_duplicates_at_the_threshold(spark):
    """3000 pairs just at the threshold: none may be lost."""
    r = random.Random(5)
    rows = [(2 * i + j, t) for i in range(3000) for j, t in enumerate(pair_at_threshold(r, i))]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert sum(x["component_id"] == x["doc_id"] - x["doc_id"] % 2 for x in got) == len(rows)


def test_near_duplicates_in_deep_nodes(spark, monkeypatch):
    """A passage that hundreds share, and hundreds of copies of one text, with limits so small that nodes branch many levels deep."""
    r = random.Random(6)
    passage, base = [f"p{k}" for k in range(170)], [f"q{r.randrange(5000)}" for _ in range(300)]
    rows = [(2 * i + j, t) for i in range(200) for j, t in enumerate(pair_at_threshold(r, i, passage))]
    for i in range(200):
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(300)] = f"m{r.randrange(9999)}"
        rows.append((1000 + i, " ".join(w)))
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    levels = []
    branching = near_dups.branching
    monkeypatch.setattr(near_dups, "branching", lambda trees: levels.append(trees) or branching(trees))
    monkeypatch.setattr(near_dups, "TARGETS", 16)
    monkeypatch.setattr(near_dups, "PROBES", 32)
    monkeypatch.setattr(near_dups, "LEADERS", 2)
    monkeypatch.setattr(near_dups.plausible_links, "__defaults__", (near_dups.TREES, 24, 12))
    monkeypatch.setattr(near_dups.confirmed, "__defaults__", (1 << 14,))
    got = {x["doc_id"]: x["component_id"] for x in near_dups.near_duplicates(documents).collect()}
    assert got == brute_components(rows)
    assert len(levels) >= 4


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one id with unlike texts each link their own copies; rows without an id link, too, and very long texts."""
    r = random.Random(8)
    a, b, c = ([f"{x}{r.randrange(9000)}" for _ in range(n)] for x, n in (("a", 200), ("b", 200), ("c", 60000)))
    near = lambda w: " ".join([*w[:-3], "x", "y", "z"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (7, near(a)), (8, near(b)), (None, " ".join(c)), (9, near(c)), (9, near(c)), (5, "")]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((x["doc_id"], x["component_id"], x["kept"]) for x in got if x["doc_id"]) == [(1, 1, True), (1, 1, True), (5, 5, True), (7, 1, False), (8, 1, False), (9, 9, True), (9, 9, True)]
    assert [x["component_id"] for x in got if x["doc_id"] is None] == [None]


def test_signatures_keep_pairs_at_the_threshold():
    """The filter on signatures loses a pair just at the threshold with less than 1e-5, and lets rows pass that agree in 40 of 64."""
    p, least = near_dups.PERCENT / 100, near_dups.AGREE
    assert least == 40 and sum(math.comb(near_dups.T, k) * p**k * (1 - p) ** (near_dups.T - k) for k in range(least)) < 1e-5
    x = np.arange(near_dups.T, dtype="<u4")
    sig = np.stack([x, np.where(x < 40, x, x + 1000), np.where(x < 39, x, x + 2000)])
    near = near_dups.plausible(np.array([100, 100, 100]), sig)
    assert near(0, np.array([1, 2])).tolist() == [1]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = near_dups.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert all(r["comp"] == find(r["id"]) for r in got)
    assert {r["id"] for r in got} == {x for a, b in edges if a != b for x in (a, b)}


class Walker:
    """The automaton as plain dicts over whole tables of counts, walked one token at a time."""

    def __init__(self, training):
        L = language_model
        one, two, three = (Counter(g for t in training for s in ([L.END, *t],) for g in zip(*(s[k:] for k in range(n)), strict=False)) for n in (1, 2, 3))
        self.one = Counter(x for t in training for x in t)
        self.n, self.v = self.one.total(), len(self.one)
        count = {(): 0} | {(x,): c for x, c in self.one.items()} | {g: c for g, c in two.items() if c >= L.MIN_STATE and g[1] != L.END}
        self.states = set(count)
        trust = lambda s: L.TRUST[len(s) - 1] * count[s] / (count[s] + L.KAPPA[len(s) - 1]) if s else 0
        self.back = {s: 1 - trust(s) for s in self.states}
        self.arcs = {((), x): (c - L.DISCOUNT) / self.n for x, c in self.one.items()}
        self.unseen = L.DISCOUNT * self.v / self.n
        for grams in (two, three):
            for g, c in grams.items():
                s = g[:-1]
                if s in self.states:
                    self.arcs[s, g[-1]] = trust(s) * c / count[s] + self.back[s] * self.weight(s[1:], g[-1])

    def weight(self, s, x):
        """By failure arcs until there is an arc; the root's for unseen words is a loop."""
        out = 1.0
        while (s, x) not in self.arcs:
            if not s:
                return out * self.unseen
            out, s = out * self.back[s], s[1:]
        return out * self.arcs[s, x]

    def score(self, tokens):
        s, total = (language_model.END,), 0.0
        for x in tokens:
            total += math.log10(self.weight(s, x))
            s = (*s, x)[-2:]
            while s not in self.states:
                s = s[1:]
        return total


@pytest.mark.parametrize("shuffled", [False, True])
def test_language_model(documents, texts, shuffled):
    got = by_id(language_model.score_texts(documents.orderBy(F.rand()).repartition(5) if shuffled else documents))
    tokens = [[*SPACED_RE.findall((t or "").translate(LOW)), language_model.END] for t in texts]
    walker = Walker([t for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 7 != 2] + [tokens[3]])  # the row without an id teaches
    assert sum(len(s) == 2 for s in walker.states) > 20
    n, v, one = walker.n, walker.v, walker.one
    for i, t in enumerate(tokens):
        base = sum(np.log10((one[x] + 1) / (n + v + 1)) for x in t)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 7 == 2, len(t), sum(one[x] > 0 for x in t), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(walker.score(t))
    # the weights out of each state sum to one
    for s in sorted(walker.states, key=str)[::7]:
        assert sum(walker.weight(s, x) for x in one) + walker.weight(s, "never seen") == pytest.approx(1)
    assert language_model.score_texts(documents.limit(0)).count() == 0


def test_licenses(spark, documents, texts):
    """Whole templates, wrapped over lines, with words missing or put in up to and beyond the threshold, and next to each other."""
    r, more = random.Random(9), []
    for label, text in licenses.TEMPLATES:
        w = text.split()
        for gone in (0, len(w) // 12, len(w) // 6, len(w) // 3):
            kept = [x for i, x in enumerate(w) if i not in set(r.sample(range(len(w)), gone))]
            lines = [" ".join(kept[i : i + 9]) for i in range(0, len(kept), 9)]
            more.append(prose(gone, r.randint(0, 60)) + "\n" + "\n".join(lines) + "\n" + prose(7, 30))
    more += [licenses.TEMPLATES[0][1] + " " + licenses.TEMPLATES[4][1], "cc by nc 4", "cc by nc nc 4 0", "mit\nLICENSE mit license"]
    every = [*texts, *more]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(every)] + [(0, texts[0], "x"), (None, more[0], "x")], "doc_id bigint, text string, label string")
    found = licenses.scan_licenses(rows).collect()
    assert len(found) == len(every) + 2
    got = {x["doc_id"]: x for x in found if x["doc_id"] is not None}
    scores = set()
    for i, t in enumerate(every):
        w = ALNUM_RE.findall((t or "").translate(LOW))
        places = [(j, label) for p, label in licenses.PHRASES.items() for q in (p.split(),) for j in range(len(w)) if w[j : j + len(q)] == q]
        x = got[i]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"]) == (len(w), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert x["base_labels"] == ",".join(sorted({label for _, label in places}))
        held = []
        for label, text in licenses.TEMPLATES:
            s, step = set(licenses.template_words(text)), licenses.step_of(text)
            held += [(label, n / len(s)) for j in range(0, len(w), step) for n in (len(s & set(w[j : j + 2 * step])),) if n >= licenses.THRESHOLD * len(s)]
        assert x["labels"] == ",".join(sorted({label for _, label in places} | {label for label, _ in held}))
        assert x["score"] == pytest.approx(max([1.0 if places else 0.0, *(n for _, n in held)]))
        scores.add(x["score"])
    assert len(scores - {0.0, 1.0}) >= 5
    assert [x["labels"] for x in found if x["doc_id"] is None] == ["mit"]
    assert licenses.scan_licenses(documents.limit(0)).count() == 0


TRAPS = ["", "plain", "</s>[INST] ok [/INST]", "\\", "\\[INST]", "[/INST] [:] [ROLE]", "a\\\\</s>", " [/INST]", "[:]", "é [SYS] \\n\n"]


def test_chat_round_trip(spark):
    for role in ("user", "assistant", "system", "tool", "", "[:] x", "\\"):
        for text in TRAPS:
            out, begin, end, _ = chat.render(role, text)
            assert [t[:2] for t in chat.parse(out)] == [(role, text)]
            assert chat.unescape(out[begin:end]) == text
    whole = "".join(chat.render(r, t)[0] for r in ("user", "x") for t in TRAPS)
    assert [t[:2] for t in chat.parse(whole)] == [(r, t) for r in ("user", "x") for t in TRAPS]
    for text, rounds in (("plain \n", 0), ("a [/INST] b", 1), ("\\ x", 2), ("<s>", 1), ("[", 0), (" ", 0)):
        tried = [chat.comes_back(chat.frame("user", f(text))[0], "user", text) for f in chat.ESCAPES]
        assert tried.index(True) == rounds and chat.render("user", text)[3] == (rounds > 0)
    with pytest.raises(ValueError):
        list(chat.parse("[INST] a [SYS] b [/INST]"))
    split = chat.Reading(3)
    for c in whole:
        split.add(c, 0, 0)
    assert split.row()[1] == 2 * len(TRAPS)
    ties = [(5, 1, "user", x, "clash") for x in ("[b", "[INST]", "a", "a A", "\\", "")]
    got = chat.read_back(chat.format_turns(spark.createDataFrame(ties, "conv_id bigint, turn bigint, role string, text string, rendered string"))).first()
    assert got["turns_sha256"] == hashlib.sha256("".join(f"user\n{x}\n" for x in sorted(t[3] for t in ties)).encode()).hexdigest()
    rows = [(c, t, r, x, "clash") for c in (1, None) for t, (r, x) in enumerate(zip(["user", "assistant", None, "tool"] * 3, [*TRAPS, None, "z"], strict=False))]
    got = chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, rendered string"))).collect()
    assert len(got) == 2
    said = [(r or "", x or "") for c, _, r, x, _ in rows if c == 1]
    loss = "".join(x for r, x in said if r == "assistant")
    for g in got:
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest()
        assert (g["n_turns"], g["loss_chars"], g["loss_sha256"]) == (12, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_marginals_against_enumeration():
    """Sum-product on a small tree against the sum over all its states."""
    tree = html_text.parse("<html><body><nav class=menu><a href=x>Home</a></nav><div class=post><p>One two</p><ul><li>x</li><li>y</li></ul></div></body></html>")
    x, parent, depth = html_text.features(tree)
    r = np.random.default_rng(2)
    model = html_text.Model(r.normal(size=html_text.SIZE), r.normal(size=(2, 2, html_text.EDGES)))
    own, pair = model.marginals(x, parent, depth)
    n, node, edge = len(x), x @ model.node, (html_text.edge_features(x) @ model.edge.reshape(4, -1).T).reshape(-1, 2, 2)
    weight, total, pairs = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for state in itertools.product((0, 1), repeat=n):
        s = np.array(state)
        w = math.exp(node @ s + sum(edge[i, s[parent[i]], s[i]] for i in range(n) if parent[i] >= 0))
        weight += w
        total += w * s
        for i in range(n):
            if parent[i] >= 0:
                pairs[i, s[parent[i]], s[i]] += w
    assert own == pytest.approx(total / weight) and pair == pytest.approx(pairs / weight)


def test_parsing_takes_time_by_length():
    for page in ("<div>" * 50000 + "</b></x>" * 50000, "<!-- " * 100000, "<!x" * 100000, "<b>" * 30000 + "<div>" + "<span>" * 30000 + "</b>" * 30000, "<span>" * 30000 + "<hr>" * 30000):
        began = time.perf_counter()
        html_text.parse(page)
        assert time.perf_counter() - began < 5


def test_main_text(spark):
    model = html_text.fit(PAGES)
    held = [_page(s) for s in range(5000, 5060)]
    right = sum(g == "\n\n".join(k) for g, (_, k) in zip(html_text.extract(model, [p for p, _ in held]), held, strict=True))
    assert right >= 55
    page = '<html><body><nav><a href=x>Home</a></nav><div class="ad">Buy</div><article><h1>T &amp; t</h1><p>One\n two<br>three<script>var x="</p>";</script><p>Four &eacute; <b>five</article><footer>(c)</footer>'
    assert html_text.extract(model, [page, None, "", "<p></p>"]) == ["T & t\n\nOne two three\n\nFour é five", "", "", ""]
    # pages written by hand, in other ways than the model's own, and with nothing around the text
    blog = (
        '<!doctype html><html><head><title>T</title></head><body><div id="wrapper"><div id="header"><a href="/">My blog</a><ul class="menu"><li><a href=1>Home</a></li></ul></div><div id="main"><div class="post"><h1>On rivers</h1>'
        '<p>Rivers carve valleys over long spans of time, and they carry silt.</p><p>Some flow <i>under</i> ground &mdash; in caves.</p><ul><li>First kind</li><li>Second kind</li></ul></div><div id="comments"><h3>Comments</h3>'
        '<p class="comment">Nice post, thank you for writing all of this!</p></div></div><div class="sidebar"><h3>Links</h3><a href=1>One</a></div><div id="footer">Copyright 2020</div></div></body></html>'
    )
    assert html_text.extract(model, [blog]) == ["On rivers\n\nRivers carve valleys over long spans of time, and they carry silt.\n\nSome flow under ground — in caves.\n\nFirst kind\n\nSecond kind"]
    for bare in ("<html><body><h2>Note</h2><p>A short page without any frame around its text.</p><p>Second paragraph here.</p></body></html>", "<h2>Note</h2><p>A short page without any frame around its text.</p><p>Second paragraph here."):
        assert html_text.extract(model, [bare]) == ["Note\n\nA short page without any frame around its text.\n\nSecond paragraph here."]
    rows = spark.createDataFrame([(1, "u", page, 5), (1, "u", page, 5), (2, None, None, 6)], "page_id bigint, url string, html string, text int")
    assert [r["n_chars"] for r in html_text.main_text(rows, PAGES[:60]).orderBy("page_id").collect()][-1] == 0


def labelled(spark, n=160):
    bad = ["trash", "vequance", "vequille", "vequoir"]
    rows, labels = [], []
    for i in range(n):
        r = random.Random(i)
        w = prose(i, r.randint(20, 90)).split()
        toxic, quality = i % 4 == 0, i % 5 != 1
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
        if not quality:
            w = [x.upper() + "!!" for x in w[:12]] * 4
            toxic = False
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(quality), int(toxic)))
    rows += [(n, None, "en", "s", 0), (n + 1, "", "en", "s", 0), (n + 2, "vequée trash", "en", "s", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize(("operator", "column"), [(quality_model.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_classifiers(spark, operator, column):
    documents, labels = labelled(spark)
    got = operator(documents, labels).join(labels, "doc_id", "left").collect()
    assert len(got) == 163 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r[column] is not None]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == r[column] for r in held) >= 0.9 * len(held)
    assert operator(documents.limit(0), labels).count() == 0
    assert len({r["score"] for r in operator(documents, labels.limit(0)).collect()}) >= 1


def test_gradients():
    """The network's hand-made gradients against differences, those of the spelling unit, too."""
    net = toxicity.Network(1)
    w = next(words(pa.array([prose(1, 30), prose(2, 9)]), ALNUM))
    v = toxicity.Vocabulary(w)
    first, size, _ = toxicity.windows(w.bounds)
    index = toxicity.window_index(v, first, size)
    net.p = {k: q.astype(np.float64) for k, q in net.p.items()}
    own = v.inputs(net.p["word"], net.p["char"]).astype(np.float64) + 0.1
    y, weight = np.arange(len(first)) % 2.0, np.ones(len(first))

    def loss():
        x = np.concatenate([own, net.spell(v.letters)[0]], axis=1)
        z = net.forward(net.gate_tables(x), index)[0]
        return float((np.logaddexp(0, z) - y * z).sum())

    states, tape = net.spell(v.letters, keep=True)
    grads, d_x = net.gradient(np.concatenate([own, states], axis=1), index, y, weight)
    grads |= net.spell_gradient(v.letters, tape, d_x[:, toxicity.BAG :])
    for k in ("Wf", "Ub", "bf", "A", "v", "o", "Us", "Ws", "bs", "byte"):
        at = tuple(s // 2 for s in net.p[k].shape) if k != "byte" else (ord("a"), 2)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-3
        high = loss()
        net.p[k][at] = old - 1e-3
        low = loss()
        net.p[k][at] = old
        assert grads[k][at] == pytest.approx((high - low) / 2e-3, rel=0.05, abs=1e-3), k


def naive_toxicity(net, text):
    """The worst window's score, one window, word, byte and n-gram at a time."""
    p = {k: q.astype(np.float64) for k, q in net.p.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))

    def unit(d, inputs):
        k, h, out = len(p[f"U{d}"]), np.zeros(len(p[f"U{d}"])), []
        for x in inputs:
            g, s = x @ p[f"W{d}"] + p[f"b{d}"], h @ p[f"U{d}"]
            z, r = sig(g[:k] + s[:k]), sig(g[k : 2 * k] + s[k : 2 * k])
            c = np.tanh(g[2 * k :] + r * s[2 * k :])
            h = c + z * (h - c)
            out.append(h)
        return out

    found = next(words(pa.array([text]), ALNUM))
    vectors = []
    for start, end, h in zip(found.starts, found.ends, found.hashes, strict=True):
        raw = bytes(found.data[start:end])
        marked, slots = bytes([1]) + raw + bytes([1]), []
        for n in toxicity.GRAMS:
            for j in range(max(len(marked) - n, 0) + 1):
                code = n
                for c in (marked + bytes([1] * n))[j : j + n]:
                    code = (code * 257 + c) % (1 << 64)
                slots.append(int(mix(np.array([code], dtype=np.uint64))[0] >> np.uint64(64 - toxicity.CHAR_BITS)))
        rows = p["char"][slots]
        word = p["word"][int(h >> np.uint64(64 - toxicity.WORD_BITS))]
        spelled = unit("s", [p["byte"][c] for c in raw[-toxicity.LETTERS :]])[-1]
        vectors.append(np.concatenate([word, rows.mean(axis=0), [rows[:, 0].max(), min(len(raw), 40) / 20], spelled]))
    best = -np.inf
    for at in range(0, max(1, len(vectors) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP):
        x = vectors[at : at + toxicity.WINDOW]
        pooled = np.zeros(2 * toxicity.HIDDEN)
        if x:
            h = np.concatenate([unit("f", x), unit("b", x[::-1])[::-1]], axis=1)
            e = np.tanh(h @ p["A"]) @ p["v"]
            a = np.exp(e - e.max())
            pooled = (a / a.sum()) @ h
        best = max(best, pooled @ p["o"] + p["c"][0])
    return sig(best)


def test_toxicity_scores_every_window(texts):
    """A trained network's scores against windows scored one by one."""
    sample = [(prose(i, 40) + (" vequance trash" if i % 2 else ""), i % 2) for i in range(60)]
    net = toxicity.fit(sample)
    odd = [t or "" for t in texts if len(t or "") < 3000] + [prose(5, 100) + " vequance trash " + prose(6, 50), "x" * 99]
    got = np.concatenate([net.score(w) for w in words(pa.array(odd), ALNUM)])
    for text, score in zip(odd, got, strict=True):
        assert score == pytest.approx(naive_toxicity(net, text), abs=1e-4)
    assert got[-2] > 0.5 > got[0]


def test_quality_scores_all_pairs(texts):
    """A trained machine's scores with every pair of features summed one by one; neighbours in a chunk change nothing."""
    sample = [(prose(i, 40) if i % 2 else "BUY NOW!! " * 9, i % 2) for i in range(60)]
    m = quality_model.fit(sample, epochs=2)
    odd = [t or "" for t in texts]
    together = np.concatenate([m.logits(quality_model.features(w)) for w in words(pa.array(odd), SPACED, lower=False)])
    for text, logit in zip(odd, together, strict=True):
        f = quality_model.features(next(words(pa.array([text]), SPACED, lower=False)))
        assert m.logits(f)[0] == logit
        x = np.concatenate([f.values, f.structure[0]])
        at = np.concatenate([f.slots, np.arange(1 << quality_model.BITS, len(m.linear))])
        if len(x) < 400:
            v = m.factors[at] * x[:, None]
            pairs = sum(float(v[i] @ v[j]) for i in range(len(x)) for j in range(i))
            assert logit == pytest.approx(m.bias + m.linear[at] @ x + pairs, rel=1e-6, abs=1e-9)


def written(spark, folder, documents, labels, benchmark):
    documents.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_stages(spark, tmp_path):
    """Every stage against what it must keep of the one before, by brute force; nulls, repeated rows and clashing columns among them."""
    documents, labels = labelled(spark)
    copied = documents.where("doc_id IN (4, 5, 6, 8)").withColumn("text", F.concat("text", F.lit(" end"))).withColumn("doc_id", F.col("doc_id") + 1000)
    twice = documents.where("doc_id = 9")
    leaked = spark.createDataFrame([(None, prose(2, 60), "en", "s", 0), (3000, prose(500, 50) + " " + " ".join(prose(2, 90).split()[20:45]), "en", "s", 0), (None, prose(501, 80), "en", "s", 0)], documents.schema)
    documents = documents.unionByName(copied).unionByName(twice).unionByName(leaked)
    documents = documents.select("*", F.lit("a").alias("quality_score"), F.lit("b").alias("toxicity_score"), F.lit(1).alias("text_hash"), F.lit(2).alias("kept"))
    written(spark, tmp_path, documents, labels, [(1, prose(2, 90)), (None, "x" * 50), (2, None)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    for name, stage in corpus_pipeline.STAGES:
        before = rows(docs)
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        ids = {r[0] for r in before}
        if name != "packing":
            assert after.columns == docs.columns
        got = rows(after)
        if name == "quality":
            model = quality_model.train(docs, labels)
            score = {r["doc_id"]: r["quality_score"] for r in quality_model.score_quality(docs.select("doc_id", "text"), model).collect()}
            assert all(score[i] >= 0.3 for i in {r[0] for r in got}) and all(score[i] < 0.3 for i in ids - {r[0] for r in got})
            assert not {r["doc_id"] for r in labels.where("quality = 0").collect()} & {r[0] for r in got}
        if name == "near_duplicates":
            known = [(r[0], r[1]) for r in before if r[0] is not None and (r[1] or "").strip()]
            comp = brute_components(known)
            assert got == [r for r in before if r[0] is None or comp.get(r[0], r[0]) == r[0]]
            assert not {1005, 1006} & {r[0] for r in got}
        if name == "decontamination":
            items = prose(2, 90).translate(LOW)
            held = {tuple(w[j : j + 10]) for w in (ALNUM_RE.findall(items),) for j in range(len(w) - 9)} | {("x" * 50,)}
            hit = lambda t: any(tuple(w[j : j + n]) in held for w in (ALNUM_RE.findall((t or "").translate(LOW)),) for n in (1, 10) for j in range(len(w)))
            assert got == [r for r in before if not hit(r[1])] and len(got) < len(before)
            assert any(r[0] is None for r in got)
        if name == "packing":
            assert {r["doc_id"] for r in after.collect()} == ids
            assert after.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= packing.CAPACITY
        docs = after
    assert rows(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length")) == rows(docs.select("doc_id", "piece", "length"))


def test_pipeline_of_empty_tables(spark, tmp_path):
    documents, labels = labelled(spark, 4)
    written(spark, tmp_path, documents.limit(0), labels.limit(0), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
