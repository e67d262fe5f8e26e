"""Quality rules: hashed n-gram log-likelihood ratio of each whole text, DataFrame functions only.

Two multinomials over hashed word unigrams and bigrams are counted: one over the trusted target (documents labelled of
good quality), one over the raw corpus (all documents). A text's score is the sum over its n-grams of the log of the
target count over the count expected from the raw corpus, divided by their number; a text below `threshold` is
rejected, the same for every row. An n-gram that stands once in the raw corpus tells of no other text and counts 0.

There are at least as many buckets as distinct n-grams (counted on the hashes that are 0 modulo SAMPLE), so junk and
ordinary n-grams don't mix as the corpus grows. At most 2 * SLOTS frequent n-grams are counted apart, by sums that are
combined before the shuffle, and looked up in an array (a scalar subquery). Each occurrence of any other goes once
through the shuffle with its row's key, to where its bucket's rows meet, and sums of ratios go back by key; from LARGE
buckets on that is done in SLICES passes. So the number of passes over the documents doesn't grow with the buckets, no
table of buckets is ever held, and no bucket of rare n-grams is large. The ratios are whole multiples of 1 / SCALE and
their sums exact, whatever n-grams count as frequent. No text is ever shuffled, except to meet labels too many to broadcast.

Null and empty texts have no words: counts 0, llr 0, base_failed true (fewer than 10 words), kept false. Repeated
rows are scored alike. An empty table gives an empty result. Without trusted labels the target equals the raw
corpus, all ratios are 0 and only the base rules decide. Columns beyond doc_id and text are not touched unless
`keep` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.tables import BROADCAST_LABELS, clean_labels
from umbra.session import broadcast_if_small, cut, let_go

#: Buckets at least.
LEAST = 1 << 15
#: From LARGE buckets on, rare n-grams meet in SLICES passes, so that the shuffle files of one are on disk at a time; of TASK rows a task.
LARGE, SLICES, TASK = 1 << 24, 2, 1 << 20
#: Frequent n-grams are found on every DOCS-th text and those of more than LONG characters; at most two for each of SLOTS slots.
DOCS, LONG, SLOTS = 16, 1 << 16, 1 << 19
#: Distinct n-grams are counted on one of so many hashes.
SAMPLE = 64
#: Ratios are kept in 1 / SCALE.
SCALE = 1024
#: Texts score -inf..inf around 0; junk lies far below, ordinary prose near 0.
THRESHOLD = -0.3
#: Weight of the pseudo-counts, in counts a bucket.
SMOOTHING = 1.0
#: Windows of more words than this aren't made by structs.
ZIPPED = 1 << 18
#: Bits of a window's place beside its hash while repeats are sorted; longer texts sort both whole.
PLACE_BITS = 24
WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """Words between spaces, which a plain split finds in half the time of a pattern; only texts that hold other white space than \\n have that replaced."""
    usual = F.replace(text, F.lit("\n"), F.lit(" "))
    seldom, held = usual, F.lit(False)
    for white in "\t\x0b\x0c\r":
        seldom, held = F.replace(seldom, F.lit(white), F.lit(" ")), held | F.contains(text, F.lit(white))
    return F.array_remove(F.split(F.when(held, seldom).otherwise(usual), " "), "")


def bind(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def windows() -> Column:
    """Hashes of a row's 5-word windows. Structs of neighbours are made and hashed in a third of the time of looking each word up; long texts need too many at once."""
    n = F.size("words") - 4
    of = F.arrays_zip(*(F.slice("words", F.lit(1 + j), F.greatest(n, F.lit(0))).alias(f"w{j}") for j in range(5)))
    long = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.get("words", i + j) for j in range(5))))
    return F.when(n > ZIPPED, long).otherwise(F.transform(of, lambda w: F.xxhash64(w)))


def repeated_words() -> Column:
    """Number of words inside 5-word windows that stand twice or more in the text; only texts whose windows (`fives`) don't all differ sort them."""
    n = F.size("words")

    def covered(places: Column) -> Column:
        """places: sorted starts; each covers 5 words, or as many as come before the next start."""
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("total"), F.lit(-5).alias("last")),
            lambda a, p: F.struct((a["total"] + F.least(p - a["last"], F.lit(5))).alias("total"), p.alias("last")),
        )["total"]

    low = (1 << PLACE_BITS) - 1

    def twice(h: Column, s: Column) -> Column:
        """h: hashes of the windows; s: sorted (high bits of hash, place in the low ones). Neighbours in s with equal whole hashes repeat."""
        at = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
        same = lambda x, y: F.coalesce(F.get(h, at(x)) == F.get(h, at(y)), F.lit(False))
        places = F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), at)
        return covered(F.sort_array(places))

    def twice_wide(s: Column) -> Column:
        """The same of texts whose places don't fit in the low bits; s: sorted (hash, place)."""
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        places = F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x["i"])
        return covered(F.sort_array(places))

    packed = lambda h: F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("bigint"))))
    pairs = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    h = F.col("fives")
    repeats = F.when(n <= low, bind(packed(h), lambda s: twice(h, s))).otherwise(bind(pairs(h), twice_wide))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeats).cast("bigint")


def base_columns(documents: DataFrame, *columns: Column) -> DataFrame:
    """doc_id, the base counts, and columns of the text (empty for null)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    return (
        documents.select("doc_id", text.alias("text"), words_of(text).alias("words"))
        .select("*", windows().alias("fives"), lines.alias("lines"))
        .select(
            "doc_id",
            F.size("words").cast("bigint").alias("n_words"),
            F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
            F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
            repeated_words().alias("n_repeat_words"),
            *columns,
        )
    )


def buckets_for(n: int) -> int:
    """Number of buckets for n distinct n-grams: a power of two."""
    return max(LEAST, 1 << max(n - 1, 0).bit_length())


def row_key() -> Column:
    """Names a row's id and text in 63 bits; rows that share it have equal n-grams and labels."""
    return F.shiftright(F.xxhash64("doc_id", "text"), 1)


def grams_of(documents: DataFrame, *columns: Column) -> DataFrame:
    """A row for each word and each adjacent pair of each text, the last word standing as a pair, too: its hash g, and columns of the document.

    All of it is compiled. An outer explode, as Spark splits the texts once more to leave out empty ones before an inner one.
    """
    text = F.coalesce("text", F.lit(""))
    named = documents.select(words_of(text).alias("words"), *columns)
    others = [c for c in named.columns if c != "words"]
    each = named.select(*others, "words", F.posexplode_outer("words").alias("i", "w")).where("w IS NOT NULL")
    after = F.get("words", F.col("i") + 1)
    each = each.select(*others, "words", "i", F.xxhash64("w").alias("x"))
    pair = F.when(after.isNull(), F.xxhash64("x")).otherwise(F.xxhash64("x", F.xxhash64(after)))
    # not by unpivot, whose plans Spark doesn't know as equal, so that a shuffle read twice would be written twice
    return each.select(*others, F.explode(F.array("x", pair)).alias("g"))


def frequent_grams(documents: DataFrame) -> DataFrame:
    """(g, place) of n-grams that are frequent in every DOCS-th text and in very long ones, at most two a slot; place: 2 * slot, or one more.

    This chooses how an n-gram is counted, never what is counted.
    """
    some = documents.where((F.pmod(row_key(), F.lit(DOCS)) == 0) | (F.length("text") > LONG))
    seen = grams_of(some).groupBy("g").count().where("count > 1").withColumn("slot", F.col("g").bitwiseAND(F.lit(SLOTS - 1)))
    rank = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("count"), "g"))
    return cut(seen.withColumn("rank", rank).where("rank <= 2").select("g", (2 * F.col("slot") + F.col("rank") - 1).alias("place")), light=True)


def table_of(places: DataFrame, column: str, empty: Column) -> DataFrame:
    """One row t, written: an array over the 2 * SLOTS places of places' column, or of empty where a place has no row."""
    every = places.sparkSession.range(2 * SLOTS).withColumnRenamed("id", "place").join(places, "place", "left")
    rows = every.select(F.struct("place", F.coalesce(F.col(column), empty).alias("value")).alias("x"))
    return cut(rows.agg(F.sort_array(F.collect_list("x")).alias("t")).select(F.col("t.value").alias("t")))


def with_place(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows with the place of g among keys, the table of frequent n-grams, or null."""
    first = (2 * F.col("g").bitwiseAND(F.lit(SLOTS - 1))).cast("int")
    rows = rows.withColumn("keys", keys.scalar()).withColumn("first", first)
    held = F.when(F.get("keys", F.col("first")) == F.col("g"), F.col("first")).when(F.get("keys", F.col("first") + 1) == F.col("g"), F.col("first") + 1)
    return rows.withColumn("place", held).drop("keys", "first")


def ratio_sums(documents: DataFrame, labels: DataFrame, block: int | None = None) -> DataFrame | None:
    """(key, total, n) of every text with words: the sum of its n-grams' ratios and their number, over all rows with that key; None without a target."""
    trusted = broadcast_if_small(clean_labels(labels, "quality").where("label = 1").select("doc_id", F.lit(1).alias("trusted")), BROADCAST_LABELS)
    # no n-gram of a slot equals a number that ends in other bits
    keys = table_of(frequent_grams(documents), "g", F.shiftright("place", 1).bitwiseXOR(F.lit(1)))
    both = documents.where(F.col("text").isNotNull()).join(trusted, "doc_id", "left")
    rows = grams_of(both, row_key().alias("key"), F.coalesce("trusted", F.lit(0)).alias("trusted"))
    placed = with_place(rows, keys)
    # counted whole: frequent n-grams, one hash of SAMPLE, and all others together
    named = F.when(F.col("place").isNotNull() | (F.pmod("g", F.lit(SAMPLE)) == 0), F.col("g"))
    counts = placed.select(named.alias("g"), "place", "trusted").groupBy("g", "place").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))
    counts = cut(counts)
    let_go(counts)
    distinct = F.count_if(F.pmod("g", F.lit(SAMPLE)) == 0)
    n_raw, n_target, distinct, n_rare = counts.agg(F.sum("raw"), F.sum("target"), distinct, F.sum(F.when(F.col("place").isNull(), F.col("raw")))).first()
    if not n_target:
        return None
    buckets = buckets_for(SAMPLE * distinct)
    slices = SLICES if buckets >= LARGE else 1
    if block:
        slices = max(slices, buckets // block)
    bucket = F.col("g").bitwiseAND(F.lit(buckets - 1)).alias("b")
    known = counts.where("place IS NOT NULL").select(bucket, F.col("place").cast("bigint").alias("id"), F.struct("raw", "target").alias("counts"))
    # no fewer than Spark's own number, to which it would deal one side of the join again
    parts = max(1 + (n_rare or 0) // slices // TASK, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = None
    for at in range(slices):
        inside = lambda x: x.where((F.col("b") >= at * buckets // slices) & (F.col("b") < (at + 1) * buckets // slices))  # noqa: B023, E731
        # the slice is left first, as looking up costs more
        rare = with_place(inside(rows.select("key", "trusted", "g", bucket)), keys).where("place IS NULL")
        rare = rare.select("b", F.shiftleft("key", 1).bitwiseOR(F.col("trusted").cast("bigint")).alias("id"), F.lit(None).cast("struct<raw bigint, target bigint>").alias("counts"))
        part = rare.unionByName(inside(known))
        part = cut(summed_slice(part.repartition(parts, "b"), n_target / n_raw), light=True)
        sums = part if sums is None else sums.unionByName(part)
        let_go(part, rounds=5)
    ratios = table_of(sums.where("frequent").select(F.col("id").alias("place"), "total"), "total", F.lit(0).cast("bigint"))
    every = with_place(grams_of(documents, row_key().alias("key")), keys).withColumn("ratios", ratios.scalar())
    every = every.groupBy("key").agg(F.sum(F.coalesce(F.get("ratios", F.col("place")), F.lit(0).cast("bigint"))).alias("total"), F.count("*").alias("n"))
    rest = sums.where("NOT frequent").select(F.shiftright("id", 1).alias("key"), "total", F.lit(0).cast("bigint").alias("n"))
    return every.unionByName(rest).groupBy("key").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def summed_slice(rows: DataFrame, share: float) -> DataFrame:
    """(frequent, id, total): sums of ratios by the rows' ids, or ratios by the frequent n-grams' places.

    rows: (b, id, counts), dealt by b: one for each rare n-gram of a text (counts null; id: twice its key, and 1 if trusted) and each frequent one with its counts.
    share: the target's part of the raw n-grams. Both sides of the join read all columns and so the same shuffle, without sorting it.
    """
    one = F.lit(1).cast("bigint")
    raw, target = F.coalesce("counts.raw", one), F.coalesce("counts.target", F.col("id").bitwiseAND(one))
    counted = rows.groupBy("b").agg(F.sum(raw).alias("r"), F.sum(target).alias("t")).where("r > 1")
    smooth = F.lit(float(SMOOTHING))
    ratio = F.round(SCALE * F.log((F.col("t") + smooth) / (F.col("r") * F.lit(share) + smooth))).cast("bigint")
    ratios = counted.select("b", ratio.alias("ratio")).hint("shuffle_hash")
    return rows.join(ratios, "b").groupBy(F.col("counts").isNotNull().alias("frequent"), "id").agg(F.sum("ratio").alias("total"))


def quality_rules(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, block: int | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept of every row; block: buckets of a slice at most."""
    sums = ratio_sums(documents, labels, block)
    scored = base_columns(documents, row_key().alias("key"))
    if sums is None:
        scored = scored.drop("key").withColumn("llr", F.lit(0.0))
    else:
        scored = scored.join(sums, "key", "left").withColumn("llr", F.coalesce(F.col("total") / F.lit(float(SCALE)) / F.col("n"), F.lit(0.0))).drop("key", "total", "n")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))
