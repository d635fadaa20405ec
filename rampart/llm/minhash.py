"""Document fingerprints: one-permutation MinHash with optimal densification.

A document's word shingles are hashed once; the hash's high bits name a bin
and each bin keeps its smallest hash.  An empty bin takes the value of a
non-empty one: it tries hashed bins in an order that depends only on the bin,
so two documents with the same empty bin try the same ones.  The low bits of
each bin's value are stored; the share of equal stored values estimates the
Jaccard similarity after correcting for chance matches.

Everything here is Spark column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampart.llm.common import partitions, range_buckets

BINS_LOG2 = 8
BINS = 1 << BINS_LOG2
BITS = 8                    # stored bits of a bin's value
WORDS = 5
TRIES = 8                   # hashed bins tried one by one before ranking all non-empty bins


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """63-bit hashes of the word shingles, repeated ones too.

    Words are lower-cased runs without ASCII white space; a text with fewer
    than ``words`` words has its whole sequence as one shingle, and one
    without words has none.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    parts = F.array_remove(F.split(low, "[\\x20\\x09-\\x0D]+"), "")
    mask = F.lit((1 << 63) - 1)

    def of(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(1), n - (words - 1)), lambda i: F.xxhash64(
            *[F.element_at(w, i + j) for j in range(words)]).bitwiseAND(mask))
        one = F.array(F.xxhash64(F.array_join(F.transform(w, lambda h: h.cast("string")), " ")).bitwiseAND(mask))
        return F.when(n >= words, many).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(parts, lambda p: F.xxhash64(p)), of)


def bin_codes(hashes: Column) -> Column:
    """Low bits of each bin's least hash as tinyint, null for an empty bin."""
    shift = 63 - BINS_LOG2
    top = (1 << shift) - 1
    # one largest value per bin stands for "empty"; after sorting, the first
    # entry of each bin is its least hash
    ends = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(BINS - 1).cast("bigint")),
                       lambda b: F.shiftleft(b, shift).bitwiseOR(F.lit(top)))

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (
            F.shiftright(x, shift) != F.shiftright(F.element_at(s, F.greatest(i, F.lit(1))), shift)))

    least = let(F.sort_array(F.concat(hashes, ends)), firsts)
    low = F.lit((1 << BITS) - 1)
    return F.transform(least, lambda x: F.when(
        x.bitwiseAND(F.lit(top)) != top, (x.bitwiseAND(low) - (1 << (BITS - 1))).cast("tinyint")))


def densify(codes: Column) -> Column:
    """Fill each empty bin from a non-empty one; all empty gives an empty array."""

    def fill(c: Column) -> Column:
        bins = F.sequence(F.lit(0), F.lit(BINS - 1))

        def with_full(full: Column) -> Column:
            def value(x: Column, i: Column) -> Column:
                tries = [F.element_at(c, (F.pmod(F.xxhash64(i, F.lit(a)), F.lit(BINS)) + 1).cast("int"))
                         for a in range(TRIES)]
                ranked = F.array_min(F.transform(full, lambda j: F.struct(
                    F.xxhash64(i, F.lit(TRIES), j).alias("r"), F.element_at(c, j + 1).alias("c"))))["c"]
                return F.coalesce(x, *tries, ranked)

            return F.when(F.size(full) == 0, F.array().cast("array<tinyint>")).otherwise(F.transform(c, value))

        return let(F.filter(bins, lambda j: F.element_at(c, j + 1).isNotNull()), with_full)

    return let(codes, fill)


def signature(text: Column, words: int = WORDS) -> Column:
    """Fingerprint of a text as an array of ``BINS`` tinyints (empty without words)."""
    return densify(bin_codes(shingle_hashes(text, words)))


def packed(sig: Column) -> Column:
    """Fingerprint as text: two hexadecimal digits a bin."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x.cast("int") + (1 << (BITS - 1))), 2, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1.

    Unequal values agree by chance in one of 2**BITS bins, which is taken
    out.  Two empty fingerprints are alike, an empty and another are not.
    """
    chance = 2.0 ** -BITS
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    share = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    both = F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(
        (F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
    return both.otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))


def with_next(rows: DataFrame, order: str, then: list[str], values: list[str]) -> DataFrame:
    """Each row with ``next_<value>`` of the row after it by (order, then); the
    last row's next is the first.

    Rows are dealt to quantile buckets of ``order``; the first rows of each
    bucket are copied behind the rows of the bucket before, so every window
    is one bucket.
    """
    spark = rows.sparkSession
    dealt, _ = range_buckets(rows, order, 4 * partitions(spark))
    # one row per bucket
    heads = sorted((r["bucket"], r["head"]) for r in dealt.groupBy("bucket").agg(
        F.min(F.col(order)).alias("head"), F.count_if(F.col(order).isNull()).alias("nulls"))
        .select("bucket", F.when(F.col("nulls") == 0, F.col("head")).alias("head")).collect())
    if not heads:
        heads = [(0, None)]
    before = [(b, h, heads[i - 1][0]) for i, (b, h) in enumerate(heads)]
    small = F.broadcast(spark.createDataFrame(before, "bucket int, head bigint, before int"))
    first = F.col(order).eqNullSafe(F.col("head"))
    copies = F.when(first, F.array(F.struct("bucket", F.lit(0).alias("late")),
                                   F.struct(F.col("before").alias("bucket"), F.lit(1).alias("late"))))
    placed = (dealt.join(small, "bucket").withColumn("place", F.explode(copies.otherwise(
        F.array(F.struct("bucket", F.lit(0).alias("late"))))))
        .drop("bucket", "head", "before"))
    w = Window.partitionBy("place.bucket").orderBy("place.late", F.col(order).asc_nulls_first(), *then)
    return (placed.select("*", *[F.lead(v).over(w).alias(f"next_{v}") for v in values])
            .where("place.late = 0").drop("place"))


def edited_fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    The edited text is the text with its last floor(n_chars / 2) code points
    replaced by the first as many (or all) of the next document's, by
    ascending doc_id (null ids first, equal ids by text); after the last
    comes the first, and a single document follows itself.  A null text is
    empty and has an empty fingerprint.  Repeated rows stay; other columns
    are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("sig", signature(F.col("text"), words))
    near = with_next(rows, "doc_id", ["text"], ["text", "sig"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    near = near.select("doc_id", n.cast("bigint").alias("n_chars"), "sig", "next_sig", edited.alias("edited"))
    near = near.withColumn("edited_sig", signature(F.col("edited"), words))
    return near.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       packed(F.col("sig")).alias("fingerprint"), packed(F.col("edited_sig")).alias("edited_fingerprint"),
                       likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
                       likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))
