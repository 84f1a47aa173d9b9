"""Homomorphic multiset fingerprints (DataFrame functions only).

A text is the multiset of its paragraphs: the sentences of its lines, those of
more than ``PIECE`` characters cut into pieces of that length from their start.
MD5 hashes a paragraph to a wide vector: each of ``DENSE`` lanes gets 32 bits,
and in each stratum that the paragraph is in, one of ``LANES`` lanes gets a
non-zero 32-bit value.  All paragraphs are in stratum 0, a quarter of them in
stratum 1, a sixteenth in stratum 2, and so on.  The fingerprint is the sum of
the vectors modulo 2^32 in each lane, so it doesn't depend on order, and
inserting or deleting a paragraph adds or subtracts its vector.  All lanes
decide equality.  The share of equal lanes among those that either text uses
estimates how much of the two multisets agrees; it is taken from the first
stratum that isn't crowded, so that it holds for short and long texts alike.

Defined results: a null text is the empty text, whose vector is zero; two
zero vectors are alike (1.0); rows of one doc_id stand in the order of their
text; a table of one row has itself as the next document; null doc_ids come
last; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PIECE, DENSE = 128, 4
#: A line, or a sentence of it with what closes it, or the first characters of a longer one.
PARAGRAPH = rf"[^\n.!?]{{1,{PIECE}}}[.!?]*|[.!?]{{1,{PIECE}}}"
#: Strata, lanes of each, and lanes in use from which a stratum is crowded.
STRATA, LANES, CROWDED = 6, 32, 24
SPARSE = STRATA * LANES
MODULUS = 1 << 32
#: Rows aimed at for a run of the key order, and most runs.
PER_BUCKET, MOST_BUCKETS = 4_000, 1 << 16


def paragraphs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PARAGRAPH), 0)


def vector(text: Column) -> Column:
    """``SPARSE + DENSE`` lanes of 32 bits, as longs."""

    def word(digest: Column, k: int) -> Column:
        return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")

    def parts(paragraph: Column) -> Column:
        return F.transform(
            F.array(F.md5(paragraph.cast("binary"))),
            lambda d: F.struct(
                (word(d, 0) % LANES).alias("lane"), (word(d, 0) * 4 + word(d, 1) % 4 + 1).alias("value"), word(d, 2).alias("level"),
                *[word(d, k).alias(f"d{k}") for k in range(DENSE)],
            ),
        )

    def stratum(hashed: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(LANES - 1)),
            lambda lane: F.aggregate(
                F.filter(hashed, lambda p: p["lane"] == lane), F.lit(0).cast("long"),
                lambda acc, p: (acc + p["value"] % (MODULUS - 1) + 1) % MODULUS,
            ),
        )

    def summed(hashed: Column) -> Column:
        """A stratum's paragraphs are those of the one before whose level is a multiple of the next power of four."""

        def within(s: int) -> Column:  # a lambda argument: filtered once for all lanes
            kept = F.filter(hashed, lambda p: p["level"] % 4**s == 0) if s else hashed
            return F.transform(F.array(kept), stratum)[0]

        strata = [within(s) for s in range(STRATA)]

        def dense_lane(k: int) -> Column:
            return F.aggregate(hashed, F.lit(0).cast("long"), lambda acc, p: (acc + p[f"d{k}"]) % MODULUS)

        return F.concat(*strata, F.array(*[dense_lane(k) for k in range(DENSE)]))

    # hashed once: the array of structs is a lambda argument
    hashed = F.flatten(F.transform(paragraphs(text), parts))
    return F.element_at(F.transform(F.array(hashed), summed), 1)


def add(left: Column, right: Column) -> Column:
    """Fingerprint vector of the union of two multisets."""
    return F.zip_with(left, right, lambda a, b: (a + b) % MODULUS)


def subtract(left: Column, right: Column) -> Column:
    """Fingerprint vector after taking the right multiset out of the left."""
    return F.zip_with(left, right, lambda a, b: (a - b + MODULUS) % MODULUS)


def to_hex(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(left: Column, right: Column) -> Column:
    """Equal lanes over lanes in use, in the first stratum that isn't crowded (the last, if all are).

    A stratum with under a quarter of that use tells less than the one before
    it, which is taken instead; two zero vectors are alike (1.0).
    """
    seen = F.zip_with(
        F.slice(left, 1, SPARSE), F.slice(right, 1, SPARSE),
        lambda a, b: F.when((a == 0) & (b == 0), 0).when(a == b, 2).otherwise(1),
    )

    def counted(lanes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(STRATA - 1)), lambda s: F.struct(
            F.size(F.filter(F.slice(lanes, s * LANES + 1, LANES), lambda x: x > 0)).alias("used"),
            F.size(F.filter(F.slice(lanes, s * LANES + 1, LANES), lambda x: x == 2)).alias("same"),
        ))

    def chosen(strata: Column) -> Column:
        first = F.aggregate(strata, F.lit(0), lambda at, s: at + F.when(
            (at < STRATA - 1) & (F.get(strata, at)["used"] > CROWDED), 1).otherwise(0))
        return F.transform(F.array(first), lambda k: F.get(strata, F.when((k > 0) & (F.get(strata, k)["used"] < CROWDED // 4), k - 1).otherwise(k)))[0]

    best = F.transform(F.array(F.transform(F.array(seen), counted)[0]), chosen)
    return F.transform(best, lambda s: F.when(s["used"] == 0, F.lit(1.0)).otherwise(s["same"].cast("double") / s["used"].cast("double")))[0]


def deal_in_order(docs: DataFrame, key: str) -> DataFrame:
    """Adds ``__bucket``: runs of the descending key order, of about ``PER_BUCKET`` rows, nulls in the last.

    The runs' ends are quantiles of the keys of all rows, however these lie;
    their list is bounded by ``MOST_BUCKETS``.
    """
    ends = min(MOST_BUCKETS, docs.count() // PER_BUCKET)
    if not ends:
        return docs.withColumn("__bucket", F.lit(0))
    shares = F.lit([(i + 1) / (ends + 1) for i in range(ends)])
    found = docs.agg(F.percentile_approx(key, shares, F.lit(max(10_000, 10 * ends))).alias("q")).first()["q"] or []
    bounds = sorted(set(found), reverse=True)
    steps = F.lit([1 << k for k in reversed(range(max(1, len(bounds)).bit_length()))])
    known = F.lit(bounds).cast("array<bigint>")
    # as many leading bounds as are greater than the key, by halving
    place = F.aggregate(steps, F.lit(0), lambda at, s: at + F.when(F.get(known, at + s - 1) > F.col(key), s).otherwise(0))
    return docs.withColumn("__bucket", F.when(F.col(key).isNull(), F.lit(len(bounds))).otherwise(place))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Each row with the text and the vector of the next row by descending key (after the last: the first).

    No single window over all rows: rows are dealt out in key order, and the
    first row of each bucket goes into the bucket before it as well.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = deal_in_order(rows, "doc_id")
    rows = rows.withColumn("__tie", F.sha2(F.col("text").cast("binary"), 256))
    firsts = rows.groupBy("__bucket").agg(
        F.max(F.struct(F.col("doc_id").isNotNull().alias("k"), F.col("doc_id").alias("id"))).alias("first")
    ).collect()  # one row for each bucket: at most MOST_BUCKETS + 1
    order = sorted((r["__bucket"], r["first"]["id"]) for r in firsts)
    before = [(order[i][1], order[i - 1][0]) for i in range(len(order))]
    halo = docs.sparkSession.createDataFrame(before, "__id long, __to int")
    own = F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("halo"))
    ahead = F.struct(F.col("__to").alias("b"), F.lit(1).alias("halo"))
    places = F.when(F.col("__to").isNull(), F.array(own)).otherwise(F.array(own, ahead))
    whole = rows.join(F.broadcast(halo), rows["doc_id"].eqNullSafe(halo["__id"]), "left").select(
        "doc_id", "text", "__tie", F.explode(places).alias("__place")
    ).select("doc_id", "text", "__tie", F.col("__place.b").alias("__bucket"), F.col("__place.halo").alias("__halo"))
    whole = whole.withColumn("__vector", vector(F.col("text")))
    w = Window.partitionBy("__bucket").orderBy("__halo", F.col("doc_id").desc_nulls_last(), "__tie")
    return whole.withColumns({
        "__next_text": F.lead("text").over(w), "__next_vector": F.lead("__vector").over(w),
    }).filter("__halo = 0")


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Edited: the last third of the characters gives way to as many from the
    start of the next document.
    """
    rows = with_next(docs, key, text)
    n = F.length("text")
    third = F.floor(n / F.lit(3)).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("__next_text"), F.lit(1), third))
    rows = rows.withColumn("__edited", edited).withColumn("__edited_vector", vector(F.col("__edited")))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"),
        F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"),
        to_hex(F.col("__vector")).alias("fingerprint"),
        to_hex(F.col("__edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("__vector"), F.col("__edited_vector")).alias("near_edited"),
        likeness(F.col("__vector"), F.col("__next_vector")).alias("near_next"),
    )


def insert_paragraph(lanes: Column, paragraph: Column) -> Column:
    return add(lanes, vector(paragraph))


def delete_paragraph(lanes: Column, paragraph: Column) -> Column:
    return subtract(lanes, vector(paragraph))


def union_all(vectors: list[Column]) -> Column:
    return reduce(add, vectors)
