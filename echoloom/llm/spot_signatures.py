"""Document fingerprints by spot signatures.

A spot is an anchor with the next CHAIN content words after it, common words skipped. Common words are the anchors; a
text with fewer than LEAST_SPOTS spots (tables, lists, a line of capitals) takes every word for one. A fingerprint is
the sorted set of the spots' 64-bit hashes, written as text. Likeness is the Jaccard index of two sets; with a threshold
it is pruned by the sets' lengths. Near-duplicate search partitions sets by length, so only sets of a partition or its
neighbour are compared, through their rarest spots.

Defined results: words are compared in lower case without the punctuation around them; a text too short for a chain has
the one signature of its whole word sequence, so texts without words (null, empty, white space) equal each other;
repeated texts have equal fingerprints; ties in doc_id are ordered by the texts' hash, a null doc_id comes last; a table
of one row is its own next document; an empty table gives no row; a very long text is one row, all steps linear in its
words. Only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, materialize, pieces_of, small

#: Anchors, frequent function words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in that is for on with was it be by are this from as at or an a "
    "der die und den von zu das mit sich ist im dem nicht ein eine auf für "
    "de la le et les des en un une est que pour qui dans sur au du par pas avec "
    "el y los se del las con una su para es al no"
).split()
CHAIN = 2
LEAST_SPOTS = 4
#: Rows a bucket of the order by doc_id holds on average.
BUCKET_ROWS = 1024
#: Most ranges of doc_id; beyond BUCKET_ROWS times this their windows grow, and spill.
MAX_BUCKETS = 20_000


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """df with the column `out`: sorted distinct signatures of the column `text`. Narrow; every step is linear in the words.

    For the anchor at word i that is the j-th anchor (from 0), i - j content words precede it, so its chain starts
    at content word i - j.
    """
    clean = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), rf"[^\p{{L}}\p{{N}}{SPACE}]+", "")
    t = df.withColumn("_w", F.filter(F.split(clean, f"[{SPACE}]+"), lambda x: x != ""))
    t = t.withColumns({
        "_content": F.filter("_w", lambda x: ~x.isin(ANCHORS)),
        "_spots": F.filter(F.transform("_w", lambda x, i: F.when(x.isin(ANCHORS), i)), lambda i: i.isNotNull()),
    })
    spot = F.transform("_spots", lambda i, j: F.when(i - j + chain <= F.size("_content"), F.xxhash64(F.get("_w", i), *[F.get("_content", i - j + c) for c in range(chain)])))
    t = t.withColumn("_sigs", F.array_distinct(F.filter(spot, lambda h: h.isNotNull())))
    every = F.transform(F.sequence(F.lit(0), F.size("_w") - 1 - chain), lambda i: F.xxhash64(*[F.get("_w", i + c) for c in range(chain + 1)]))
    found = F.when(F.size("_sigs") >= LEAST_SPOTS, F.array_sort("_sigs")).when(F.size("_w") > chain, F.array_sort(F.array_distinct(every))).otherwise(F.array(F.xxhash64(F.array_join("_w", " "))))
    return t.withColumn(out, found).drop("_w", "_content", "_spots", "_sigs")


def fingerprint(sigs: Column) -> Column:
    return F.array_join(sigs.cast("array<string>"), " ")


def jaccard(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard index of two distinct arrays; 0 without looking at the members where the lengths alone rule it out."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.when(low < F.lit(threshold) * high, F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def order_buckets(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> list[int]:
    """Lower bounds of about even ranges of doc_id, from one scan of that column."""
    n = docs.count()
    m = max(1, min(MAX_BUCKETS, math.ceil(n / bucket_rows)))
    if m == 1:
        return []
    row = docs.select(F.percentile_approx("doc_id", [k / m for k in range(1, m)], max(10_000, 10 * m)).alias("b")).first()
    return sorted(set(row["b"] or []))


def bucket_of(c: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the value: a coarse step over every root-th bound, then a fine step."""
    if not bounds:
        return F.lit(0)
    root = max(1, math.isqrt(len(bounds)))
    kind = "array<bigint>"
    every = F.lit(bounds).cast(kind)
    coarse = F.size(F.filter(F.lit(bounds[::root]).cast(kind), lambda b: b <= c))
    at = F.greatest(F.lit(0), coarse - 1) * root
    fine = F.size(F.filter(F.slice(every, at + 1, root), lambda b: b <= c))
    return F.when(c.isNull() | (coarse == 0), F.lit(0)).otherwise(at + fine).cast("int")


def bucketed(plain: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows (doc_id, text, h) with `bucket`, a number that falls along the order by descending doc_id, then h.

    A doc_id that very many rows repeat would be one bucket: it is cut further by even ranges of h.
    """
    heavy = plain.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * bucket_rows)
    heavy = small(materialize(heavy.select(F.col("doc_id").alias("_id"), F.ceil(F.col("n") / bucket_rows).alias("_parts")), "spot-heavy"), 100_000)
    place = F.shiftright("h", 32) + F.lit(1 << 31)
    sub = F.coalesce(F.floor(place * F.col("_parts") / F.lit(float(1 << 32))), F.lit(0)).cast("long")
    range_no = bucket_of(F.col("doc_id"), order_buckets(plain, bucket_rows)).cast("long")
    return plain.join(heavy, plain["doc_id"].eqNullSafe(heavy["_id"]), "left").select("doc_id", "text", "h", (range_no * F.lit(1 << 32) - sub).alias("bucket"))


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs): each document beside the next by descending doc_id, the last beside the first.

    Buckets along the order are windows of bounded size; the first document of each is sent once more to the bucket
    before it, whose last document needs it. One shuffle of the texts, signatures after it; no window over all rows.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    own = bucketed(plain, bucket_rows)
    # the first row of each bucket by the order, without its text: nulls of doc_id come last
    key = F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("id"), "h")
    first = own.groupBy("bucket").agg(F.min(key).alias("k"))
    along = W.orderBy("bucket")
    first = materialize(first.select(F.col("bucket").alias("_from"), "k", F.coalesce(F.lead("bucket").over(along), F.first("bucket").over(along)).alias("target")), "spot-firsts")
    found = small(first, 4 * MAX_BUCKETS)
    guests = own.join(found, (own["bucket"] == found["_from"]) & key.eqNullSafe(found["k"])).groupBy("_from", "target").agg(F.first(F.struct("doc_id", "text", "h")).alias("g"))
    guests = guests.select("g.doc_id", "g.text", "g.h", F.col("target").alias("bucket"), F.lit(1).alias("guest"))
    total = plain.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    every = own.withColumn("guest", F.lit(0)).unionByName(guests).repartition(pieces_of(docs, total), "bucket")
    w = W.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "h", "text")
    out = with_signatures(every, "text", "sigs").withColumns({"next_text": F.lead("text").over(w), "next_sigs": F.lead("sigs").over(w)})
    return out.where(F.col("guest") == 0).select("doc_id", "text", "sigs", "next_text", "next_sigs")


def edited_fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Fingerprints of every document and of its edited text, with the likeness to that and to the next document."""
    t = with_next(docs).withColumn("n_chars", F.char_length("text"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    t = t.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - cut), F.substring("next_text", F.lit(1), cut)))
    t = with_signatures(t, "edited", "edited_sigs", chain)
    return t.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("sigs").cast("long").alias("n_signatures"),
    )


def length_partition(n: Column, threshold: float) -> Column:
    """Sets whose Jaccard index reaches the threshold lie in one partition or in two neighbours: bounds grow by 1/threshold."""
    return F.floor(F.log(n.cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(first, second, likeness): pairs of different fingerprints at or over the threshold, each side named by the least
    doc_id with that fingerprint, and exact copies folded together before.

    Two sets of n and m spots at the threshold share a spot among the n - ceil(threshold * n) + 1 globally rarest of
    either, so only those are listed, by length partition and the one below it.
    """
    marked = with_signatures(docs.select("doc_id", "text"), "text", "sigs").groupBy("sigs").agg(F.min("doc_id").alias("id"))
    sets = materialize(marked.withColumns({"n": F.size("sigs"), "part": length_partition(F.size("sigs"), threshold)}), "spot-sets")
    spots = sets.select("id", "n", "part", F.explode("sigs").alias("h"))
    frequency = spots.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    rare = W.partitionBy("id").orderBy("df", "h")
    prefix = spots.join(frequency, "h").withColumn("_k", F.row_number().over(rare)).where(F.col("_k") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1)
    prefix = materialize(prefix.select("id", "n", "part", "h"), "spot-prefix")
    left = prefix.select(F.col("id").alias("first"), F.col("n").alias("_n"), "part", "h")
    right = prefix.select(F.col("id").alias("second"), F.col("n").alias("_m"), F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"), "h", F.col("part").alias("_p"))
    longer = (F.col("_m") > F.col("_n")) | ((F.col("_m") == F.col("_n")) & (F.col("second") > F.col("first")))
    pairs = left.join(right, ["part", "h"]).where(longer & (F.col("_n") >= F.lit(threshold) * F.col("_m"))).select("first", "second").distinct()
    a, b = sets.select(F.col("id").alias("first"), F.col("sigs").alias("_a")), sets.select(F.col("id").alias("second"), F.col("sigs").alias("_b"))
    scored = pairs.join(a, "first").join(b, "second").withColumn("likeness", jaccard(F.col("_a"), F.col("_b"), threshold))
    return scored.where(F.col("likeness") >= threshold).select("first", "second", "likeness")
