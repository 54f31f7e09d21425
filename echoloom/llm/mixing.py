"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source gets a whole number of blocks by highest quotients target/(2k+1); the source's blocks go to its lots of
shards, and a lot's to its shards, by highest quotients of their words; within a shard, blocks of the twice repeated
stream of its documents are chosen by a seeded hash. Shards hold about SHARD_WORDS words and lots LOT_SHARDS shards, so a
source with a third of all rows is many of both: no step brings its documents or all its shards to one task.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own, the last in order;
rows that repeat a doc_id under different texts are placed apart, by both; rows alike in both each count with their size,
and in the mixed rows share one decision; ties of quotients go to the smaller key; an empty table gives an empty result;
a very long text lies in many blocks of one shard. Only doc_id, text and source are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, materialize, packed, small, unpacked, words

#: Weights by place of the source in code point order, repeating, and the mix's size as a share of all words.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEATS = 2
BLOCK_WORDS = 64
SHARD_WORDS = 65536
LOT_SHARDS = 1024
SEED = 20240607


def highest_quotients(parties: DataFrame, by: list[str], key: list[str], votes: str, seats: str) -> DataFrame:
    """Exact Sainte-Lague seats of each party (column quota) within each group `by`; ties go to the smaller key.

    The divisors V/(N + S/2) and V/(N - S/2), with V votes, N seats and S parties, bound each party's seats from above
    and below; the bounds of a group differ by at most about 2S seats in all. Only the quotients between them are
    listed and ranked, never all N of them.
    """
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    v, n, s = F.sum(votes).over(w), F.col(seats), F.count(F.lit(1)).over(w)
    bounds = parties.select("*", v.alias("_v"), s.alias("_s")).withColumns({
        "_low": F.when((n > F.col("_s") / 2) & (F.col("_v") > 0), F.floor(F.col(votes) * (n - F.col("_s") / 2) / F.col("_v") + 0.5)).otherwise(0).cast("long"),
        "_high": F.when(F.col("_v") > 0, F.floor(F.col(votes) * (n + F.col("_s") / 2) / F.col("_v") + 0.5) + 1).otherwise(0).cast("long"),
    }).withColumn("_left", n - F.sum("_low").over(w))
    quotients = bounds.where(F.col("_high") > F.col("_low")).select(
        "*", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_k")
    ).withColumn("_q", F.col(votes) / (2 * F.col("_k") + 1))
    ranked = quotients.withColumn("_rank", F.row_number().over(w.orderBy(F.desc("_q"), *key)))
    won = ranked.groupBy(*by, *key).agg(F.sum((F.col("_rank") <= F.col("_left")).cast("long")).alias("_won"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by + key]
    joined = bounds.alias("a").join(won.alias("b"), same, "left")
    return joined.select(*[F.col(f"a.{c}") for c in parties.columns], (F.col("a._low") + F.coalesce("b._won", F.lit(0))).cast("long").alias("quota"))


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> target: words by weight, stopped at MAX_REPEATS sizes, the excess reshared by weight.

    In order of size/weight the sources stop first come first; the level of the others is what is left over the
    weights that are left. One row per source goes through one ordered window.
    """
    place = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(0))
    t = sources.withColumn("_place", F.row_number().over(place) - 1).withColumn("_w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_place") % len(WEIGHTS)).cast("int") + 1))
    t = t.withColumns({"_cap": (MAX_REPEATS * F.col("source_size")).cast("double"), "_all": F.sum("source_size").over(everything) * F.lit(SHARE)})
    before = everything.orderBy(F.col("_cap") / F.col("_w"), "_place").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumns({"_capped": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_gone": F.coalesce(F.sum("_w").over(before), F.lit(0.0)), "_ws": F.sum("_w").over(everything)})
    t = t.withColumn("_level", (F.col("_all") - F.col("_capped")) / (F.col("_ws") - F.col("_gone")))
    # the running level grows up to the first source that stays under its cap and falls after it
    t = t.withColumn("_cut", F.max("_level").over(everything))
    return t.withColumn("target", F.least(F.col("_cap"), F.col("_cut") * F.col("_w"))).select("source", "source_size", "target")


def _number(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long")


def _seeded(seed: int, *keys: str) -> Column:
    """md5 of the keys and the seed: the same on every run, partitioning and engine."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def mix(sized: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, lot_shards: int = LOT_SHARDS, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, text_md5, source, size) -> the same with source_size, target, taken and the columns of the selection.

    `before` is the words before the document in its shard's stream and `picks`, for each pass, whether each block that
    the document touches is chosen, so its part of either pass is known without its words and without the shard's list.
    """
    totals = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-sources")
    seats = totals.agg(F.round(F.sum("target") / block_words).cast("long").alias("n")).first()["n"] or 0
    quotas = highest_quotients(totals.withColumn("_n", F.lit(seats)), [], ["source"], "target", "_n").withColumn("n_shards", F.greatest(F.lit(1), F.round(F.col("source_size") / shard_words)).cast("int")).drop("_n")
    quotas = small(materialize(quotas, "mix-quotas"), 10_000)
    docs = sized.alias("d").join(quotas.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source"))).select(
        "d.doc_id", "d.text_md5", "d.source", "d.size", "q.source_size", "q.target", "q.quota", "q.n_shards", (F.conv(F.substring(_seeded(seed, "d.doc_id", "d.text_md5"), 1, 8), 16, 10).cast("long") % F.col("q.n_shards")).alias("shard")
    )
    by_shard = docs.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("_seats"), (F.col("shard") % F.ceil(F.first("n_shards") / lot_shards)).cast("long").alias("lot"))
    by_shard = materialize(by_shard, "mix-shards")
    lots = highest_quotients(by_shard.groupBy("source", "lot").agg(F.sum("shard_size").alias("lot_size"), F.first("_seats").alias("_seats")), ["source"], ["lot"], "lot_size", "_seats")
    of_lot = by_shard.drop("_seats").alias("s").join(lots.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source")) & (F.col("s.lot") == F.col("l.lot"))).select("s.*", F.col("l.quota").alias("_seats"))
    shards = highest_quotients(of_lot, ["source", "lot"], ["shard"], "shard_size", "_seats").select(
        "source", "shard", "shard_size", F.col("quota").alias("shard_quota"), (F.col("shard_size") * MAX_REPEATS / block_words).cast("long").alias("n_blocks")
    )
    # seeded choice: the shard_quota blocks of least hash; a shard whose quota reaches its blocks is taken whole
    blocks = shards.where((F.col("n_blocks") > 0) & (F.col("shard_quota") < F.col("n_blocks"))).select("source", "shard", "shard_quota", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    w = W.partitionBy("source", "shard")
    chosen = blocks.withColumn("_rank", F.row_number().over(w.orderBy(_seeded(seed, "source", "shard", "block"), "block"))).withColumn("_in", (F.col("_rank") <= F.col("shard_quota")).cast("int"))
    prefix = chosen.groupBy("source", "shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "_in"))), lambda x: x["_in"]).alias("picked"))
    chosen = shards.alias("s").join(prefix.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.shard") == F.col("p.shard")), "left").select("s.*", "p.picked")
    order = w.orderBy(_seeded(seed + 1, "doc_id", "text_md5"), "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = docs.withColumn("before", _number(F.sum("size").over(order)))
    out = placed.alias("d").join(chosen.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.shard") == F.col("s.shard"))).select("d.*", "s.shard_size", "s.shard_quota", "s.n_blocks", "s.picked")
    picks = F.array(*[_touched(F.col("before") + k * F.col("shard_size"), F.col("size"), block_words) for k in range(MAX_REPEATS)])
    whole = F.when(F.col("shard_quota") >= F.col("n_blocks"), F.col("shard_quota") > 0)
    out = out.withColumns({"picks": picks, "whole": whole}).drop("picked", "shard_quota", "n_blocks")
    return out.withColumn("taken", sum((taken_words(F.get("picks", F.lit(k)), F.col("before") + k * F.col("shard_size"), F.col("size"), block_words) for k in range(MAX_REPEATS)), F.lit(0).cast("long")))


def _touched(start: Column, size: Column, block_words: int) -> Column:
    """The choices of the shard's blocks that [start, start + size) touches."""
    first, last = F.floor(start / F.lit(block_words)).cast("int"), F.floor((start + size - 1) / F.lit(block_words)).cast("int")
    return F.slice("picked", first + 1, F.greatest(F.lit(0), last - first + 1))


def taken_words(picks: Column, start: Column, size: Column, block_words: int) -> Column:
    """Words of [start, start + size) of the shard's repeated stream that lie in chosen blocks."""
    end, b = start + size, F.lit(block_words).cast("long")
    first, last = F.floor(start / b).cast("int"), F.floor((end - 1) / b).cast("int")
    inside = F.aggregate(picks, F.lit(0).cast("long"), lambda a, x: a + x) * b
    # less what the first and the last block have outside the document
    cut = F.coalesce(F.get(picks, F.lit(0)), F.lit(0)) * (start - first * b) + F.coalesce(F.get(picks, last - first), F.lit(0)) * ((last + 1) * b - end)
    whole = F.when(F.col("whole"), size).when(~F.col("whole"), F.lit(0).cast("long"))
    return F.when(size <= 0, F.lit(0).cast("long")).otherwise(F.coalesce(whole, inside - cut))


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("text_md5"), "source", F.size(words(F.col("text"))).cast("long").alias("size"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """The mix as rows of documents: a row for each pass that takes words of a document, its text cut to those words.

    The joined decisions are narrow; documents are matched by doc_id, source and digest of the text.
    """
    sized = materialize(sized_documents(docs), "mix-sizes")
    plan = mix(sized, block_words, shard_words, seed=seed)
    columns = ("before", "shard_size", F.coalesce("whole", F.lit(False)).alias("whole"), F.when(F.col("whole").isNull(), F.col("picks")).alias("picks"))
    plan = plan.where(F.col("taken") > 0).groupBy("doc_id", "text_md5", "source").agg(F.min(F.struct(*columns)).alias("_plan"))
    keyed = packed(docs, "doc_id", "text", "source").withColumn("_text_md5", F.md5(F.coalesce(F.col("text"), F.lit(""))))
    same = keyed["doc_id"].eqNullSafe(plan["doc_id"]) & (keyed["_text_md5"] == plan["text_md5"]) & keyed["source"].eqNullSafe(plan["source"])
    joined = keyed.join(plan, same).select(keyed["text"], "_row", "_plan")
    piece = F.split("text", f"(?<=[{SPACE}])(?=[^{SPACE}])")  # words with the white space after them
    work = joined.select("text", "_row", F.filter(piece, lambda x: x.rlike(f"[^{SPACE}]")).alias("_words"), "_plan", F.explode(F.array(*[F.lit(k) for k in range(MAX_REPEATS)])).alias("_pass"))
    work = work.select("text", "_row", "_words", F.col("_plan.whole").alias("_whole"), F.get("_plan.picks", F.col("_pass")).alias("_picks"), (F.col("_plan.before") + F.col("_pass") * F.col("_plan.shard_size")).alias("_start"))
    first = F.floor(F.col("_start") / block_words).cast("int")
    kept = F.filter("_words", lambda x, i: F.col("_whole") | (F.coalesce(F.get(F.col("_picks"), F.floor((F.col("_start") + i) / block_words).cast("int") - first), F.lit(0)) == 1))
    # the row number keeps the filter above the words, which would be listed twice below
    out = work.withColumn("_kept", kept).withColumn("_some", F.when(F.monotonically_increasing_id() >= 0, F.size("_kept") > 0)).where("_some")
    cut = F.size("_kept") < F.size("_words")
    return unpacked(out, docs.columns, F.concat_ws("", "_kept"), cut)
