"""Running sums in order of a value, for groups of any size: a prefix scan over range partitions.

Rows are sorted by group and value over range partitions, whose number follows the rows. One narrow pass gives each row
the sums of its group before it within its partition; a second adds what the partitions before hold of the group, which
only groups that cross a border need: at most two rows a partition. No window or task holds a group, however large.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_within, discard, materialize

#: Rows of one partition of the scan, and groups whose table of totals may be broadcast.
PIECE_ROWS, MAX_BROADCAST = 2_000_000, 300_000


def _leaves(column: pa.Array) -> list[pa.Array]:
    return [x for c in column.flatten() for x in _leaves(c)] if pa.types.is_struct(column.type) else [column]


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Which rows begin a group of equal neighbours; nulls are equal to nulls."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in (x for column in columns for x in _leaves(column)):
        gone = np.asarray(c.is_null())
        apart = np.asarray(pc.fill_null(pc.not_equal(c[1:], c[:-1]), False))
        new[1:] |= apart | (gone[1:] != gone[:-1])
    return new


def _scanned(batches: Iterator[pa.RecordBatch], by: list[str], value: str, sums: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the sums before them and the value after them, inside this partition."""
    from pyspark import TaskContext

    piece = TaskContext.get().partitionId()
    carried: dict[str, float] = dict.fromkeys(sums, 0)
    held: pa.RecordBatch | None = None  # the last row, whose next value isn't known yet, with the sums before it carried

    def done(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        columns = {c: t.column(c).combine_chunks() for c in t.column_names}
        new = _starts([columns[c] for c in by])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        keep = len(new) if last else len(new) - 1
        before = {}
        for c in sums:
            x = columns[c].to_numpy(zero_copy_only=False)
            run = np.cumsum(x) - x
            run = run - run[first][group]
            run[group == 0] += carried[c]
            before[f"before_{c}"] = pa.array(run[:keep])
            carried[c] = run[-1].item()
        same_next = pa.array(np.r_[~new[1:], False][:keep])
        shifted = pa.concat_arrays([columns[value][1:], pa.nulls(1, columns[value].type)])[:keep]
        if keep:
            out = [*(columns[c][:keep] for c in t.column_names), *before.values(), pc.if_else(same_next, shifted, pa.scalar(None, columns[value].type)), pa.array(np.full(keep, piece), pa.int32())]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(out, schema, strict=True)], schema=schema)
        held = None if last else t.slice(keep).combine_chunks().to_batches()[0]

    for batch in batches:
        if batch.num_rows:
            yield from done(pa.Table.from_batches([held, batch] if held is not None else [batch]), False)
    if held is not None:
        yield from done(pa.Table.from_batches([held]), True)


def running(v: DataFrame, by: list[str], value: str, sums: list[str], totals: dict[str, Column] | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """v, one row per distinct value of each group, with before_<c> and all_<c> for each of `sums`, next_value (NULL at the
    end), low, high and distinct of the group, and further group aggregates `totals`. Groups with a null key are left out.

    v is written to the shared folder once, so what made it runs once and its rows are known; so is the scanned table,
    whose partitions' borders must not change when an executor is lost.
    """
    keys = by or ["_one"]
    base = materialize(v if by else v.withColumn("_one", F.lit(0)), "ordered-values")
    pieces = max(int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-base.count() // piece_rows))
    kinds = {f.name: f.dataType for f in base.schema}
    fields = [*base.schema.fields, *[T.StructField(f"before_{c}", T.DoubleType() if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else T.LongType()) for c in sums], T.StructField("next_value", kinds[value]), T.StructField("_piece", T.IntegerType())]
    spark_schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark_schema)
    ordered = base.repartitionByRange(pieces, *keys, value).sortWithinPartitions(*keys, value)
    t = materialize(ordered.mapInArrow(lambda batches: _scanned(batches, keys, value, sums, schema), spark_schema), "ordered-scanned")
    discard(base)
    group = t.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("distinct"), *[F.sum(c).alias(f"all_{c}") for c in sums], *[e.alias(n) for n, e in (totals or {}).items()])
    group = broadcast_within(materialize(group, "ordered-groups"), MAX_BROADCAST)
    edges = t.groupBy(*keys, "_piece").agg(F.min(value).alias("_first"), *[F.sum(c).alias(f"_in_{c}") for c in sums])
    order = W.partitionBy(*keys).orderBy("_piece")  # at most as many rows as there are partitions
    edges = edges.select(
        *keys, "_piece", F.lead("_first").over(order).alias("_next"), F.lag("_piece").over(order).alias("_before"),
        *[F.coalesce(F.sum(f"_in_{c}").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_off_{c}") for c in sums],
    ).where(F.col("_next").isNotNull() | F.col("_before").isNotNull()).drop("_before")
    # groups that cross a border: at most two a partition, whatever the data
    out = t.join(F.broadcast(edges), [*keys, "_piece"], "left").join(group, keys)
    out = out.withColumns({**{f"before_{c}": F.col(f"before_{c}") + F.coalesce(f"_off_{c}", F.lit(0)) for c in sums}, "next_value": F.coalesce("next_value", "_next")})
    return out.drop("_piece", "_next", *[f"_off_{c}" for c in sums], *([] if by else ["_one"]))


def _paired(batches: Iterator[pa.RecordBatch], by: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of sorted rows a row for each group of this partition: its p and q, the pairs with q below p (equal values: half), and its values."""
    from pyspark import TaskContext

    piece, held = TaskContext.get().partitionId(), None

    def row(name: tuple, p: int, q: int, pairs: float, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*name, piece, p, q, pairs, n], schema, strict=True)], schema=schema)

    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(c) for c in by]
        first = np.flatnonzero(_starts(keys))
        p, q = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("p", "q"))
        n = np.diff([*first, len(p)])
        before = np.cumsum(q) - q
        pairs = p * (before - np.repeat(before[first], n) + q / 2)
        sums = zip(first, np.add.reduceat(p, first), np.add.reduceat(q, first), np.add.reduceat(pairs, first), n, strict=True)
        for i, *s in sums:
            name = tuple(k[i].as_py() for k in keys)
            if held and held[0] == name:
                s = [held[1] + s[0], held[2] + s[1], held[3] + s[2] + float(s[0]) * held[2], held[4] + s[3]]
            elif held:
                yield row(*held)
            held = (name, *s)
    if held:
        yield row(*held)


def paired(v: DataFrame, by: list[str], value: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Of v, one row per distinct value of each group with counts p and q: per group all_p, all_q, pairs (of a p and a q below it, an equal
    one counting half) and distinct. As running(), but a partition leaves one row a group instead of its rows."""
    keys = by or ["_one"]
    base = materialize(v if by else v.withColumn("_one", F.lit(0)), "paired-values")
    pieces = max(int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-base.count() // piece_rows))
    names = {"_piece": T.IntegerType(), "p": T.LongType(), "q": T.LongType(), "pairs": T.DoubleType(), "distinct": T.LongType()}
    spark_schema = T.StructType([*[base.schema[c] for c in keys], *[T.StructField(c, k) for c, k in names.items()]])

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark_schema)
    there = base.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys]))
    ordered = there.repartitionByRange(pieces, *keys, value).sortWithinPartitions(*keys, value).select(*keys, "p", "q")
    parts = materialize(ordered.mapInArrow(lambda batches: _paired(batches, keys, schema), spark_schema), "paired-parts")
    discard(base)
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)  # at most a row a partition
    parts = parts.withColumn("_below", F.coalesce(F.sum("q").over(before), F.lit(0)))
    return parts.groupBy(*keys).agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"), F.sum(F.col("pairs") + F.col("p") * F.col("_below").cast("double")).alias("pairs"), F.sum("distinct").alias("distinct")).drop(*([] if by else ["_one"]))


def ordinal(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with `_ordinal`, each row's place (from 0) in its group by the columns of `order`; ties in any order.

    Rows are sorted over range partitions and written; places within a partition are the rows' numbers there, and what lies
    before it is a row per group and partition.
    """
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartitionByRange(pieces, *by, *order).sortWithinPartitions(*by, *order)
    t = materialize(sorted_rows.withColumn("_id", F.monotonically_increasing_id()), "ordered-rows")
    names = {c: f"_g{k}" for k, c in enumerate(by)}
    piece = F.shiftright("_id", 33)
    edges = t.groupBy(*[F.col(c).alias(g) for c, g in names.items()], piece.alias("_p")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*names.values()).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # at most a row a partition
    edges = edges.select(*names.values(), "_p", (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_shift"))
    edges = broadcast_within(materialize(edges, "ordered-edges"), MAX_BROADCAST)
    same = piece == F.col("_p")
    for c, g in names.items():
        same = same & F.col(c).eqNullSafe(F.col(g))
    return t.join(edges, same).select(*df.columns, (F.col("_id") + F.col("_shift")).alias("_ordinal"))


def order_statistic(value: str, weight: str, k: Column) -> Column:
    """Aggregate over running() rows: the k-th (from 0) of the values repeated by their weight."""
    return F.max(F.when((F.col(f"before_{weight}") <= k) & (k < F.col(f"before_{weight}") + F.col(weight)), F.col(value)))


def group_quantiles(df: DataFrame, by: list[str], shares: tuple[float, ...], value: str = "value") -> DataFrame:
    """by, quantiles (array, interpolated), n, low, high of the values that are there: exact, and no task holds a group's values."""
    x = F.col(value).cast("double")
    v = df.where(x.isNotNull()).groupBy(*by, x.alias("_value")).agg(F.count(F.lit(1)).alias("n"))
    places = [(F.col("all_n") - 1) * F.lit(s) for s in shares]
    near = {f"_{k}{e}": order_statistic("_value", "n", f(h)) for k, h in enumerate(places) for e, f in (("a", F.floor), ("b", F.ceil))}
    q = running(v, by, "_value", ["n"]).groupBy(*by).agg(*[F.first(c).alias(c) for c in ("all_n", "low", "high")], *[e.alias(n) for n, e in near.items()])
    return q.select(*by, F.array(*[F.col(f"_{k}a") + (h - F.floor(h)) * (F.col(f"_{k}b") - F.col(f"_{k}a")) for k, h in enumerate(places)]).alias("quantiles"), F.col("all_n").alias("n"), "low", "high")


def median_from(low: str, high: str) -> Column:
    return (F.col(low) + F.col(high)) / 2
