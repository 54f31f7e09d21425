"""The first rows of each group in a hash's order, without ordering a group.

A histogram of the first digits of the hash says in which cell each group's cut falls: rows of cells before it are in, of
cells after it out, by comparison alone, and only the rows of the one cell that holds the cut are ranked. A cell holds
1 / CELLS of a group, and rows that share a hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_within, materialize

#: Hexadecimal digits of a cell, and groups whose cuts may be broadcast.
DIGITS, MAX_BROADCAST = 4, 300_000
CELLS = 16**DIGITS


def marked_first(df: DataFrame, groups: list[str], order: Column, ties: list[str], take: Callable[[Column], Column] | str, into: str = "_taken") -> DataFrame:
    """df with the boolean `into`: whether a row is among the first take(n) of its group of n rows, by `order` (hexadecimal
    text, as md5 gives) and then the columns of `ties`; `take` may also name the column of `groups` that says how many.
    Null groups are groups. df is read three times and not shuffled, but for the rows of the cells that hold a cut."""
    if not groups:
        raise ValueError("name a column of groups")
    t = df.withColumn("_hash", order).withColumn("_cell", F.substring("_hash", 1, DIGITS))
    names = {c: f"_g{k}" for k, c in enumerate(groups)}
    counts = t.groupBy(*[F.col(c).alias(g) for c, g in names.items()], "_cell").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*names.values())  # at most CELLS rows of a group
    upto = F.sum("_n").over(w.orderBy("_cell"))
    cells = counts.withColumns({"_upto": upto, "_all": F.sum("_n").over(w)}).withColumn("_take", F.greatest(F.lit(0), F.col(names[take]) if isinstance(take, str) else take(F.col("_all"))).cast("long"))
    before = F.col("_upto") - F.col("_n")
    # the cell that holds the cut; where all or none are taken there is none
    cut = (before < F.col("_take")) & (F.col("_take") < F.col("_upto"))
    cuts = cells.groupBy(*names.values()).agg(F.max(F.when(cut, F.col("_cell"))).alias("_cut"), F.max(F.when(cut, F.col("_take") - before)).alias("_left"), F.coalesce(F.max(F.when(F.col("_upto") <= F.col("_take"), F.col("_cell"))), F.lit("")).alias("_whole"))
    cuts = broadcast_within(materialize(cuts, "cuts"), MAX_BROADCAST)
    same = None
    for c, g in names.items():
        one = F.col(c).eqNullSafe(F.col(g))
        same = one if same is None else same & one
    joined = t.join(cuts, same)
    on_cut = F.coalesce(F.col("_cell") == F.col("_cut"), F.lit(False))
    sure = joined.where(~on_cut).withColumn(into, F.col("_cell") <= F.col("_whole"))
    place = F.row_number().over(W.partitionBy(*names.values()).orderBy("_hash", *ties))
    edge = joined.where(on_cut).withColumn(into, place <= F.col("_left"))
    columns = [*df.columns, into]
    return sure.select(*columns).unionByName(edge.select(*columns))


def first_rows(df: DataFrame, groups: list[str], order: Column, ties: list[str], take: Callable[[Column], Column] | str) -> DataFrame:
    """The rows that marked_first() marks."""
    return marked_first(df, groups, order, ties, take, "_taken").where("_taken").drop("_taken")
