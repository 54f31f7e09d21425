"""Pieces shared by the text operators: word splitting, shared-folder tables, size checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.session import discard, materialize, new_path, shared_dir

__all__ = ["SPACE", "discard", "let", "materialize", "new_path", "packed", "pieces_of", "running", "shared_dir", "small", "unpacked", "within", "words"]

#: ASCII white space that separates words, as a regular expression class body (fixed value of the contracts).
SPACE = r"\x20\x09-\x0D"
#: Bytes of text that one task of a shuffle gets.
TASK_BYTES = 48_000_000


def pieces_of(df: DataFrame, total_bytes: int) -> int:
    """Tasks of a shuffle over that much text: as many as the session's, and more as the text grows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // TASK_BYTES))


def within(df: DataFrame, max_rows: int) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast a materialized table only if its counted rows stay within the bound; else leave the join to Spark."""
    return F.broadcast(df) if within(df, max_rows) else df


def words(text: Column) -> Column:
    """Maximal runs of characters outside SPACE; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and the whole row as one struct `_row`, so that no column of the table can clash with a step's own."""
    return docs.select(*[docs[c] for c in columns if c in docs.columns], F.struct(*[docs[c] for c in docs.columns]).alias("_row"))


def unpacked(df: DataFrame, columns: list[str], text: Column | None = None, changed: Column | None = None) -> DataFrame:
    """The rows of packed() again; with another text, and n_chars to match, where `changed` holds."""
    kinds = {f.name: f.dataType for f in df.schema["_row"].dataType.fields}

    def column(c: str) -> Column:
        old = F.col("_row").getField(c)
        if text is None or c not in ("text", "n_chars"):
            return old.alias(c)
        new = text if c == "text" else F.char_length(text).cast(kinds[c])
        return (new if changed is None else F.when(changed, new).otherwise(old)).alias(c)

    return df.select(*[column(c) for c in columns])


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row; written into a lambda, it would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, step=lambda a, x: a + x) -> Column:
    """For each member of an array of longs, `step` (sum, or greatest) over 0 and the members before it, in time n to the
    1.5: parts of root n members first."""
    zero = F.lit(0).cast("long")

    def befores(part: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, start, lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def in_parts(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v)))).cast("int")
        return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(1), F.size(v), width), lambda i: F.slice(v, i, width))).otherwise(F.array().cast("array<array<bigint>>"))

    def joined(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, x: step(a, x)))
        return F.flatten(F.zip_with(parts, befores(sums, zero), befores))

    return let(values, lambda v: let(in_parts(v), joined))
