"""Fill-in-middle: a text cut at two unit borders and its parts put in another order, by a two-pass streaming matcher.

Units are runs of ASCII letters, and every other code point alone. The first pass only counts them; the second advances a
lazy match iterator to the two ranks and notes the two places. Neither pass keeps a unit, so a text costs its own length
and nothing more, however many units it has. Ranks, form and order follow from the row's id alone, so reruns and lost
executors give the same rows.

Defined results: a null text is empty, and an empty text is plain (no cut). A text that holds one of the marks is plain.
A null id hashes like an empty one. Rows that repeat are each transformed, alike. Other columns stay as they are, whatever
their names. Very long texts are one row of one task; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = r"[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SEED = 1
#: Of 100 texts, so many are transformed, and of 100 of those so many put the suffix first.
RATE, SPM_RATE = 90, 20
_UNIT = re.compile(UNIT)
#: Bytes of text of one Arrow batch given back to Spark.
BATCH_BYTES = 16_000_000
RESULT = "_fim struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"


def draws(key: str, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit draws of an id."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def count_units(text: str) -> int:
    """First pass: how many units there are."""
    return sum(1 for _ in _UNIT.finditer(text))


def borders(text: str, first: int, second: int) -> tuple[int, int]:
    """Second pass: where the first `first` and the first `second` units (first <= second) end, in code points.

    Units follow each other without a gap, so a border is the start of the unit after it, or the end of the text.
    """
    units = _UNIT.finditer(text)
    a = next((m.start() for m in islice(units, first, None)), len(text))
    if first == second:
        return a, a
    # the iterator has already given the unit with number `first`
    return a, next((m.start() for m in islice(units, second - first - 1, None)), len(text))


def transform_text(text: str, key: str, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix_chars, middle_chars, output) of one text."""
    n = count_units(text)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    a, b = borders(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """One row per document: `_row` (all columns as a struct) and `_fim` (n, form, prefix_chars, middle_chars, output)."""
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    rows = docs.select(F.coalesce(docs[key].cast("string"), F.lit("")).alias("_key"), F.coalesce(docs[text], F.lit("")).alias("_text"), whole)
    schema = T.StructType([rows.schema["_row"], *T._parse_datatype_string(RESULT).fields])
    fim_type = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("n", "form", "prefix_chars", "middle_chars", "output")
        for batch in batches:
            kept, made, size = [], [], 0

            def out():
                return pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(kept, pa.int64())), pa.array(made, fim_type)], ["_row", "_fim"])

            for k, (i, t) in enumerate(zip(batch.column("_key"), batch.column("_text"), strict=True)):
                kept.append(k)
                made.append(dict(zip(names, transform_text(t.as_py(), i.as_py(), rate, spm_rate, seed), strict=True)))
                size += len(made[-1]["output"])
                if size > BATCH_BYTES:
                    yield out()
                    kept, made, size = [], [], 0
            if kept:
                yield out()

    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The exact text again from output and form. A mark can't arise where parts meet, so its first place is its own."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        at, end = F.instr(output, second), F.instr(output, MIDDLE)
        skip = len(first) + 1
        return F.substr(output, F.lit(skip), at - skip), F.substr(output, at + len(second), end - at - len(second)), F.substr(output, end + len(MIDDLE))

    p, s, m = parts(PREFIX, SUFFIX)
    s2, p2, m2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)
