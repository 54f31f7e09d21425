"""Repair of conversations whose turns do not follow the grammar `(s?(ua)+)?` of role initials.

Rows are partitioned by the hash of their conversation. In each lot of whole conversations one recursive query of an
embedded DuckDB advances all of them by one turn per recursion and keeps, for each state of the grammar, the least cost
and of its edit strings the least one. Moves are a table of the grammar: insert a turn the grammar wants (I), then keep
(K), re-role (R) or delete (D) the next. DuckDB sees initials and faults only, never texts.

A conversation of more than SEGMENT turns (a hot key) is numbered over range partitions and cut into segments of as many
rows, each a partition key of its own. A segment is walked from every state at once, and the least costs from state to
state are joined along the segments, which gives the same minimum: no task holds more than a lot of segments.

Edits cost: Keep 0 (and 1 for a truncated turn), Rerole 2 (likewise), Delete 3, Insert 2. Blank turns and turns said
before (same role and text) must be deleted. Of several faults of a row the first counts: blank, duplicate, truncated.

Defined results: a null text or role is one space, so blank, or no role of the grammar. Rows go by turn, nulls first;
rows of one turn by role, text and `copy` (ties beyond that are the same row). Null conv_ids are one conversation. An
empty role has no initial and can't be kept. Repeated rows are duplicates. Very long texts pass through Arrow with their
row. Other columns, whatever their names, are left out. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, materialize, pieces_of, small

#: Rows of one segment (a power of two) and of one lot in a task.
SEGMENT, LOT_ROWS = 256, 20_000
#: Counted long conversations that may be broadcast.
MAX_BROADCAST = 100_000
#: The grammar: state -> {initial: state}. State 0 is the empty conversation; 0 and 3 end one.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"s": "system", "u": "user", "a": "assistant"}
FAULTS = ("fine", "blank", "duplicate", "truncated")
#: Longest useful run of inserts: between any two states two suffice.
MAX_INSERTS = 2

#: Adjacent initials that the grammar allows.
LEGAL = ("su", "ua", "au")
#: Bytes of text of one Arrow batch given back to Spark.
BATCH_BYTES = 8_000_000

FAULT_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_COUNTS = (*FAULT_COUNTS, "numbers", "least", "most", "first", "last")


def _schemas(**columns: str) -> tuple[str, pa.Schema]:
    """The same columns for Spark and for Arrow."""
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    path = pa.struct([("entry", pa.int32()), ("target", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    kinds = {
        "string": ("string", pa.string()), "long": ("bigint", pa.int64()), "int": ("int", pa.int32()),
        "turns": ("array<struct<role: string, text: string>>", pa.list_(turn)),
        "edits": ("array<struct<role: string, text: string, edit: string>>", pa.list_(pa.struct([*turn, ("edit", pa.string())]))),
        "paths": ("array<struct<entry: int, target: int, cost: bigint, audit: string>>", pa.list_(path)),
    }
    return ", ".join(f"{c} {kinds[k][0]}" for c, k in columns.items()), pa.schema([(c, kinds[k][1]) for c, k in columns.items()])


_LONGS = dict.fromkeys(FAULT_COUNTS, "long")
_PARTS_DDL, _PARTS = _schemas(_key="string", segment="long", turns="turns", paths="paths", **_LONGS, numbers="long", least="long", most="long", first="string", last="string")
_CHOSEN_DDL, _CHOSEN = _schemas(_key="string", segment="long", entry="int", audit="string", cost="long", gaps="long", **_LONGS)
_RESULT_DDL, _RESULT = _schemas(_key="string", segment="long", turns="edits", audit="string", cost="long", gaps="long", **_LONGS)
_DIGEST_DDL, _DIGEST = _schemas(_key="string", audit="string", cost="long", gaps="long", **_LONGS, repaired_sha256="string")


def _inserts(state: int) -> list[tuple[int, str]]:
    """(state, initials) after no, one and two inserts from a state; a system turn is never inserted."""
    out = [(state, "")]
    for _ in range(MAX_INSERTS):
        at, said = out[-1]
        initial = next(i for i in "ua" if i in GRAMMAR[at])
        out.append((GRAMMAR[at][initial], said + initial))
    return out


def moves() -> pd.DataFrame:
    """All moves over one turn: from source, with this initial and fault, to target, at a cost, by these letters."""
    rows = []
    for source in GRAMMAR:
        for at, said in _inserts(source):
            before, cost = "I" * len(said), INSERT * len(said)
            for initial in ("s", "u", "a", "-"):
                for fault in FAULTS:
                    rows.append((source, initial, fault, at, cost + DELETE, before + "D"))
                    if fault in ("blank", "duplicate"):
                        continue
                    more = cost + (TRUNCATED if fault == "truncated" else 0)
                    if initial in GRAMMAR[at]:
                        rows.append((source, initial, fault, GRAMMAR[at][initial], more + KEEP, before + "K"))
                    rows += [(source, initial, fault, GRAMMAR[at][r], more + REROLE, before + "R") for r in "ua" if r in GRAMMAR[at]]
    return pd.DataFrame(rows, columns=["source", "initial", "fault", "target", "cost", "letters"])


def best_end(paths: list[dict]) -> tuple[int, str]:
    """(cost, audit) of the cheapest path to an end, with the inserts that lead there; ties by the audit's letters."""
    return min((p["cost"] + INSERT * len(said), p["audit"] + "I" * len(said)) for p in paths for at, said in _inserts(p["target"]) if at in ENDS)


def edited(turns: list[dict], audit: str, state: int = 0) -> list[dict]:
    """The repaired turns that an audit describes, from a state on: role, text, edit. Deleted turns are left out."""
    out, rest = [], iter(turns)
    for letter in audit:
        turn = {"role": None, "text": ""} if letter == "I" else next(rest)
        if letter == "D":
            continue
        initial = turn["role"][:1] if letter == "K" else next(i for i in "ua" if i in GRAMMAR[state])
        state = GRAMMAR[state][initial]
        out.append({"role": turn["role"] if letter == "K" else ROLES[initial], "text": turn["text"], "edit": letter})
    return out


_WALK = f"""
WITH RECURSIVE size AS (SELECT part, count(*) AS n FROM lot GROUP BY part),
walk AS (
 SELECT part, state AS entry, 0::BIGINT AS i, state, 0::BIGINT AS cost, '' AS audit FROM whole JOIN range({len(GRAMMAR)}) s(state) ON state = 0 OR NOT whole
 UNION ALL
 SELECT part, entry, i + 1, target, best.cost, best.audit FROM (
  SELECT w.part, w.entry, w.i, m.target, min({{'cost': w.cost + m.cost, 'audit': w.audit || m.letters}}) AS best
  FROM walk w JOIN lot t ON t.part = w.part AND t.i = w.i JOIN moves m ON m.source = w.state AND m.initial = t.initial AND m.fault = t.fault
  GROUP BY w.part, w.entry, w.i, m.target))
SELECT w.part, list({{'entry': entry::INTEGER, 'target': state::INTEGER, 'cost': cost, 'audit': audit}} ORDER BY entry, state) AS paths
FROM walk w JOIN size s ON w.part = s.part AND w.i = s.n GROUP BY w.part ORDER BY w.part"""

_COUNT = """
SELECT part, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
 count(*) FILTER (i > 0 AND coalesce(before, '') || first NOT IN ('su', 'ua', 'au')) AS illegal, count(DISTINCT turn) AS numbers, min(turn) AS least, max(turn) AS most,
 arg_min(first, i) AS first, arg_max(first, i) AS last
FROM (SELECT *, lag(first) OVER (PARTITION BY part ORDER BY i) AS before FROM lot) GROUP BY part ORDER BY part"""


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables of whole segments, of about LOT_ROWS rows each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < LOT_ROWS:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        keys, segments = t.column("_key").to_pylist(), t.column("segment").to_numpy()
        cut = t.num_rows - 1
        while cut and keys[cut - 1] == keys[-1] and segments[cut - 1] == segments[-1]:
            cut -= 1
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _advanced(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Every segment of the sorted rows: its key, its turns, its cheapest paths from state to state, and its counts."""
    import duckdb

    db = duckdb.connect(":memory:", config={"threads": 1})
    db.register("moves", pa.Table.from_pandas(moves(), preserve_index=False))
    for t in _lots(batches):
        keys, segments = np.array(t.column("_key").to_pylist(), object), t.column("segment").to_numpy()
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (segments[1:] != segments[:-1])]) if len(keys) else []
        if not len(starts):
            continue
        sizes = np.diff(np.r_[starts, len(keys)])
        places = {"part": np.repeat(np.arange(len(starts)), sizes), "i": np.arange(len(keys)) - np.repeat(starts, sizes)}
        db.register("lot", pa.table({**places, **{c: t.column(c) for c in ("turn", "initial", "first", "fault")}}))
        db.register("whole", pa.table({"part": np.arange(len(starts)), "whole": segments[starts] < 0}))
        paths, counts = db.execute(_WALK).fetchall(), db.execute(_COUNT).fetchall()
        for k, (a, n) in enumerate(zip(starts, sizes, strict=True)):
            yield {"_key": keys[a], "segment": int(segments[a]), "paths": paths[k][1], "turns": t.select(["role", "text"]).slice(a, n).to_pylist(), **dict(zip(_COUNTS, counts[k][1:], strict=True))}


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of bounded text."""
    held, size = [], 0
    for r in rows:
        held.append({c: r[c] for c in schema.names})
        size += 200 + sum(len(t["text"]) for t in r.get("turns") or ())
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _walk_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for r in _advanced(batches):
            cost, audit = best_end(r["paths"])
            gaps = 0 if r["least"] is None else r["most"] - r["least"] + 1 - r["numbers"]
            yield {**r, "cost": cost, "audit": audit, "gaps": gaps, "turns": edited(r["turns"], audit)}

    yield from _batched(rows(), _RESULT)


def _walk_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batched(_advanced(batches), _PARTS)


def _joined(rows: Iterator[dict]) -> Iterator[dict]:
    """Segments of long conversations in order, to the cheapest way through all of them.

    Kept while a conversation's segments stream by: for each state the cost and audit so far, and the chain of choices.
    """
    for key, parts in groupby(rows, lambda r: r["_key"]):
        ways: dict[int, tuple] = {0: (0, "", None)}
        sums, segments = dict.fromkeys(FAULT_COUNTS, 0), []
        least = most = last = None
        numbers = 0
        for r in parts:
            found: dict[int, tuple] = {}
            for p in r["paths"]:
                if p["entry"] in ways:
                    cost, audit, chain = ways[p["entry"]]
                    new = (cost + p["cost"], audit + p["audit"])
                    if p["target"] not in found or new < found[p["target"]][:2]:
                        found[p["target"]] = (*new, (chain, p["entry"], p["audit"]))
            ways = found
            segments.append(r["segment"])
            for c in sums:
                sums[c] += r[c]
            sums["illegal"] += last is not None and last + r["first"] not in LEGAL
            last = r["last"]
            if r["least"] is not None:
                # segments follow each other by turn: only the number at their border can be in both
                numbers += r["numbers"] - (most == r["least"])
                least, most = r["least"] if least is None else least, r["most"]
        cost, _, chain, tail = min(((c + INSERT * len(said), a + "I" * len(said), ch, said) for s, (c, a, ch) in ways.items() for at, said in _inserts(s) if at in ENDS), key=lambda x: x[:2])
        whole = {"_key": key, "cost": cost, "gaps": 0 if least is None else most - least + 1 - numbers, **sums}
        for segment in reversed(segments):
            chain, entry, audit = chain
            yield {**whole, "segment": segment, "entry": entry, "audit": audit + "I" * len(tail)}
            tail = ""


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batched(_joined(r for b in batches for r in b.to_pylist()), _CHOSEN)


def _edit_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batched(({**r, "turns": edited(r["turns"], r["audit"], r["entry"])} for b in batches for r in b.to_pylist()), _RESULT)


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]


def with_faults(turns: DataFrame) -> DataFrame:
    """Rows with their conversation's key, role and text without nulls, the role's initial, and the row-local faults."""
    copy = F.col("copy") if "copy" in turns.columns else F.lit(0)
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    end = F.regexp_extract(text, rf"([^{SPACE}])[{SPACE}]*\z", 1)
    return turns.select(
        key_of(F.col("conv_id")).alias("_key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copy.cast("int").alias("copy"),
        F.when(F.substring(role, 1, 1).isin(*ROLES), F.substring(role, 1, 1)).otherwise("-").alias("initial"), F.substring(role, 1, 1).alias("first"),
        F.when(end == "", "blank").when(~end.isin(".", "!", "?"), "truncated").otherwise("fine").alias("_local"),
    )


def key_of(conv_id: Column) -> Column:
    """A conversation's key as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _marked(rows: DataFrame) -> DataFrame:
    """fault: the first fault of each row; a duplicate follows a row of the same role and text."""
    place = F.row_number().over(W.partitionBy("_key", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy"))
    return rows.withColumn("_place", place).withColumn("fault", F.when((F.col("_local") != "blank") & (F.col("_place") > 1), "duplicate").otherwise(F.col("_local"))).drop("_place", "_local")


def _repaired(turns: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Repaired whole conversations, and the segments of long ones where there are any."""
    rows = materialize(with_faults(turns), "repair-rows")
    n = pieces_of(rows, rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0)
    long = materialize(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > SEGMENT).select("_key"), "repair-long")
    any_long = bool(long.limit(1).count())

    def sorted_rows(marked: DataFrame) -> DataFrame:
        return marked.sortWithinPartitions("_key", "segment", *_order()).select("_key", "segment", "turn", "role", "text", "initial", "first", "fault")

    short = rows.join(small(long, MAX_BROADCAST), "_key", "left_anti") if any_long else rows
    # one shuffle: the window over (_key, role, text) and lots of whole conversations both fit rows dealt by _key
    whole = sorted_rows(_marked(short.repartition(n, "_key")).withColumn("segment", F.lit(-1).cast("long"))).mapInArrow(_walk_whole, _RESULT_DDL)
    if not any_long:
        return whole, None
    marked = _marked(rows.join(small(long, MAX_BROADCAST), "_key", "left_semi"))
    ordered = marked.repartitionByRange(n, "_key", *_order()).sortWithinPartitions("_key", *_order())
    numbered = materialize(ordered.withColumn("segment", F.shiftright(F.monotonically_increasing_id(), SEGMENT.bit_length() - 1)), "repair-numbered")
    parts = materialize(sorted_rows(numbered.repartition(n, "_key", "segment")).mapInArrow(_walk_parts, _PARTS_DDL), "repair-parts")
    chosen = parts.drop("turns").repartition(n, "_key").sortWithinPartitions("_key", "segment").mapInArrow(_join_parts, _CHOSEN_DDL)
    return whole, parts.select("_key", "segment", "turns").join(chosen, ["_key", "segment"]).mapInArrow(_edit_parts, _RESULT_DDL)


def repair(turns: DataFrame) -> DataFrame:
    """The repaired conversations: _key (see key_of), segment (-1: all of a conversation; else pieces in ascending order),
    turns (role, text, edit; deleted ones left out), audit of the piece, and of the whole conversation cost, gaps, blank,
    duplicate, truncated, illegal."""
    whole, parts = _repaired(turns)
    return whole if parts is None else whole.unionByName(parts.select(whole.columns))


def _said(turn: dict) -> str:
    return f"{turn['role']}:{turn['text']}"


def _digest_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of long conversations whose pieces stream by in order; texts are hashed as they come."""

    def rows():
        for _, parts in groupby((r for b in batches for r in b.to_pylist()), lambda r: r["_key"]):
            digest, audit, first = hashlib.sha256(), [], True
            for r in parts:
                audit.append(r["audit"])
                for t in r["turns"]:
                    digest.update((("" if first else "\n") + _said(t)).encode())
                    first = False
            yield {**r, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    yield from _batched(rows(), _DIGEST)


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation: _key, the counts, cost, audit, and the hash of its repaired turns."""
    whole, parts = _repaired(turns)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    out = whole.withColumn("repaired_sha256", F.sha2(said, 256)).select(*_DIGEST.names)
    if parts is None:
        return out
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.unionByName(parts.repartition(n, "_key").sortWithinPartitions("_key", "segment").mapInArrow(_digest_parts, _DIGEST_DDL))


#: Cases of the contract's damage, by crc32 of `conv_id:turn` modulo CASES (fixed values).
CASES, DROP, EMPTY, CUT, REPEAT, AS_USER = 20, 0, 1, 2, 3, 4


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage: rows dropped, emptied, stripped of sentence ends, repeated, or given to the user. Nulls in
    the hashed key are one space, as null texts and roles are."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % CASES
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), case.alias("_case")).where(F.col("_case") != DROP)
    text = F.when(F.col("_case") == EMPTY, "").when(F.col("_case") == CUT, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_case") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return t.select("conv_id", "turn", F.when(F.col("_case") == AS_USER, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def contract_digests(turns: DataFrame) -> DataFrame:
    """The contract's row of every conv_id of the undamaged table; one without rows after damage has zeros and empty texts."""
    found = digests(damaged(turns))
    ids = turns.select("conv_id").distinct().withColumn("_key", key_of(F.col("conv_id")))
    numbers = ("gaps", *FAULT_COUNTS, "cost")
    return ids.join(found, "_key", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
