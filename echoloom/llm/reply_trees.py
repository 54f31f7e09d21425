"""Chat formatting over reply trees.

Messages (conv_id, node_id, parent_id, role, text, score) form trees. Iterative self-joins with doubled steps find each
node's depth and score to its root; leaves rank by the mean score of their root-to-leaf path; the same doubled steps
then list the nodes of each chosen path, and each path becomes one formatted conversation with a loss mask.
A path of d messages takes about log2(d) joins over narrow rows; texts join once, at the end.

Template: `<|role|>` text `<|end|>` for each turn. In texts `&`, `<` and `[` become `&amp;`, `&lt;` and `&#91;` (in roles
`|` too), so no control string of this or of another template that starts with `<` or `[` survives in a text, and
unescape() restores each text exactly. The loss mask lists [start, end) code point spans of the assistant's texts.

Defined results: null texts and null roles are empty strings; rows without a conv_id are one conversation; a parent that doesn't exist makes a node a root; repeated
(conv_id, node_id) rows are one node, the smallest row; nodes on a cycle belong to no path; ties between leaves go to
the longer path, then to the smaller node_id; an empty table gives no conversation. Further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

END = "<|end|>"
#: Turns that are joined to one string before the whole conversation is.
CHUNK = 64
_KEY = ["conv_id", "node_id"]


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))
    return F.replace(out, F.lit("|"), F.lit("&#124;")) if role else out


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&#124;"), F.lit("|")), F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def linear_tree(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text as a tree in which each turn replies to the one before; turns that repeat a number are
    put in order of role and text."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = turns.select("conv_id", F.row_number().over(order).cast("long").alias("node_id"), "role", "text")
    return t.select("conv_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def keyed(nodes: DataFrame) -> DataFrame:
    """conv_id as a struct that is never null, so that joins match rows without one too."""
    c = F.col("conv_id")
    empty = F.lit("" if dict(nodes.dtypes)["conv_id"] == "string" else 0).cast(nodes.schema["conv_id"].dataType)
    return nodes.withColumn("conv_id", F.struct(c.isNull().alias("none"), F.coalesce(c, empty).alias("id")))


def unkeyed(df: DataFrame) -> DataFrame:
    return df.withColumn("conv_id", F.when(~F.col("conv_id.none"), F.col("conv_id.id")))


def chosen_paths(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """(conv_id, leaf_id, depth, node_id) of the paths to the per_tree best leaves of every conversation."""
    return unkeyed(_chosen_paths(keyed(nodes), per_tree))


def _chosen_paths(nodes: DataFrame, per_tree: int) -> DataFrame:
    """chosen_paths() of keyed() nodes.

    Each round joins the state with itself: the ancestor 2^k steps up, the depth and the score so far. The number of
    rounds follows from the largest conversation, one count before the loop.
    """
    plain = materialize(nodes.groupBy(*_KEY).agg(F.min(F.struct("parent_id", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("m")).select(*_KEY, "m.parent_id", "m.score"), "chat-nodes")
    largest = plain.groupBy("conv_id").count().agg(F.max("count").alias("n")).first()["n"] or 1
    rounds = max(1, math.ceil(math.log2(largest + 1)))
    parents = plain.select("conv_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("_there"))
    state = plain.join(parents, ["conv_id", "parent_id"], "left").select(*_KEY, F.when(F.col("_there"), F.col("parent_id")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
    steps = []
    for k in range(rounds):
        state = materialize(state, f"chat-step{k}")
        steps.append(state)
        above = state.select("conv_id", F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("total").alias("_t"))
        state = state.join(above, ["conv_id", "up"], "left").select(*_KEY, F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("_t", F.lit(0.0))).alias("total"))
    inner = steps[0].where(F.col("up").isNotNull()).select("conv_id", F.col("up").alias("node_id")).distinct()
    leaves = state.where(F.col("up").isNull()).join(inner, _KEY, "left_anti")
    best = W.partitionBy("conv_id").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node_id")
    leaves = leaves.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= per_tree)
    # every distance from a leaf is one sum of powers of two: the steps from large to small reach each ancestor once
    path = leaves.select("conv_id", F.col("node_id").alias("leaf_id"), "node_id", "depth")
    for step in reversed(steps):
        # in state k, depth counts the nodes from node_id up to before `up`
        hop = step.where(F.col("up").isNotNull()).select("conv_id", "node_id", F.col("up").alias("_up"), F.col("depth").alias("_d"))
        path = path.join(hop, _KEY, "left").select("conv_id", "leaf_id", F.explode(F.when(F.col("_up").isNull(), F.array(F.struct("node_id", "depth"))).otherwise(F.array(F.struct("node_id", "depth"), F.struct(F.col("_up").alias("node_id"), (F.col("depth") - F.col("_d")).alias("depth"))))).alias("x")).select("conv_id", "leaf_id", "x.node_id", "x.depth")
    return path


def format_trees(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """(conv_id, leaf_id, n_messages, formatted, loss_spans) of the chosen paths."""
    nodes = keyed(nodes)
    paths = _chosen_paths(nodes, per_tree)
    texts = nodes.groupBy(*_KEY).agg(F.min(F.struct("parent_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m")).select(*_KEY, "m.role", "m.text")
    turns = paths.join(texts, _KEY)
    head = F.concat(F.lit("<|"), escape(F.col("role"), role=True), F.lit("|>"))
    body = escape(F.col("text"))
    turn = F.struct("depth", F.concat(head, body, F.lit(END)).alias("s"), F.char_length(head).alias("h"), F.char_length(body).alias("b"), (F.col("role") == "assistant").alias("loss"))
    # chunks first, so that a very long conversation arrives at its last task as few rows
    chunks = turns.groupBy("conv_id", "leaf_id", F.floor(F.col("depth") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    chunks = chunks.select("conv_id", "leaf_id", F.struct("chunk", F.array_join(F.transform("turns", lambda x: x["s"]), "").alias("s"), F.transform("turns", lambda x: F.struct(x["h"].alias("h"), x["b"].alias("b"), x["loss"].alias("loss"))).alias("parts")).alias("c"))
    joined = chunks.groupBy("conv_id", "leaf_id").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    joined = joined.select("conv_id", "leaf_id", F.array_join(F.transform("cs", lambda c: c["s"]), "").alias("formatted"), F.flatten(F.transform("cs", lambda c: c["parts"])).alias("parts"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    spans = F.aggregate(
        "parts", zero,
        lambda a, p: F.struct(
            (a["at"] + p["h"] + p["b"] + len(END)).alias("at"),
            F.when(p["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + p["h"]).alias("start"), (a["at"] + p["h"] + p["b"]).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return unkeyed(joined).select("conv_id", "leaf_id", F.size("parts").cast("long").alias("n_messages"), "formatted", spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests read from the formatted strings and the loss masks alone."""
    pieces = F.split("formatted", r"<\|end\|>", -1)
    t = formatted.select("*", F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("_turns"))
    turns = F.transform("_turns", lambda s: F.concat(unescape(F.regexp_extract(s, r"(?s)^<\|([^|]*)\|>", 1)), F.lit("\n"), unescape(F.regexp_extract(s, r"(?s)^<\|[^|]*\|>(.*)$", 1)), F.lit("\n")))
    loss = F.transform("loss_spans", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["end"] - x["start"])))
    t = t.select("*", F.array_join(turns, "").alias("_all"), F.array_join(loss, "").alias("_loss"))
    return t.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2("_all", 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "leaf_id",
    )
