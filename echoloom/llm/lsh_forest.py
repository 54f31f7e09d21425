"""N-gram Jaccard join by a min-hash LSH forest.

Texts become sets of five-word shingles; equal sets are one node. In each of TREES trees a node has a label, a sequence
of min-hash values; the sorted labels of a tree are its prefix trie. Nodes are matched under a common prefix. Matching
starts at full_depth() values, the longest prefix at which a pair at the threshold meets in some tree with the target
recall, and shortens from there, subtree by subtree, as long as the subtree has no more than CROWD nodes, down to
LEAST_DEPTH values: crowded parts of a trie stop at the depth that the target needs, thin parts go on and miss less.
expected_recall() gives the recall of a pair from the depths at which its nodes stopped; it never falls below the target.

Members of a thin subtree are linked where their 128-bit sketches (one bit of a min-hash value each) are near, so that
short prefixes don't tie strangers together; a crowded subtree is linked whole to its least node. Candidate groups are
the components of these links, and within a group every pair is verified exactly, on the sets, in square blocks of
bounded size, so that no group is in one task and pairs are counted, not listed.

Result: each document's class (the least doc_id of its connected component of exact links) and its number of links, that
is of other documents with a likeness at or over the threshold, copies included. Work is quadratic only in the number of
different texts of one candidate group, as counting all links asks; copies cost nothing.

What can be missed: a pair of different texts at likeness j whose nodes stop at depths d in the trees meets with
probability 1 - prod(1 - j^d): 0.9972 at 0.8 if every subtree is crowded (depth 8), 1 - 6e-8 if all are thin (depth 4),
less one in three million for the sketches. A missed pair is still in one class if a chain of other links joins it.

Defined results: words are runs of characters outside ASCII white space; a text of one to four words has one shingle,
all of it; a null text or one without words links to nothing and is its own class; rows that repeat a doc_id are
documents each; ties need no order, all decisions are by sets and least doc_ids; an empty table gives no row; a very
long text is one set, held whole by the tasks of its blocks. Only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize, packed, small, unpacked, words
from .components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 32
TARGET_RECALL = 0.995
#: Values of a label that the target may ask for at most, and the shortest prefix that is matched.
MAX_DEPTH = 8
LEAST_DEPTH = 4
#: Nodes below a prefix up to which it is shortened further.
CROWD = 64
#: Bits of a sketch, and how many of them may differ: 5 standard deviations from what a pair at 0.8 has.
SKETCH_BITS = 128
SKETCH_SLACK = 30
#: Shingles of one side of a block.
BLOCK_SHINGLES = 400_000
SEED = 4242


def expected_recall(depths, threshold: float = THRESHOLD) -> float:
    """Chance that a pair at the threshold shares the prefix of the given depth in at least one tree."""
    return 1 - math.prod(1 - threshold**d for d in depths)


def full_depth(threshold: float = THRESHOLD, trees: int = TREES, target: float = TARGET_RECALL) -> int:
    """The longest prefix that reaches the target in all trees together: matching never stops at a longer one."""
    reached = [d for d in range(LEAST_DEPTH, MAX_DEPTH + 1) if expected_recall([d] * trees, threshold) >= target]
    if not reached:
        raise ValueError(f"{trees} trees can't reach recall {target} at {threshold} with prefixes of {LEAST_DEPTH} values; use more trees")
    return reached[-1]


def with_shingles(df: DataFrame, text: str = "text", n: int = SHINGLE) -> DataFrame:
    """df with `shingles`: 64-bit hashes of the n-word shingles, as they come. Narrow."""
    t = df.withColumn("_w", words(F.col(text)))
    size = F.size("_w")
    many = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(n)]))
    out = F.when(size >= n, many).when(size > 0, F.array(F.xxhash64(F.array_join("_w", " ")))).otherwise(F.array().cast("array<bigint>"))
    return t.withColumn("shingles", out).drop("_w")


class MinHash:
    """Signatures of hash sets: the least value of each of many multiplicative permutations of 32-bit hashes."""

    def __init__(self, values: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 31, values, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, values, dtype=np.uint32)
        self.buffer = np.empty((1024, values), np.uint32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        h = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), np.iinfo(np.uint32).max, np.uint32)
        for k in range(0, len(h), 1024):
            part = h[k : k + 1024, None]
            out = self.buffer[: len(part)]
            np.multiply(part, self.a, out=out)
            np.add(out, self.b, out=out)
            np.minimum(least, out.min(axis=0), out=least)
        return least


def labels(signatures: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """(heads, rests), a row a node and a column a tree: a hash of the tree and the label's first LEAST_DEPTH values, and
    the next values of 16 bits each from the top of a 64-bit number, so that numbers sort as the labels do."""
    v = signatures.reshape(len(signatures), trees, MAX_DEPTH).astype(np.uint64)
    head = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), v.shape[:2]).copy()
    for j in range(LEAST_DEPTH):
        head = (head ^ v[:, :, j]) * np.uint64(0xBF58476D1CE4E5B9)
        head ^= head >> np.uint64(29)
    rest = np.zeros(v.shape[:2], np.uint64)
    for j in range(LEAST_DEPTH, MAX_DEPTH):
        rest |= (v[:, :, j] & np.uint64(0xFFFF)) << np.uint64(16 * (MAX_DEPTH - 1 - j))
    return head.view(np.int64), rest.view(np.int64)


def sketches(signatures: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits a node, one mixed bit of each of the first values, as 64-bit numbers."""
    mixed = (signatures[:, :SKETCH_BITS] * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.packbits(mixed.astype(np.uint8), axis=1).view(np.int64)


_SIGNED = "node binary, n long, heads array<long>, rests array<long>, sketch array<long>"


def signed(docs: DataFrame, trees: int = TREES, n: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, text_key, node (128-bit hash of the shingle set, null without words), its size n, labels and sketch; one narrow pass."""
    t = with_shingles(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text"), n=n).drop("text")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = MinHash(trees * MAX_DEPTH, seed)
        for p in parts:
            lists = p.column("shingles")
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(np.asarray(lists.value_lengths().to_pylist(), dtype=np.int64))
            node, size, made = [], [], []
            start = 0
            for end in ends:
                h = np.unique(flat[start:end])
                start = end
                size.append(len(h))
                node.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                if len(h):
                    made.append(sign(h))
            signature = np.array(made, dtype=np.uint32).reshape(len(made), trees * MAX_DEPTH)
            some = np.array([x > 0 for x in size], dtype=np.int64)

            def column(values: np.ndarray) -> pa.Array:
                """A list a row, empty where the row has no node."""
                offsets = np.concatenate([[0], np.cumsum(some * values.shape[1])]).astype(np.int32)
                return pa.ListArray.from_arrays(offsets, np.ascontiguousarray(values).ravel())

            heads, rests = labels(signature, trees)
            yield pa.RecordBatch.from_arrays([p.column("doc_id"), p.column("text_key"), pa.array(node, pa.binary()), pa.array(size, pa.int64()), column(heads), column(rests), column(sketches(signature))], names=["doc_id", "text_key", "node", "n", "heads", "rests", "sketch"])

    return t.mapInArrow(batches, f"doc_id {dict(docs.dtypes)['doc_id']}, text_key long, {_SIGNED}")


def matched(nodes: DataFrame, depth: int, crowd: int = CROWD) -> DataFrame:
    """Rows (node, sketch, head, depth, prefix, together, lead) of every node and tree in which it is not alone under its
    prefix, sorted by label within tasks.

    One shuffle brings the labels of one head together, sorted; counts of nodes under each longer prefix come from that
    order. `depth` values are the stop of crowded subtrees.
    """
    trees = nodes.select("node", "sketch", F.explode(F.arrays_zip("heads", "rests")).alias("_t")).select("node", "sketch", F.col("_t.heads").alias("head"), F.col("_t.rests").alias("rest"))
    t = trees.withColumn("_n0", F.count(F.lit(1)).over(W.partitionBy("head"))).where(F.col("_n0") > 1)

    def prefix(d: int) -> Column:
        return F.shiftright("rest", 16 * (MAX_DEPTH - d)) if d > LEAST_DEPTH else F.lit(0).cast("long")

    for d in range(LEAST_DEPTH + 1, depth + 1):
        t = t.withColumn(f"_p{d}", prefix(d))
    for d in range(LEAST_DEPTH + 1, depth + 1):
        t = t.withColumn(f"_n{d - LEAST_DEPTH}", F.count(F.lit(1)).over(W.partitionBy("head", *[f"_p{k}" for k in range(LEAST_DEPTH + 1, d + 1)])))
    stop = F.lit(depth)
    for d in range(depth - 1, LEAST_DEPTH - 1, -1):
        stop = F.when(F.col(f"_n{d - LEAST_DEPTH}") <= crowd, F.lit(d)).otherwise(stop)
    t = t.withColumn("depth", stop)

    def chosen(of) -> Column:
        return F.coalesce(*[F.when(F.col("depth") == d, of(d)) for d in range(LEAST_DEPTH, depth + 1)])

    t = t.withColumns({"prefix": chosen(prefix), "together": chosen(lambda d: F.col(f"_n{d - LEAST_DEPTH}"))}).where(F.col("together") > 1)
    full = W.partitionBy("head", *[f"_p{k}" for k in range(LEAST_DEPTH + 1, depth + 1)])
    return t.withColumn("lead", F.min("node").over(full)).select("node", "sketch", "head", "depth", "prefix", "together", "lead")


def near_in_groups(group: np.ndarray, sketch: np.ndarray, slack: int) -> np.ndarray:
    """For sorted rows with group numbers: the least row of each row's component among rows of its group whose sketches
    differ in at most `slack` bits."""
    n = len(group)
    first, second = [], []
    for j in range(1, n):
        i = np.flatnonzero(group[j:] == group[:-j])
        if not len(i):
            break
        apart = np.bitwise_count(sketch[i] ^ sketch[i + j]).sum(axis=1)
        near = i[apart <= slack]
        first.append(near)
        second.append(near + j)
    label = np.arange(n)
    if first:
        a, b = np.concatenate(first), np.concatenate(second)
        while True:
            least = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, least)
            np.minimum.at(new, b, least)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
    return label


def candidate_links(rows: DataFrame, crowd: int = CROWD, slack: int = SKETCH_SLACK) -> DataFrame:
    """(a, b): links that join each candidate group. Streams over rows of matched(); holds a batch and one thin subtree."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def linked(t: pa.Table) -> pa.RecordBatch:
            node = np.array(t.column("node").to_pylist(), dtype=object)
            crowded = t.column("together").to_numpy() > crowd
            a, b = [np.array(t.column("lead").to_pylist(), dtype=object)[crowded]], [node[crowded]]
            thin = ~crowded
            if thin.any():
                keys = np.column_stack([t.column(c).to_numpy() for c in ("head", "depth", "prefix")])[thin]
                group = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
                sketch = t.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(t), -1).view(np.uint64)[thin]
                names = node[thin]
                label = near_in_groups(group, sketch, slack)
                tied = np.flatnonzero(label != np.arange(len(label)))
                a.append(names[label[tied]])
                b.append(names[tied])
            left, right = np.concatenate(a), np.concatenate(b)
            apart = left != right
            return pa.RecordBatch.from_arrays([pa.array(left[apart].tolist(), pa.binary()), pa.array(right[apart].tolist(), pa.binary())], names=["a", "b"])

        for p in parts:
            t = pa.Table.from_batches([p]) if held is None else pa.concat_tables([held, pa.Table.from_batches([p])])
            # the last subtree may go on in the next batch
            keys = np.column_stack([t.column(c).to_numpy() for c in ("head", "depth", "prefix")])
            changes = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
            whole = int(changes[-1]) + 1 if len(changes) else 0
            if t.column("together")[-1].as_py() > crowd:
                whole = len(t)
            held = t.slice(whole)
            if whole:
                yield linked(t.slice(0, whole))
        if held is not None and len(held):
            yield linked(held)

    return rows.mapInArrow(batches, "a binary, b binary")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common members of every left and right set: products of incidence matrices over the members both sides have."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    ra, rb = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    ca, cb = np.searchsorted(common, a), np.searchsorted(common, b)
    ia = (ca < len(common)) & (common[np.minimum(ca, len(common) - 1)] == a) if len(common) else np.zeros(len(a), bool)
    ib = (cb < len(common)) & (common[np.minimum(cb, len(common) - 1)] == b) if len(common) else np.zeros(len(b), bool)
    ra, ca, rb, cb = ra[ia], ca[ia], rb[ib], cb[ib]
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ra, ca, rb, cb = ra[oa], ca[oa], rb[ob], cb[ob]
    wide = 4096
    for k in range(0, len(common), wide):
        x, y = np.zeros((len(left), wide), np.float32), np.zeros((len(right), wide), np.float32)
        s, e = np.searchsorted(ca, [k, k + wide])
        x[ra[s:e], ca[s:e] - k] = 1
        s, e = np.searchsorted(cb, [k, k + wide])
        y[rb[s:e], cb[s:e] - k] = 1
        out += x @ y.T
    return out


def verify_block(left: pd.DataFrame, right: pd.DataFrame | None, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Exact links of a square block: each side's links (weighted by copies) and a spanning forest of the linked rows.

    Rows are numbered through, left then right; right is None for a block with itself.
    """
    both = left if right is None else right
    a = [np.asarray(x, np.int64) for x in left["shingles"]]
    b = a if right is None else [np.asarray(x, np.int64) for x in right["shingles"]]
    common = shared_counts(a, b)
    na, nb = np.array([len(x) for x in a], np.float64), np.array([len(x) for x in b], np.float64)
    union = na[:, None] + nb[None, :] - common
    linked = common >= threshold * union - 1e-6
    if right is None:
        np.fill_diagonal(linked, False)
    ca, cb = left["copies"].to_numpy(np.int64), both["copies"].to_numpy(np.int64)
    links_left = linked @ cb
    links_right = linked.T @ ca
    # forest: breadth-first from each row that no tree has yet; every row that is reached hangs from the first
    shift = 0 if right is None else len(a)
    free = np.ones(len(a), bool), np.ones(len(b), bool)
    if right is None:
        free = free[0], free[0]
    forest = []
    for i in np.flatnonzero(linked.any(axis=1)):
        if not free[0][i]:
            continue
        free[0][i] = False
        front = np.array([i])
        while len(front):
            over = np.flatnonzero(linked[front].any(axis=0) & free[1])
            free[1][over] = False
            forest += [(int(i), int(j) + shift) for j in over]
            front = over
            if right is not None and len(over):
                back = np.flatnonzero(linked[:, over].any(axis=1) & free[0])
                free[0][back] = False
                forest += [(int(i), int(j)) for j in back]
                front = back
    return links_left, links_right, forest


def _verify(f: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Rows of one piece of work: candidate groups, or one square block of a large group -> links and forest edges."""
    rows: list[tuple] = []
    for _, g in f.groupby("grp", sort=True):
        g = g.sort_values(["side", "node"], kind="stable")
        left, right = g[g["side"] == 0], g[g["side"] == 1]
        if not len(left):
            continue
        l, r, forest = verify_block(left, right if len(right) else None, threshold)
        names = list(left["node"]) + list(right["node"])
        counts = list(l) + (list(r) if len(right) else [])
        # a block of a large group that stands alone has an empty right side and compares with itself
        rows += [(n, int(c), None) for n, c in zip(names, counts, strict=True) if c]
        rows += [(names[i], 0, names[j]) for i, j in forest]
    return pd.DataFrame(rows, columns=["node", "links", "other"])


def link_classes(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, target: float = TARGET_RECALL, n: int = SHINGLE, block_shingles: int = BLOCK_SHINGLES, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): rows are doc_id, text_key, node of every document; nodes are node, class_id, class_key, copies, n_links
    of every node with copies or links (class_key: the text_key of the row that stands for the class)."""
    depth = full_depth(threshold, trees, target)
    rows = materialize(signed(docs, trees, n), "join-signed")
    nodes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "heads", "rests", "sketch")])
    nodes = materialize(nodes, "join-nodes")
    groups = connected_components(candidate_links(matched(nodes, depth, crowd), crowd))
    members = groups.join(nodes.select("node", "rep", "copies", "n"), "node")
    weights = members.groupBy("label").agg(F.sum("n").alias("weight"))
    members = members.join(weights, "label")
    members = materialize(members.select("node", F.col("label").alias("grp"), "weight", "n", "copies", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_key").alias("text_key")), "join-members")
    # the sets of the candidates only, from their texts
    keyed_docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    found = small(members, 100_000)
    sets = keyed_docs.join(found, keyed_docs["doc_id"].eqNullSafe(found["doc_id"]) & (keyed_docs["text_key"] == found["text_key"])).select(found["node"], "grp", "weight", "copies", "text")
    sets = with_shingles(sets, n=n).withColumn("shingles", F.array_sort(F.array_distinct("shingles"))).drop("text").dropDuplicates(["node"])
    # small groups share pieces of work; a large one is cut to blocks of bounded shingles, and each pair of blocks is a piece of its own
    pieces = F.ceil(F.col("weight") / block_shingles).cast("int")
    of = F.pmod(F.xxhash64("node"), pieces).cast("int")
    total = members.agg(F.sum("n").alias("n")).first()["n"] or 0
    lots = max(1, math.ceil(total / block_shingles))
    alone = sets.where(pieces <= 1).select("*", F.pmod(F.xxhash64("grp"), F.lit(lots)).cast("long").alias("lot"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side"))
    cut = sets.where(pieces > 1).withColumns({"_p": pieces, "_of": of})
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_p") - 1))).select(*sets.columns, F.xxhash64("grp").alias("lot"), F.least("_of", "_other").alias("i"), F.greatest("_of", "_other").alias("j"), F.when(F.col("_of") <= F.col("_other"), 0).otherwise(1).alias("side"))
    work = alone.unionByName(cut).select("grp", "node", "copies", "shingles", "lot", "i", "j", "side")
    kind = "node binary, links long, other binary"
    verified = materialize(work.groupBy("lot", "i", "j").applyInPandas(lambda f: _verify(f, threshold), kind), "join-links")
    links = verified.where(F.col("other").isNull()).groupBy("node").agg(F.sum("links").alias("links"))
    forest = verified.where(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b"))
    classes = connected_components(forest)
    reps = nodes.select("node", "rep", "copies")
    linked = classes.join(reps, "node").join(links, "node", "left")
    class_rep = linked.groupBy("label").agg(F.min("rep").alias("class_rep"))
    in_class = linked.join(class_rep, "label").select("node", "class_rep", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    copied = reps.where(F.col("copies") > 1).join(classes, "node", "left_anti").select("node", F.col("rep").alias("class_rep"), "copies", F.lit(0).cast("long").alias("links"))
    out = in_class.unionByName(copied).select("node", F.col("class_rep.doc_id").alias("class_id"), F.col("class_rep.text_key").alias("class_key"), "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = materialize(out, "join-classes")
    for t in (nodes, members, verified):
        discard(t)
    return rows.select("doc_id", "text_key", "node"), out


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links of every document."""
    rows, nodes = link_classes(docs, **options)
    # nodes that stand alone have no row in `nodes`; copies of one text that are many make one hot key, split by Spark
    found = small(nodes, 100_000)
    return rows.join(found, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def without_duplicates(docs: DataFrame, **options) -> DataFrame:
    """documents with one row of each class left: the one of least doc_id. Texts without words stay."""
    rows, nodes = link_classes(docs, **options)
    found = small(nodes, 100_000)
    judged = rows.join(found, "node").where(~(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_key"))))
    gone = small(materialize(judged.select("doc_id", "text_key").distinct(), "join-gone"), 100_000)
    keyed = packed(docs, "doc_id", "text").withColumn("_text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["doc_id"]) & (keyed["_text_key"] == gone["text_key"]), "left_anti")
    # rows alike in doc_id and text are one class with one representative: only where there are any, one of each stays
    again = rows.where(F.col("node").isNotNull()).groupBy("doc_id", "text_key").count().where(F.col("count") > 1).limit(1).count()
    if again:
        worded = kept.where(F.size(words(F.col("text"))) > 0).dropDuplicates(["doc_id", "_text_key"])
        kept = worded.unionByName(kept.where(F.size(words(F.col("text"))) == 0))
    return unpacked(kept, docs.columns)
