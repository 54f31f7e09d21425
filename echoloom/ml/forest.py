"""Random forests of binned rows that are alike: all trees, folds and levels share their passes.

Features are cut to BINS by quantiles of all rows, missing values at the median. Rows of one cell, label and code are one row with a
count, whose bootstrap weight in a tree is Poisson of the count, which is what its rows would draw one by one. A level of all trees is one
pass: a task sends each tree's histograms of its open nodes, and their sum decides the splits (Gini, a random root of the features a node).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize, spread

#: Bins of a feature, and numbers of histograms that one pass may sum.
BINS, PASS_NUMBERS = 32, 1 << 22


@dataclass
class Cuts:
    """Borders of each feature's bins, and the bin of its missing values."""

    borders: list[np.ndarray]
    gone: list[int]

    def codes(self, batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
        out = np.empty((batch.num_rows, len(features)), np.uint8)
        for k, c in enumerate(features):
            v = batch.column(c).to_numpy(zero_copy_only=False).astype(float)
            out[:, k] = np.where(np.isfinite(v), np.searchsorted(self.borders[k], v, "left"), self.gone[k])
        return out


def cuts(df: DataFrame, features: list[str]) -> Cuts:
    """By quantiles of the values that are there, in one aggregation."""
    shares = [k / BINS for k in range(1, BINS)]
    row = df.agg(*[F.struct(F.percentile_approx(c, shares, 10_000).alias("q"), F.max(c).alias("high"), F.percentile_approx(c, 0.5, 10_000).alias("middle")).alias(f"_{k}") for k, c in enumerate(features)]).first()
    borders = [np.unique([v for v in row[f"_{k}"]["q"] or [] if v < row[f"_{k}"]["high"]]) for k in range(len(features))]
    return Cuts(borders, [int(np.searchsorted(b, row[f"_{k}"]["middle"] or 0.0, "left")) for k, b in enumerate(borders)])


def folded(df: DataFrame, features: list[str], at: Cuts) -> DataFrame:
    """cell, label, code (a byte a feature), n of the rows (cell, label, features), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sides = np.column_stack([b.column(c).to_numpy().astype(np.int32) for c in ("cell", "label")])
                rows = np.column_stack([sides.view(np.uint8), at.codes(b, features)])
                found, n = np.unique(rows.view(np.dtype((np.void, rows.shape[1]))).ravel(), return_counts=True)
                found = found.view(np.uint8).reshape(len(found), -1)
                cell, label = np.ascontiguousarray(found[:, :8]).view(np.int32).T
                yield pa.RecordBatch.from_pydict({"cell": pa.array(cell), "label": pa.array(label), "code": pa.array([r.tobytes() for r in found[:, 8:]], pa.binary()), "n": pa.array(n, pa.int64())})

    t = df.select(F.col("cell").cast("int"), F.col("label").cast("int"), *features).mapInArrow(run, "cell int, label int, code binary, n long")
    return materialize(t.groupBy("cell", "label", "code").agg(F.sum("n").alias("n")), "forest-rows")


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


@dataclass
class Forest:
    """Trees by node, the children of node i being 2 i and 2 i + 1: feature (-1: a leaf), last bin that goes left, share of class 1."""

    feature: np.ndarray
    border: np.ndarray
    share: np.ndarray
    gains: np.ndarray

    def nodes(self, tree: int, codes: np.ndarray, depth: int) -> np.ndarray:
        node = np.ones(len(codes), np.int64)
        for _ in range(depth):
            f = self.feature[tree, node]
            right = codes[np.arange(len(codes)), np.maximum(f, 0)] > self.border[tree, node]
            node = np.where(f >= 0, 2 * node + right, node)
        return node

    def scores(self, codes: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.feature.shape[1])) - 1
        return sum((self.share[k, self.nodes(k, codes, depth)] for k in range(len(self.feature))), np.zeros(len(codes))) / len(self.feature)

    def importance(self) -> np.ndarray:
        """Mean of the trees' shares of gain."""
        total = self.gains.sum(1, keepdims=True)
        shares = np.where(total > 0, self.gains / np.where(total > 0, total, 1), 0.0).sum(0)
        return shares / shares.sum() if shares.sum() > 0 else shares


def grow(rows: DataFrame, width: int, trains: list[tuple[int, ...]], trees: int, depth: int = 8, seed: int = 42) -> list[Forest]:
    """A forest for each set of training cells, of folded() rows; classes of a set weigh alike."""
    sizes = {(r["cell"], r["label"]): r["n"] for r in rows.groupBy("cell", "label").agg(F.sum("n").alias("n")).collect()}  # a row a cell and class
    weights = []
    for train in trains:
        n = np.array([sum(v for (c, y), v in sizes.items() if c in train and y == label) for label in (0, 1)], float)
        weights.append(np.where(n > 0, n.sum() / (np.maximum((n > 0).sum(), 1) * np.maximum(n, 1)), 1.0))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h = b.column("_h").to_numpy()
                order = np.argsort(h, kind="stable")
                w = np.empty((b.num_rows, trees), np.int64)
                w[order] = np.random.default_rng([seed, int(h[order[0]]) & (2**63 - 1)]).poisson(b.column("n").to_numpy()[order, None], (b.num_rows, trees))
                yield pa.RecordBatch.from_arrays([b.column("cell"), b.column("label"), b.column("code"), pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, trees), pa.int32()), pa.array(w.ravel()))], names=["cell", "label", "code", "w"])

    drawn = materialize(spread(rows).withColumn("_h", F.xxhash64("cell", "label", "code")).mapInArrow(draw, "cell int, label int, code binary, w array<long>"), "forest-draws")
    size, m, rng = 2 ** (depth + 1), int(np.ceil(np.sqrt(width))), np.random.default_rng(seed)
    forests = [Forest(np.full((trees, size), -1), np.zeros((trees, size), np.int64), np.full((trees, size), 0.5), np.zeros((trees, width))) for _ in trains]
    open_nodes = {(j, k): [1] for j in range(len(trains)) for k in range(trees)}
    for level in range(depth):
        asked = {key: np.stack([rng.choice(width, m, replace=False) for _ in nodes]) for key, nodes in open_nodes.items() if nodes}
        keys, opened = list(asked), {}
        most = max(1, PASS_NUMBERS // max(1, max((len(open_nodes[k]) for k in keys), default=1) * m * BINS * 2))
        for part in (keys[k : k + most] for k in range(0, len(keys), most)):
            for key, sums in _histograms(drawn, width, forests, trains, weights, {k: (open_nodes[k], asked[k]) for k in part}, level).items():
                opened[key] = _split(forests[key[0]], key[1], open_nodes[key], asked[key], sums.reshape(-1, m, BINS, 2))
        open_nodes = opened
    discard(drawn)
    return forests


def _histograms(drawn: DataFrame, width: int, forests: list[Forest], trains: list[tuple[int, ...]], weights: list[np.ndarray], asked: dict, level: int) -> dict[tuple[int, int], np.ndarray]:
    """(forest, tree) -> weights by open node, feature asked there, bin and class, summed over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            codes, cell, label = unpacked(b.column("code"), width), b.column("cell").to_numpy(), b.column("label").to_numpy()
            w = b.column("w").flatten().to_numpy().reshape(b.num_rows, -1)
            for (j, k), (nodes, features) in asked.items():
                mine = np.flatnonzero(np.isin(cell, trains[j]) & (w[:, k] > 0))
                slots = np.full(forests[j].feature.shape[1], -1)
                slots[nodes] = np.arange(len(nodes))
                slot = slots[forests[j].nodes(k, codes[mine], level)]
                mine, slot = mine[slot >= 0], slot[slot >= 0]
                weight = w[mine, k] * weights[j][label[mine]]
                if (j, k) not in held:
                    held[j, k] = np.zeros(features.size * BINS * 2)
                for i in range(features.shape[1]):
                    place = ((slot * features.shape[1] + i) * BINS + codes[mine, features[slot, i]]) * 2 + label[mine]
                    held[j, k] += np.bincount(place, weight, features.size * BINS * 2)
        if held:
            ends = np.cumsum([0, *map(len, held.values())])
            yield pa.RecordBatch.from_pydict({"forest": pa.array([j for j, _ in held], pa.int32()), "tree": pa.array([k for _, k in held], pa.int32()), "sums": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(list(held.values()))))})

    found = drawn.mapInArrow(run, "forest int, tree int, sums array<double>").groupBy("forest", "tree").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
    return {(r["forest"], r["tree"]): r["sums"].toArray() for r in found.collect()}  # a row a tree


def _split(forest: Forest, tree: int, nodes: list[int], features: np.ndarray, sums: np.ndarray) -> list[int]:
    """The children of the nodes that split."""
    out = []
    impurity = lambda s: 1 - ((s / np.maximum(s.sum(-1, keepdims=True), 1e-300)) ** 2).sum(-1)
    for node, asked, h in zip(nodes, features, sums, strict=True):
        total = h[0].sum(0)
        if total.sum() <= 0:
            continue
        forest.share[tree, node] = total[1] / total.sum()
        left = np.cumsum(h, axis=1)[:, :-1]
        right = total - left
        a, b = left.sum(-1), right.sum(-1)
        gain = impurity(total) - (a * impurity(left) + b * impurity(right)) / total.sum()
        gain = np.where((a > 1e-9) & (b > 1e-9 * total.sum()), gain, -np.inf)
        i, k = np.unravel_index(gain.argmax(), gain.shape)
        if gain[i, k] > 1e-12:
            forest.feature[tree, node], forest.border[tree, node] = asked[i], k
            forest.gains[tree, asked[i]] += gain[i, k] * total.sum()
            for child, s in ((2 * node, left[i, k]), (2 * node + 1, right[i, k])):
                forest.share[tree, child] = s[1] / s.sum()
                out.append(child)
    return out


def scored_rows(df: DataFrame, features: list[str], at: Cuts, forests: list[Forest], fold: str) -> DataFrame:
    """df with `score`, by the forest of each row's `fold`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, of, score = at.codes(b, features), b.column(fold).to_numpy(), np.zeros(b.num_rows)
            for j in np.unique(of).tolist():
                score[of == j] = forests[j].scores(codes[of == j])
            yield b.append_column("score", pa.array(score))

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())]))


#: Rows of one block of a permutation, which are different codes.
BLOCK_CODES = 100_000


def permuted_scores(rows: DataFrame, width: int, forest: Forest, repeats: int, seed: int = 42) -> DataFrame:
    """feature (number), repeat, score, p, q: counts of class 1 and 0 by score when rows take another row's value of a feature.

    Of a block of rows that are alike it is random how many of a value meet which rows, as in a permutation of the rows one by one: a
    multivariate hypergeometric draw, row by row from the values that are left. Every value is given exactly once a repeat."""
    blocks = max(1, -(-rows.count() // BLOCK_CODES), -(-(rows.agg(F.sum("n")).first()[0] or 0) // 500_000_000))
    t = rows.groupBy("label", "code").agg(F.sum("n").alias("n")).withColumn("_block", F.pmod(F.xxhash64("code", "label"), F.lit(blocks)).cast("int"))
    t = t.withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))

    def permute(part: pa.Table) -> pa.Table:
        block, k, repeat = (part.column(c)[0].as_py() for c in ("_block", "feature", "repeat"))
        part = part.sort_by([("code", "ascending"), ("label", "ascending")])
        codes, label, n = unpacked(part.column("code").combine_chunks(), width), part.column("label").to_numpy(), part.column("n").to_numpy()
        rng = np.random.default_rng([seed, block, k, repeat])
        left = np.bincount(codes[:, k], n, BINS).astype(np.int64)
        order, taken = rng.permutation(len(n)), np.zeros((len(n), BINS), np.int64)
        for i in order:
            taken[i] = rng.multivariate_hypergeometric(left, n[i], method="marginals")
            left -= taken[i]
        at, bins = np.nonzero(taken)
        new = codes[at].copy()
        new[:, k] = bins
        score, where = np.unique(forest.scores(new), return_inverse=True)
        p, q = (np.bincount(where, taken[at, bins] * (label[at] == y), len(score)).astype(np.int64) for y in (1, 0))
        return pa.table({"feature": pa.array(np.full(len(score), k), pa.int32()), "repeat": pa.array(np.full(len(score), repeat), pa.int32()), "score": score, "p": p, "q": q})

    return t.groupBy("_block", "feature", "repeat").applyInArrow(permute, "feature int, repeat int, score double, p long, q long")


def scored_counts(rows: DataFrame, width: int, forest: Forest) -> DataFrame:
    """score, p, q of folded() rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n, one = b.column("n"), b.column("label").to_numpy() == 1
                yield pa.RecordBatch.from_pydict({"score": pa.array(forest.scores(unpacked(b.column("code"), width))), "p": pa.array(np.where(one, n, 0), pa.int64()), "q": pa.array(np.where(one, 0, n), pa.int64())})

    return rows.mapInArrow(run, "score double, p long, q long")
