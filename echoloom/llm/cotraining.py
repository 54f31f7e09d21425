"""Quality classifier by co-training.

Two views of a document train two logistic classifiers: its text content (word and character statistics) and its page
metadata (language, source, size and line layout). Over rounds each labels the unlabelled documents it is most sure of
for the other; then both are calibrated on held-out labels and combined, and every document is scored.

Everything covers all rows: all labelled rows train (a fifth, by hash, is held out for calibration), and every other
document is in the pool. Nothing but sums reaches the driver: a Newton step of a fit is one aggregation of gradients and
Hessians, in NumPy within tasks, over a narrow table of features. Pseudo-labels are never stored, as they follow from
the views of the rounds before; together they weigh at most as much as the labels.

Defined results: a null, empty or wordless text scores 0 and is rejected, and trains nothing; null metadata is a value of
its own; without both labels among labelled documents nothing can be learned and every other document scores 1 and is
kept; a doc_id labelled more than once counts with its least label, a label of null counts as none; repeated rows score
alike; an empty table gives no row; a very long text is one row of features, made in linear time. Further columns are
carried, not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, discard, materialize, packed, small, unpacked, words
from .spot_signatures import ANCHORS

#: Confidence from which a view labels a document for the other, a round each.
ROUNDS = (0.99, 0.97, 0.95)
THRESHOLD = 0.5
SOURCE_BUCKETS = 8
LANGUAGES = ("en", "de", "fr", "es")
#: Newton steps of a fit from nothing and of one that goes on from the round before.
FIRST_STEPS = 16
NEXT_STEPS = 4
PENALTY = 1.0
#: Parts of a Newton step whose losses are measured with it.
STEPS = (1.0, 0.5, 0.25, 0.1, 0.03)

TEXT_FEATURES = ("common", "word_length", "distinct", "stutter", "upper", "symbol", "shout", "digit", "bar", "stop", "letter")
PAGE_FEATURES = ("log_chars", "log_lines", "log_line", "repeated_lines", "short_lines", "ended_lines", *(f"lang_{x}" for x in LANGUAGES), *(f"source_{k}" for k in range(SOURCE_BUCKETS)))
WIDE = len(TEXT_FEATURES)
WIDTH = WIDE + len(PAGE_FEATURES)
#: Roles of a row in training.
TRAIN, HELD, POOL, NONE = 0, 1, 2, 3


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def with_views(docs: DataFrame) -> DataFrame:
    """docs with _n_words and the two feature arrays _text and _page; narrow, linear in the text."""
    t = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    t = t.withColumns({"_w": words(F.col("_t")), "_lines": F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")), "_n": F.char_length("_t")})
    n_words, n, lines = F.size("_w"), F.col("_n"), F.size("_lines")

    def count(pattern: str) -> Column:
        return n - F.char_length(F.regexp_replace("_t", pattern, ""))

    t = t.withColumns({"_upper": count(r"\p{Lu}+"), "_letter": count(r"\p{L}+"), "_plain": F.split(F.lower("_t"), f"[{SPACE}.,;:!?()\"']+")})
    text = [
        _share(F.size(F.filter("_plain", lambda x: x.isin(ANCHORS))), n_words),
        _share(n - F.char_length(F.regexp_replace("_t", f"[^{SPACE}]+", "")), n_words),
        _share(F.size(F.array_distinct("_w")), n_words),
        _share(F.size(F.filter("_w", lambda x, i: x == F.get("_w", i + 1))), n_words),
        _share(F.col("_upper"), F.col("_letter")),
        _share(count("[#*$%&<>]+"), n),
        _share(count("!+"), n),
        _share(count("[0-9]+"), n),
        _share(count("[|]+"), n),
        _share(count("[.,;:?]+"), n),
        _share(F.col("_letter"), n),
    ]
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    bucket = F.pmod(F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit(""))), F.lit(SOURCE_BUCKETS)) if "source" in docs.columns else F.lit(0)
    page = [
        F.log1p(n), F.log1p(lines), F.log1p(n / F.greatest(lines, F.lit(1))),
        _share(lines - F.size(F.array_distinct("_lines")), lines),
        _share(F.size(F.filter("_lines", lambda x: F.char_length(x) < 20)), lines),
        _share(F.size(F.filter("_lines", lambda x: F.rtrim(x).rlike(r"[.!?\"]$"))), lines),
        *[(lang == x).cast("double") for x in LANGUAGES],
        *[(bucket == k).cast("double") for k in range(SOURCE_BUCKETS)],
    ]
    return t.withColumns({"_n_words": n_words, "_text": F.array(*[x.cast("double") for x in text]), "_page": F.array(*[x.cast("double") for x in page])}).drop("_t", "_w", "_lines", "_n", "_upper", "_letter", "_plain")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class View:
    """A logistic classifier over standardised features and their squares."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # bias, then features, then squares

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, z * z])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights


@dataclass(frozen=True)
class CoTrained:
    text: View
    page: View
    combine: np.ndarray  # bias, weight of the text logit, weight of the page logit

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the text view, the page view and both."""
        a, b = self.text.logit(x[:, :WIDE]), self.page.logit(x[:, WIDE:])
        return sigmoid(a), sigmoid(b), sigmoid(self.combine[0] + self.combine[1] * a + self.combine[2] * b)


def pseudo_labels(x: np.ndarray, rounds: list[tuple[View, View, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Labels that rows of the pool got over the rounds for the text and the page view; nan where none was given.

    A row leaves the pool in the first round in which either view is sure of it.
    """
    for_text, for_page = np.full(len(x), np.nan), np.full(len(x), np.nan)
    free = np.ones(len(x), bool)
    for text, page, confidence in rounds:
        given = np.zeros(len(x), bool)
        for view, part, out in ((text, x[:, :WIDE], for_page), (page, x[:, WIDE:], for_text)):
            p = sigmoid(view.logit(part))
            sure = free & (np.maximum(p, 1 - p) >= confidence)
            out[sure] = p[sure] > 0.5
            given |= sure
        free &= ~given
    return for_text, for_page


def newton_sums(d: np.ndarray, y: np.ndarray, w: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the logistic loss at w over rows of a design matrix, the loss at w and at the shorter STEPS
    from origin to w, and the count of rows, in one vector."""
    to, start = d @ w, d @ origin
    p = sigmoid(to)
    losses = []
    for t in STEPS:
        z = start + t * (to - start)
        losses.append(float((np.logaddexp(0, z) - y * z).sum()))
    return np.concatenate([d.T @ (p - y), ((d * (p * (1 - p))[:, None]).T @ d).ravel(), losses, [len(y)]])


def sums_size(k: int) -> int:
    return k + k * k + len(STEPS) + 1


class Newton:
    """Penalised Newton steps towards the least loss; one that raises it is cut to the best of STEPS. The bias, in the first
    place, isn't penalised."""

    def __init__(self, weights: np.ndarray, penalty: float = PENALTY):
        self.best = self.at = weights
        self.loss = np.inf
        self.ridge = np.full(len(weights), penalty)
        self.ridge[0] = 1e-6

    def take(self, sums: np.ndarray) -> None:
        """Move on, given newton_sums() at the place `at` from `best`."""
        k = len(self.at)
        places = [self.best + t * (self.at - self.best) for t in STEPS]
        losses = [loss + 0.5 * float(self.ridge @ (w * w)) for loss, w in zip(sums[k + k * k : -1], places, strict=True)]
        if losses[0] <= self.loss:
            self.best, self.loss = self.at, losses[0]
            self.at = self.at - np.linalg.solve(sums[k : k + k * k].reshape(k, k) + np.diag(self.ridge), sums[:k] + self.ridge * self.at)
        else:
            self.at = places[1 + int(np.argmin(losses[1:]))]

    def done(self) -> bool:
        return float(np.abs(self.at - self.best).max()) < 1e-4


def _matrix(p: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(p.column("x").to_pylist()), np.float64).reshape(p.num_rows, WIDTH)


def summed(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of a vector over all batches of rows: tasks add their own, Spark the tasks'; the driver gets `size` numbers."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for p in parts:
            if p.num_rows:
                total += of(p)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "value"])

    out = np.zeros(size)
    for r in rows.mapInArrow(batches, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    # sums of doubles depend on their order in the last digits; fits shouldn't
    return np.round(out, 9)


def features(docs: DataFrame, *carried: str) -> DataFrame:
    """The carried columns, n_words and x (the features of both views as bytes) of every document; narrow."""
    kinds = dict(docs.dtypes)
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried if c in kinds]
    t = with_views(docs).select(*[c for c in carried if c in kinds], F.col("_n_words").cast("long").alias("n_words"), F.concat("_text", "_page").alias("x"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            x = p.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            offsets = pa.array(np.arange(p.num_rows + 1, dtype=np.int32) * (8 * WIDTH))
            packed_x = pa.Array.from_buffers(pa.binary(), p.num_rows, [None, offsets.buffers()[1], pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([*(p.column(c) for c in p.schema.names if c != "x"), packed_x], names=p.schema.names)

    return t.mapInArrow(batches, ", ".join([*fields, "n_words long", "x binary"]))


def with_roles(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, x) -> (x, y, role): labelled rows train or, a fifth of doc_ids by hash, are held out; the rest are the pool."""
    one = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.min("quality") > 0).cast("double").alias("y"))
    one = small(materialize(one, "quality-labels"), 1_000_000)
    role = F.when(F.col("n_words") == 0, NONE).when(F.col("y").isNull(), POOL).when(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 4, HELD).otherwise(TRAIN)
    return found.select("doc_id", "n_words", "x").join(one, "doc_id", "left").select("x", "y", role.alias("role"))


def train(found: DataFrame, labels: DataFrame, rounds: tuple[float, ...] = ROUNDS) -> CoTrained | None:
    """A model from rows of features(), or None where the labelled documents lack one of the two labels."""
    rows = materialize(with_roles(found, labels), "quality-roles")
    counts = {(r["role"], r["y"]): r["count"] for r in rows.where(F.col("role") < POOL).groupBy("role", "y").count().collect()}
    both = {role for role in (TRAIN, HELD) if (role, 0.0) in counts and (role, 1.0) in counts}
    if not {0.0, 1.0} <= {y for _, y in counts}:
        discard(rows)
        return None
    # too few labels to hold any out: all of them train and calibrate
    train_roles, held_roles = ([TRAIN], [HELD]) if both == {TRAIN, HELD} else ([TRAIN, HELD], [TRAIN, HELD])
    labelled, held = rows.where(F.col("role").isin(train_roles)), rows.where(F.col("role").isin(held_roles))

    def moments(p: pa.RecordBatch) -> np.ndarray:
        x = _matrix(p)
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    m = summed(labelled, moments, 1 + 2 * WIDTH)
    mean = m[1 : 1 + WIDTH] / m[0]
    scale = np.sqrt(np.maximum(m[1 + WIDTH :] / m[0] - mean * mean, 0))
    scale = np.where(scale < 1e-6, 1.0, scale)
    parts = (slice(0, WIDE), slice(WIDE, WIDTH))
    views = [View(mean[k], scale[k], np.zeros(1 + 2 * (k.stop - k.start))) for k in parts]
    sizes = [sums_size(len(v.weights)) for v in views]

    def fit(views: list[View], seen: list[tuple[View, View, float]], steps: int) -> list[View]:
        going = [Newton(v.weights) for v in views]
        for _ in range(steps):

            def sums(p: pa.RecordBatch, views: list[View] = views, origins: list[np.ndarray] = [x.best for x in going]) -> np.ndarray:
                """For both views, the sums over labelled rows, then those over pseudo-labelled rows."""
                x, role = _matrix(p), p.column("role").to_numpy()
                y = p.column("y").to_numpy(zero_copy_only=False).astype(float)
                known = np.isin(role, train_roles)
                out = [newton_sums(v.design(x[known][:, k]), y[known], v.weights, o) for v, k, o in zip(views, parts, origins, strict=True)]
                free = x[role == POOL]
                given = pseudo_labels(free, seen) if seen else (np.zeros(0), np.zeros(0))
                for v, k, o, z in zip(views, parts, origins, given, strict=True):
                    some = np.flatnonzero(~np.isnan(z))
                    out.append(newton_sums(v.design(free[some][:, k]), z[some], v.weights, o))
                return np.concatenate(out)

            total = summed(rows.where(F.col("role").isin([*train_roles, POOL])) if seen else labelled, sums, 2 * sum(sizes))
            pieces = np.split(total, np.cumsum([*sizes, *sizes])[:-1])
            for fitted, known, given in zip(going, pieces[:2], pieces[2:], strict=True):
                share = min(1.0, known[-1] / given[-1]) if given[-1] else 0.0
                fitted.take(known + share * given)
            views = [View(v.mean, v.scale, x.at) for v, x in zip(views, going, strict=True)]
            if all(x.done() for x in going):
                break
        return [View(v.mean, v.scale, x.best) for v, x in zip(views, going, strict=True)]

    views = fit(views, [], FIRST_STEPS)
    seen: list[tuple[View, View, float]] = []
    for confidence in rounds:
        seen.append((views[0], views[1], confidence))
        views = fit(views, seen, NEXT_STEPS)

    def combined(which: list[int]) -> np.ndarray:
        going = Newton(np.zeros(len(which)), penalty=0.1)
        for _ in range(10):

            def sums(p: pa.RecordBatch, w: np.ndarray = going.at, origin: np.ndarray = going.best) -> np.ndarray:
                x = _matrix(p)
                d = np.column_stack([np.ones(len(x)), *[np.clip(v.logit(x[:, k]), -10, 10) for v, k in zip(views, parts, strict=True)]])
                return newton_sums(d[:, which], p.column("y").to_numpy(zero_copy_only=False).astype(float), w, origin)

            going.take(summed(held, sums, sums_size(len(which))))
            if going.done():
                break
        return going.best

    weights = combined([0, 1, 2])
    # a view that speaks against the other on held-out labels has no say
    if min(weights[1:]) < 0:
        best = 1 + int(weights[2] > weights[1])
        single = combined([0, best])
        weights = np.zeros(3)
        weights[[0, best]] = single
    discard(rows)
    return CoTrained(views[0], views[1], weights)


def scored(found: DataFrame, model: CoTrained | None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of features() with text_score, page_score, score and kept instead of n_words and x; a narrow pass."""
    carried = [f for f in found.schema.fields if f.name not in ("n_words", "x")]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            some = p.column("n_words").to_numpy() > 0
            made = model.scores(_matrix(p)) if model is not None else (np.ones(p.num_rows),) * 3
            made = [np.where(some, x, 0.0) for x in made]
            yield pa.RecordBatch.from_arrays([*(p.column(f.name) for f in carried), *map(pa.array, made), pa.array(some & (made[2] >= threshold))], names=[*(f.name for f in carried), "text_score", "page_score", "score", "kept"])

    return found.mapInArrow(batches, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried), "text_score double", "page_score double", "score double", "kept boolean"]))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, text_score, page_score, score, kept of every document."""
    plain = docs.select(*[c for c in ("doc_id", "text", "lang", "source") if c in docs.columns])
    found = materialize(features(plain, "doc_id"), "quality-features")
    return scored(found, train(found, labels, **options))


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of documents that the classifier keeps, with their own columns.

    The texts are read twice, once for the features of training and once to keep rows; verdicts go back by a row's doc_id
    and text hash, and only those of rejected texts are sent.
    """
    plain = docs.select(*[c for c in ("doc_id", "text", "lang", "source") if c in docs.columns])
    extra = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("") for c in ("lang", "source")]
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), *extra)
    found = materialize(features(plain.withColumn("row_key", key), "doc_id", "row_key"), "quality-features")
    gone = scored(found, train(found, labels, **options)).where(~F.col("kept")).select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_gone")).distinct()
    gone = small(materialize(gone, "quality-rejected"), 1_000_000)
    rows = packed(docs, "doc_id", "text", "lang", "source").withColumn("_key", key)
    kept = rows.join(gone, rows["doc_id"].eqNullSafe(gone["_doc"]) & (rows["_key"] == gone["_gone"]), "left_anti")
    return unpacked(kept, docs.columns)
