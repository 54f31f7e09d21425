"""Choice by hash and places in order without a group in one window, and commits that survive a stop between their writes."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.operators import gates as G
from echoloom.operators.chosen import first_rows, marked_first
from echoloom.operators.ordered import ordinal
from echoloom.operators.stability import first_by_hash, mean_errors


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.mark.parametrize("digits", [4, 1])
def test_first_rows_by_hash(spark, monkeypatch, digits):
    from echoloom.operators import chosen

    monkeypatch.setattr(chosen, "DIGITS", digits)
    rng = np.random.default_rng(4)
    rows = [(g, int(k), int(k) % 7) for g, n in (("a", 900), ("b", 40), ("c", 1), (None, 60)) for k in rng.permutation(n)]
    t = spark.createDataFrame(rows, "g string, k long, other long").repartition(4)
    for take in (0, 1, 17, 60, 5000):
        got = defaultdict(set)
        for r in first_rows(t, ["g"], F.md5(F.col("k").cast("string")), ["k"], lambda n, take=take: F.lit(take)).collect():
            got[r["g"]].add(r["k"])
        for g in ("a", "b", "c", None):
            mine = sorted((k for h, k, _ in rows if h == g), key=lambda k: (md5(str(k)), k))
            assert got[g] == set(mine[:take])
    marked = marked_first(t, ["g"], F.md5(F.col("k").cast("string")), ["k"], lambda n: F.rint(n * 0.3)).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_taken").cast("int")).alias("k"))
    assert {r["g"]: (r["n"], r["k"]) for r in marked.collect()} == {"a": (900, 270), "b": (40, 12), "c": (1, 0), None: (60, 18)}
    assert first_rows(t.limit(0), ["g"], F.md5("g"), [], lambda n: F.lit(3)).count() == 0
    with pytest.raises(ValueError):
        first_rows(t, [], F.md5("g"), [], lambda n: F.lit(3))


def test_rows_of_one_key_are_counted_apart(spark):
    """Labels whose rows all share a key give as many rows as are asked for, in every round."""
    t = spark.range(20_000).select((F.col("id") % 4).cast("string").alias("label"), F.lit(1).alias("key"), F.col("id").cast("double").alias("x"))
    got = first_by_hash(t, "label", ["key"], 100, 3, ties=["x"]).groupBy("label", "round").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last")).collect()
    assert len(got) == 12 and {(r["n"], r["last"]) for r in got} == {(100, 100)}
    assert {r["label"] for r in mean_errors(t, "label", ["key"], ["x"], [10, 100], 2).collect()} == set("0123")


@pytest.mark.parametrize("by", [["g"], []])
def test_ordinals(spark, by):
    rng = np.random.default_rng(8)
    rows = [(g, int(v)) for g in ("a", "b", None) for v in rng.integers(0, 40, 200)]
    got = ordinal(spark.createDataFrame(rows, "g string, v long").repartition(5), by, ["v"]).collect()
    seen = defaultdict(list)
    for r in got:
        seen[r["g"] if by else 0].append((r["_ordinal"], r["v"]))
    for group in seen.values():
        group.sort()
        assert [k for k, _ in group] == list(range(len(group))) and [v for _, v in group] == sorted(v for _, v in group)


def files(spark, names):
    rows = spark.createDataFrame([(n, w, float(w)) for n in names for w in range(3)], "file string, window_id int, b__rms double")
    expected = spark.createDataFrame([(n, 3 if n != "bad" else 4) for n in names], "file string, n_expected long")
    return rows, G.completion_gate(rows, expected, ["b__rms"])


def held(spark, paths):
    got = G.read_gated(spark, paths[0], paths[1])
    return Counter(r["file"] for r in got.collect()) if got is not None else Counter()


def test_a_stopped_commit_is_repeated_without_doubles(spark, tmp_path, monkeypatch):
    paths = [str(tmp_path / n) for n in ("data", "ledger", "retry")]
    names = [f"f{k:02d}" for k in range(7)] + ["bad"]

    def stop(*_):
        raise RuntimeError("stopped between the writes")

    with monkeypatch.context() as m:
        m.setattr(G, "publish", stop)
        with pytest.raises(RuntimeError):
            G.write_gated(*files(spark, names), *paths, files_per_part=3)
    assert held(spark, paths) == {} and G.published(spark, paths[1]) is None
    # a smaller run that stops leaves parts of other names, which no ledger lists
    with monkeypatch.context() as m:
        m.setattr(G, "publish", stop)
        with pytest.raises(RuntimeError):
            G.write_gated(*files(spark, names[2:]), *paths, files_per_part=3)
    G.write_gated(*files(spark, names), *paths, files_per_part=3)
    assert held(spark, paths) == dict.fromkeys(names[:7], 3)
    # stopped after publishing, before the list of failures: nothing is written again
    G.write_gated(*files(spark, names), *paths, files_per_part=3)
    G.write_gated(*files(spark, names), *paths, files_per_part=3)
    assert held(spark, paths) == dict.fromkeys(names[:7], 3)
    # later files join without touching earlier parts
    G.write_gated(*files(spark, [*names, "g1", "g2"]), *paths, files_per_part=3)
    assert held(spark, paths) == dict.fromkeys([*names[:7], "g1", "g2"], 3)
    ledger = G.published(spark, paths[1])
    assert ledger.count() == 9 and ledger.select("run").distinct().count() == 2 and ledger.groupBy("part").count().agg(F.max("count")).first()[0] == 3
    assert {r["file"] for r in spark.read.parquet(paths[2]).collect()} == {"bad"}


def test_quantiles_of_groups_and_summaries(spark):
    from echoloom.operators import records as R
    from echoloom.operators.ordered import group_quantiles

    rng = np.random.default_rng(1)
    rows = [("ab"[k % 2], [float(v) for v in rng.normal(size=3)], float(rng.normal()), float(k % 5)) for k in range(101)] + [("c", [1.0, 2.0, 3.0], 4.0, None)]
    t = spark.createDataFrame(rows, "m string, c array<double>, p double, q double")
    for column, at in (("p", 2), ("q", 3)):
        for r in group_quantiles(t, ["m"], (0.0, 0.31, 0.5, 1.0), column).collect():
            v = [x[at] for x in rows if x[0] == r["m"] and x[at] is not None]
            assert r["n"] == len(v) and r["quantiles"] == pytest.approx(np.quantile(v, [0, 0.31, 0.5, 1]).tolist())
    for r in R.curve_summary(t, "m", "c", [0.1, 0.2, 0.3]).collect():
        v = np.array([x[1][[0.1, 0.2, 0.3].index(r["x"])] for x in rows if x[0] == r["m"]])
        assert [r["median"], r["p10"], r["p90"], r["mean"]] == pytest.approx([np.median(v), *np.quantile(v, [0.1, 0.9]), v.mean()])
    for r in R.method_summary(t.where("m < 'c'"), "m", ["p", "q"]).collect():
        v = np.array([x[2 if r["feature"] == "p" else 3] for x in rows if x[0] == r["m"]])
        assert [r["median"], r["mean"], r["std"], r["min"], r["max"]] == pytest.approx([np.median(v), v.mean(), v.std(ddof=1), v.min(), v.max()])
