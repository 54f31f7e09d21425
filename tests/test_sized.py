"""Steps whose work must follow the rows: each test fails where a group meets in one window, task or driver."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echoloom.operators import stability as S
from echoloom.operators.chosen import first_rows


def test_balanced_repeats_choose_by_hash_cells(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(str(k), f, int(k % 3 == 0), None if f == "b" and k % 5 == 0 else float(rng.integers(0, 40))) for k in range(300) for f in "ab"]
    t = spark.createDataFrame(rows, "key string, feature string, side int, value double")
    chosen = []
    monkeypatch.setattr(S, "first_rows", lambda df, *a: chosen.append(a[0]) or first_rows(df, *a))
    got = {r["feature"]: (r["auc"], r["auc_std"]) for r in S.balanced_repeats(t.withColumn("h", S.repeat_hashes("key", 2)), "key", 2, hashes="h").collect()}
    assert chosen == [["feature", "side", "repeat", "_cap"]]
    plain = {r["feature"]: (r["auc"], r["auc_std"]) for r in S.balanced_repeats(t, "key", 2).collect()}
    for f in "ab":
        aucs = []
        for r in range(2):
            sides = [sorted((hashlib.md5(f"{k}|{r}|42".encode()).hexdigest(), v) for k, g, s, v in rows if g == f and s == side and v is not None) for side in (0, 1)]
            small = min(map(len, sides))
            a, b = (np.array([v for _, v in s[:small]]) for s in sides)
            aucs.append(((b[:, None] > a[None]) + 0.5 * (b[:, None] == a[None])).mean())
        assert got[f] == pytest.approx((np.mean(aucs), np.std(aucs))) and plain[f] == pytest.approx(got[f])


def test_partitions_of_ranges_follow_the_data(spark, tmp_path, monkeypatch):
    """Short ranges make no partitions of their own, and of many files tasks read the headers."""
    from echoloom.sources import decode as D
    from echoloom.sources import ranges as R

    waves = {k: np.arange(1000.0) + 1000 * k for k in range(12)}
    for k, x in waves.items():
        (tmp_path / f"r{k}.npz").write_bytes(D.encode_npz(x, 1e3, compressed=k % 3 == 0))
    said = lambda t: sorted((r["path"].rsplit("/", 1)[-1], r["first"], r["last"], r["lead"], tuple(r["signal"])) for r in t.collect())
    ranges = lambda: R.read_ranges(spark, str(tmp_path), range_values=10, before=2, after=3)
    want = said(ranges())
    assert len(want) == 1200 and sum(b - a for _, a, b, *_ in want) == 12_000
    assert ranges().rdd.getNumPartitions() <= R.PARTITIONS + len(waves)
    reader = R._Reader({"path": str(tmp_path), "range_values": 10, "before": 2, "after": 3})
    monkeypatch.setattr(R, "PLANNED_FILES", 3)
    monkeypatch.setattr(R, "read_header", lambda *a: pytest.fail("a small file's header was read by the planner"))
    planned = reader.partitions()
    monkeypatch.undo()
    assert sorted(f for s in planned for f in s.files) == sorted(f"{tmp_path}/r{k}.npz" for k in waves)
    got = [r for s in planned for b in reader.read(s) for r in b.to_pylist()]
    assert sorted((r["path"].rsplit("/", 1)[-1], r["first"], r["last"], r["lead"], tuple(r["signal"])) for r in got) == want


def test_sessions_of_a_finished_stream_are_files(spark, sf, monkeypatch):
    """The result is written by tasks: no table in the driver's memory, and all files in one batch."""
    from echoloom.plans import signals
    from echoloom.streaming import windows as ST

    monkeypatch.setattr(ST, "run_once", lambda *a: pytest.fail("the result went through the driver"))
    t = signals.stream_sessions(spark, sf)
    assert t.inputFiles() and t.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_a_key_has_one_timer_a_batch():
    from types import SimpleNamespace

    from echoloom.streaming.stateful import Windows

    timers, held = [], []
    w = Windows("k", "ts", "n", "v", 2, 1, 10_000, 10**9)
    w.handle = SimpleNamespace(registerTimer=timers.append)
    w.waiting = SimpleNamespace(appendList=held.extend)
    s = np.array([95, 31, 12, 47, 88])
    f = pd.DataFrame({"ts": pd.to_datetime(s, unit="s"), "n": range(5), "v": 1.0})
    list(w.handleInputRows(("a",), iter([f[:2], f[2:]]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    assert len(held) == 5 and timers == [20_000]


def test_nearest_rows_hold_bounded_arrays(spark, monkeypatch):
    """Arrays of a task stay within CHUNK numbers for any pivots and classes, and cells are passed over by their boxes."""
    from echoloom.ml import nearest as N

    rng = np.random.default_rng(2)
    f = pd.DataFrame({"visitor": range(900)})
    visitors = pd.DataFrame({"id": f["visitor"], "label": rng.choice(["a", "b"], 900), "x": list(rng.normal(size=(900, 3)))})
    residents = visitors.rename(columns={c: f"r_{c}" for c in ("id", "label", "x")})
    want = N._least(visitors, residents)
    sizes, real = [], N._apart
    monkeypatch.setattr(N, "_apart", lambda a, b: sizes.append(len(a) * len(b)) or real(a, b))
    monkeypatch.setattr(N, "CHUNK", 9_000)
    got = N._least(visitors, residents)
    assert max(sizes) <= 9_000 and got.equals(want)


def test_binned_information_shuffles_counts_only(spark):
    from echoloom.operators import discrimination as D

    t = spark.range(2000).selectExpr("concat('f', id % 2) AS feature", "cast(id % 3 = 0 AS int) AS side", "cast(id % 97 AS double) AS value")
    plan = D.binned_mutual_information(t, ["feature"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_group_draw_orders_few_groups(spark, monkeypatch):
    from echoloom.operators import splits as SP

    t = spark.range(6000).selectExpr("id % 2 AS label", "id DIV 3 AS g", "id")
    seen = []
    monkeypatch.setattr(SP, "first_rows", lambda df, *a: seen.append(df.count()) or first_rows(df, *a))
    got = SP.group_draw(t, "label", "g", 50)
    order = lambda g: hashlib.md5(f"{g}|42".encode()).hexdigest()
    for label in (0, 1):
        mine = {}
        for i in range(6000):
            if i % 2 == label:
                mine[i // 3] = mine.get(i // 3, 0) + 1
        want, n = set(), 0
        for g in sorted(mine, key=order):
            if n >= 50:
                break
            want.add(g)
            n += mine[g]
        assert {r["g"] for r in got.where(F.col("label") == label).select("g").distinct().collect()} == want
    assert seen

def test_a_sweep_brings_frames_together_once(spark):
    """All configurations see a window's frames in one pass, and grids are made once for the same channels."""
    from echoloom.kernels import arrays as A
    from echoloom.operators import localize as LO

    at = np.arange(11.0)
    delay = (np.hypot(at - 4, 3) - 3) / 1500
    u = (np.arange(128)[:, None] / 4000 - 0.016 - delay) * 600
    rows = [(w, k, (a * x).tolist()) for w, a in ((1, 1.0), (2, 0.5)) for k, x in enumerate((1 - 2 * u * u) * np.exp(-u * u))]
    t = spark.createDataFrame([*rows, (3, 0, [1.0, 2.0])], "window int, frame int, channels array<double>").repartition(4)
    base = dict(max_tau=0.02, least_psr=3.0, z_bounds=(0.5, 20.0))
    configs = {"a": LO.LocateConfig(**base), "b": LO.LocateConfig(method="ncc", use_ransac=False, **base)}
    got = LO.sweep(t, "window", "frame", "channels", 4000.0, configs)
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = {(r["config"], r["window"]): r for r in got.collect()}
    assert len(found) == 6 and found["a", 3]["status"] == "rejected" and found["a", 3]["reason"] == "too_little_data"
    assert all(abs(found[c, w]["source_x"] - 4) < 0.3 for c in configs for w in (1, 2))
    A._grid.cache_clear()
    for _ in range(3):
        A.consensus(at, delay, 4.0, 1500.0, (0.0, 10.0), (0.5, 20.0), 20, 8e-4, 97)
    assert A._grid.cache_info().misses == 1

def test_rows_brought_together_are_found_by_their_own_tasks(spark):
    """one partition of few rows doesn't make one task of the scan that finds them."""
    from echoloom.ml import models

    t = spark.range(0, 80, 1, 8).withColumn("read_by", F.spark_partition_id()).where("id % 10 = 3")
    got = models.together(t, "id")
    assert got.rdd.getNumPartitions() == 1
    assert [r["read_by"] for r in got.collect()] == list(range(8))

def test_invariants_hold_few_records_at_a_time(spark, sf, monkeypatch):
    """a batch of any size is transformed in blocks."""
    from echoloom.plans import signals

    sizes = spark.sparkContext.accumulator(0)
    plain = signals.spectra.stft

    class Watched:
        @staticmethod
        def stft(x, *a):
            if len(x) > 7:
                sizes.add(1)
            return plain(x, *a)

        def __getattr__(self, name):
            from echoloom.kernels import spectra

            return getattr(spectra, name)

    monkeypatch.setattr(signals, "INVARIANT_RECORDS", 7, raising=False)
    monkeypatch.setattr(signals, "spectra", Watched())
    t = signals.signal_invariants(spark, sf)
    assert t.where("round_trip and rows_apart and fast_is_scaled").count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert sizes.value == 0

def test_bootstrap_rounds_repeat_no_row_alone(spark, monkeypatch):
    """rounds share rows by blocks, and ranks are those of weights drawn row by row and round by round."""
    from echoloom.operators import selection as SL
    from echoloom.operators import splits as SP

    rng = np.random.default_rng(4)
    rows = [(f"{k}", f, int(k % 3 == 0), float(rng.integers(0, 9) + (k % 3 == 0) * s)) for k in range(120) for f, s in (("a", 0.5), ("b", 2.0), ("c", 0.0))]
    t = spark.createDataFrame(rows, "key string, feature string, side int, value double")
    drawn = SP.bootstrap_weights(t, "key", 6).toPandas()
    lift = {}
    for (r, f), g in drawn.groupby(["round", "feature"]):
        x, y = g[g["side"] == 1], g[g["side"] == 0]
        wins = (x["value"].to_numpy()[:, None] > y["value"].to_numpy()) + 0.5 * (x["value"].to_numpy()[:, None] == y["value"].to_numpy())
        w = x["weight"].to_numpy()[:, None] * y["weight"].to_numpy()
        lift.setdefault(r, []).append((-abs((wins * w).sum() / w.sum() - 0.5), f))
    ranks = {f: [sorted(v).index(next(x for x in v if x[1] == f)) + 1 for v in lift.values()] for f in "abc"}
    monkeypatch.setattr(SP, "bootstrap_weights", lambda *a: pytest.fail("a row was repeated for every round"))
    got = {r["feature"]: r for r in SL.bootstrap_stability(t, "key", 6, 1).collect()}
    assert len(lift) == 6
    for f in "abc":
        assert got[f]["mean_rank"] == pytest.approx(np.mean(ranks[f])) and got[f]["std_rank"] == pytest.approx(np.std(ranks[f]))

def test_first_rows_by_hash_take_one_pass(spark, monkeypatch):
    """the rows below a bound of the hash are enough; where they aren't, the exact passes follow. Both give the same."""
    rows = [(None if k % 3 == 0 else "ab"[k % 3 - 1], k, float(k)) for k in range(6000)]
    t = spark.createDataFrame(rows, "g string, k int, v double")
    said = lambda d: sorted((r["g"] or "", r["round"], r["place"], r["k"]) for r in d.collect())
    monkeypatch.setattr(S, "first_rows", lambda *a: pytest.fail("all rows were ordered by cells"))
    once = said(S.first_by_hash(t, "g", ["k"], 50, 2))
    assert len(said(S.first_by_hash(t.where("k < 90"), "g", ["k"], 50, 2))) == 2 * 90
    monkeypatch.setattr(S, "first_rows", first_rows)
    monkeypatch.setattr(S, "SPARE", -3.0)
    assert said(S.first_by_hash(t, "g", ["k"], 50, 2)) == once
    for g in (None, "a", "b"):
        for r in range(2):
            want = sorted((hashlib.md5(f"{k}|{r}|42".encode()).hexdigest(), k) for h, k, _ in rows if h == g)[:50]
            assert [k for a, b, _, k in once if (a or None) == g and b == r] == [k for _, k in want]

def test_stages_take_their_sums_from_one_pass(spark, monkeypatch):
    """mutual information and domain distances of counted values equal those of all rows."""
    from echoloom.operators import discrimination as D
    from echoloom.operators import selection as SL

    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(2)), "xyz"[int(rng.integers(3))], float(rng.integers(12)), None if k % 9 == 0 else float(rng.normal())) for k in range(400)]
    t = spark.createDataFrame(rows, "y int, d string, a double, b double")
    counts = SL._value_counts(t, ["a", "b"], "y", "d")
    long = SL.Q.long_features(t.withColumn("side", F.col("y")), ["side", "d"], ["a", "b"])
    row = lambda df: {r["feature"]: tuple(r[1:]) for r in df.collect()}
    for got, want in (
        (SL._missing_and_variance(counts, ["feature"]), long.groupBy("feature").agg(F.avg(F.col("value").isNull().cast("double")), F.var_pop("value"))),
        (S.neighbour_information_table(counts, ["feature"], weight="_n"), S.neighbour_information_table(long, ["feature"])),
        (D.domain_stability(counts, ["feature"], "d", weight="_n"), D.domain_stability(long, ["feature"], "d")),
    ):
        got, want = row(got), row(want)
        assert set(got) == {"a", "b"} and all(got[f] == pytest.approx(want[f]) for f in got)


def test_rank_areas_leave_a_row_a_partition_and_group(spark, monkeypatch):
    """Areas come from sums of pairs of each partition; no table of all scanned values is written."""
    from echoloom.operators import discrimination as D
    from echoloom.operators import ordered as O

    rng = np.random.default_rng(4)
    f = pd.DataFrame({"g": rng.choice(["a", "b"], 4000), "side": rng.integers(0, 2, 4000), "value": rng.integers(0, 900, 4000) / 8.0})
    written, plain = {}, O.materialize
    monkeypatch.setattr(O, "materialize", lambda df, name: written.setdefault(name, plain(df, name)))
    for by, groups in ((["g"], f.groupby("g")), ([], [((), f)])):
        written.clear()
        got = {tuple(r[c] for c in by): r for r in D.rank_auc(spark.createDataFrame(f), by).collect()}
        for name, part in groups:
            a, b = (part.loc[part["side"] == s, "value"].to_numpy() for s in (1, 0))
            want = ((a[:, None] > b[None]) + 0.5 * (a[:, None] == b[None])).mean()
            r = got[(name,) if by else ()]
            assert r["auc"] == pytest.approx(want, abs=1e-12) and (r["n_pos"], r["n_neg"]) == (len(a), len(b))
        assert "ordered-scanned" not in written
        assert written["paired-parts"].count() <= int(spark.conf.get("spark.sql.shuffle.partitions")) + 2


def test_separation_comes_from_moments(spark):
    from echoloom.ml import subset as SB

    rng = np.random.default_rng(12)
    f = pd.DataFrame(rng.normal(size=(900, 2)), columns=list("ab")).assign(y=rng.integers(0, 2, 900))
    f["a"] += f["y"]
    t, moments = SB.prepared(spark.createDataFrame(f), "y", ["a", "b"])
    fits = {k: SB.discriminant(moments, [0, 1], k) for k in range(5)}
    rows = t.toPandas()
    s = np.array([r[["a", "b"]].to_numpy(float) @ fits[int(r["_fold"])][0] - fits[int(r["_fold"])][1] for _, r in rows.iterrows()])
    one, other = s[rows["y"] == 1], s[rows["y"] == 0]
    want = abs(one.mean() - other.mean()) / np.sqrt((one.var() + other.var()) / 2)
    assert SB.separation(moments, [0, 1], fits) == pytest.approx(want)


def test_elimination_orders_no_scores(spark, monkeypatch):
    from echoloom.ml import models as ML
    from echoloom.operators import metrics as M

    rng = np.random.default_rng(1)
    f = pd.DataFrame(rng.normal(size=(200, 2)), columns=list("ab")).assign(g=np.arange(200))
    f["label"] = (f["a"] > 0).astype(int)
    monkeypatch.setattr(M, "rank_auc", lambda *a: pytest.fail("an area was made"))
    rows = ML.eliminate(spark.createDataFrame(f), ["a", "b"], "g", 2, 2)
    assert [r["n"] for r in rows] == [2] and rows[0]["dropped"] == "b" and rows[0]["f1"] > 0.9


@pytest.mark.parametrize("block", [7, 40, 100_000])
def test_neighbour_information_of_pieces_is_that_of_the_whole(spark, monkeypatch, block):
    """pieces of a sorted column with a class far rarer than they are many, and ties; no row is looked up by a join of all values."""
    rng = np.random.default_rng(12)
    n = 900
    y = rng.choice([0, 1, 2], n, p=[0.6, 0.39, 0.01])
    x = rng.normal(size=n) + 0.3 * y
    t = spark.createDataFrame(pd.DataFrame({"feature": "plain", "side": y, "value": x}))
    monkeypatch.setattr(S, "running", lambda *a, **k: pytest.fail("all values were scanned and joined"))
    got = S.neighbour_information_table(t, ["feature"], block=block).first()["mi_knn"]
    assert got == pytest.approx(S.neighbour_information(x, y), abs=1e-9)
    ties = pd.DataFrame({"feature": "ties", "side": np.r_[y, 7], "value": np.r_[np.round(x, 2), 0.5]})
    both = [S.neighbour_information_table(spark.createDataFrame(ties), ["feature"], block=b).first()["mi_knn"] for b in (block, 100_000)]
    assert both[0] == pytest.approx(both[1], abs=1e-12)


def test_weights_of_all_rounds_are_those_of_the_hash(spark):
    """200 rounds by one pass; weights made in a task equal those that Spark's expressions give."""
    from echoloom.operators import selection as SL
    from echoloom.operators import splits as SP

    t = spark.range(300).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    h = t.select("key", F.xxhash64("key").alias("h")).toPandas()
    got = SP.poisson_weights(h["h"].to_numpy(), 200)
    want = SP.bootstrap_weights(t, "key", 200).toPandas().pivot_table(index="key", columns="round", values="weight", fill_value=0).reindex(h["key"], fill_value=0)
    assert got.shape == (300, 200) and (got == want.to_numpy()).all()


def test_bootstrap_query_draws_every_round(spark, sf, monkeypatch):
    from echoloom.operators import selection as SL
    from echoloom.plans import stats

    rounds, plain = [], SL.bootstrap_stability
    monkeypatch.setattr(SL, "bootstrap_stability", lambda t, key, n, top: rounds.append(n) or plain(t, key, n, top))
    monkeypatch.setattr(SL, "ROWS_AT_ONCE", 100)
    got = stats.bootstrap_stability(spark, sf).toPandas()
    assert rounds == [200] and got["mean_rank"].sum() == pytest.approx(10.0) and got["top_frequency"].sum() == pytest.approx(2.0)
