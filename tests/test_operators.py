"""Operators whose results SQL doesn't give: sources, gates, engine, location, splits, models, streams."""

import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echoloom import features_engine as E
from echoloom.functions import labels as L
from echoloom.functions import signal as S
from echoloom.kernels import features as K
from echoloom.ml import models as ML
from echoloom.ml import subset as SB
from echoloom.operators import correlation as C
from echoloom.operators import gates as G
from echoloom.operators import localize as LO
from echoloom.operators import metrics as M
from echoloom.operators import mixtures as MX
from echoloom.operators import quality as Q
from echoloom.operators import records as R
from echoloom.operators import selection as SL
from echoloom.operators import splits as SP
from echoloom.operators import stability as STAB
from echoloom.operators import windows as WN
from echoloom.plans import signals
from echoloom.sources import decode as D
from echoloom.sources import files as FI
from echoloom.sources import tables as T
from echoloom.streaming import windows as ST

RATE = 64_000.0


def tdms(channels, properties):
    def text(s):
        b = s.encode()
        return struct.pack("<I", len(b)) + b

    def props(p):
        out = struct.pack("<I", len(p))
        for k, v in p.items():
            out += text(k) + (struct.pack("<I", 0x20) + text(v) if isinstance(v, str) else struct.pack("<Id", 10, v))
        return out

    meta = struct.pack("<I", 1 + len(channels)) + text("/") + struct.pack("<I", 0xFFFFFFFF) + props(properties)
    for name, x in channels.items():
        meta += text(f"/'g'/'{name}'") + struct.pack("<IIIQ", 20, 10, 1, len(x)) + props({})
    raw = b"".join(np.asarray(x, "<f8").tobytes() for x in channels.values())
    return b"TDSm" + struct.pack("<IIQQ", 2 | 4 | 8, 4713, len(meta) + len(raw), len(meta)) + meta + raw


def test_containers(spark, tmp_path):
    (tmp_path / "QJ").mkdir()
    x = np.sin(np.arange(300) / 5)
    (tmp_path / "QJ" / "a.npz").write_bytes(D.encode_npz(x, 1e6, starttime="20260101T000000.000", type="QJ00"))
    (tmp_path / "QJ" / "two.npz").write_bytes(D.encode_npz(np.column_stack([x, -x]), 5e5))
    (tmp_path / "QJ" / "broken.npz").write_bytes(b"nothing")
    np.savez(tmp_path / "QJ" / "pickled.npz", phase_data=x, sample_rate=1e3, data_info=np.array({"a": 1}, dtype=object))
    (tmp_path / "dev-4pt-1000Hz-1.bin").write_bytes(np.arange(12, dtype="<i4").tobytes())
    (tmp_path / "dev-5pt-1000Hz-2.bin").write_bytes(np.arange(12, dtype="<i4").tobytes())
    (tmp_path / "r_500k.tdms").write_bytes(tdms({"noise": x[:10], "phase": x}, {"type": "FL00"}))
    (tmp_path / "s.tdms").write_bytes(tdms({"long": x, "short": x[:5]}, {"wf_increment": 1e-4}))
    got = {}
    for p in ("*.npz", "*.bin", "*.tdms"):
        for r in D.decode(FI.discover(spark, str(tmp_path), p)).collect():
            got.setdefault(r["path"].rsplit("/", 1)[-1], []).append(r)
    assert np.allclose(got["a.npz"][0]["signal"], x) and got["a.npz"][0]["type"] == "QJ00" and got["a.npz"][0]["sample_rate"] == 1e6
    assert len(got["two.npz"]) == 2 and np.allclose(got["two.npz"][1]["signal"], -x) and got["two.npz"][0]["type"] == "QJ"
    assert got["broken.npz"][0]["status"] == "failed" and got["pickled.npz"][0]["status"] == "ok"
    assert len(got["dev-4pt-1000Hz-1.bin"]) == 4 and got["dev-4pt-1000Hz-1.bin"][1]["signal"][2] == pytest.approx(9 * math.pi / 32767)
    assert "multiple" in got["dev-5pt-1000Hz-2.bin"][0]["message"]
    with pytest.raises(ValueError, match="empty"):
        D.read_bin(b"", "dev-4pt-1000Hz-3.bin")
    assert got["r_500k.tdms"][0]["channel_name"] == "phase" and got["r_500k.tdms"][0]["sample_rate"] == 5e5 and np.allclose(got["r_500k.tdms"][0]["signal"], x)
    assert got["s.tdms"][0]["channel_name"] == "long" and got["s.tdms"][0]["sample_rate"] == pytest.approx(1e4)
    assert FI.discover(spark, str(tmp_path), "*.npz", 2).count() == 2
    named = {r["file_name"]: r for r in FI.with_names(FI.discover(spark, str(tmp_path), "*.bin")).collect()}
    assert named["dev-4pt-1000Hz-1.bin"]["name_points"] == 4 and named["dev-4pt-1000Hz-1.bin"]["name_rate"] == 1000


def test_feature_tables(spark, tmp_path):
    pd.DataFrame({"source_file_path": [f"/d/BK14_x_tr/f{i}.npz" for i in range(6)], "label": ["pos", "0", "1", "noise", "bk", "neg"], "f1": np.arange(6.0), "f2": [1.0] * 6}).to_csv(tmp_path / "features_1.csv", index=False, encoding="utf-8-sig")
    (tmp_path / "log_1.csv").write_text("a\n1\n")
    t = T.scan_csv(spark, str(tmp_path))
    assert t.columns[0] == "source_file_path" and t.count() == 6
    c = T.canonical(t)
    assert [r["label"] for r in c.orderBy("source_file_path").collect()] == [1, 0, 1, 0, 1, 0]
    assert {(r["split"], r["base_domain"]) for r in c.collect()} == {("train", "X")}
    assert Q.infer_features(t) == ["f1"]
    assert T.guarded(t)[1] == "skipped" and T.guarded(t, 1, 1)[1] == "ok"
    both = T.load_classes({"BK00": t, "FL05": t.drop("f2")}, per_label=4)
    assert both.count() == 8 and {r["signal_family"] for r in both.collect()} == {"BK", "FL"}
    assert T.load_report(t).first()["rows"] == 6


def test_gate_writes_complete_files_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, None), ("c", 0, float("inf"))], "file string, window_id int, b__rms double")
    expected = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1), ("d", 3)], "file string, n_expected long")
    gate = G.completion_gate(rows, expected, ["b__rms"])
    assert {r["file"]: r["errors"] for r in gate.collect()} == {"a": [], "b": ["missing_features:b__rms"], "c": ["invalid_values:b__rms"], "d": ["window_ids"]}
    paths = [str(tmp_path / n) for n in ("data", "ledger", "retry")]
    G.write_gated(rows, gate, *paths)
    assert spark.read.parquet(paths[0]).count() == 2
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    assert [r["path"] for r in G.unprocessed(files, spark.read.parquet(paths[1])).collect()] == ["b"]
    assert spark.read.parquet(paths[2]).count() == 3


def test_engine_rows_do_not_depend_on_partitions(spark, sf):
    r = signals.recordings(spark, sf)
    a = E.recording_features(r.repartition(1), {"b": (100.0, 20_000.0)}, RATE, 0.008, 0.5, families={"b": ("classic", "spectral")}).orderBy("path", "window_id").toPandas()
    b = E.recording_features(r.repartition(5), {"b": (100.0, 20_000.0)}, RATE, 0.008, 0.5, families={"b": ("classic", "spectral")}).orderBy("path", "window_id").toPandas()
    pd.testing.assert_frame_equal(a, b)
    c = E.recording_features(r, {"b": (100.0, 20_000.0)}, RATE, 0.008, 0.5, families={"b": ("classic", "spectral")}, chunks=3).orderBy("path", "window_id").toPandas()
    pd.testing.assert_frame_equal(a, c)
    short = spark.createDataFrame([("s", [1.0] * 10), ("t", None)], "path string, signal array<double>")
    out = E.recording_features(short, {"b": (100.0, 20_000.0)}, RATE, 0.008, 0.5, families={"b": ("classic",)}).collect()
    assert [(r["path"], r["status"]) for r in out] == [("t", "failed")]


def test_events_clamp_or_drop_cut_windows(spark):
    t = spark.createDataFrame([("e", [float(np.sin(i)) for i in range(600)], RATE, 100)], "k string, x array<double>, r double, a int")
    plans = K.plan_bands({"b": (100.0, 20_000.0)}, RATE, {"b": ("classic",)})
    modes = {"in": (0.0, 4.0), "cut": (-4.0, 4.0)}
    assert {r["window_mode"]: r["window_n_samples"] for r in E.event_features(t, plans, modes, "k", "x", "r", "a").collect()} == {"in": 256, "cut": 356}
    assert [r["window_mode"] for r in E.event_features(t, plans, modes, "k", "x", "r", "a", complete_only=True).collect()] == ["in"]
    w = t.select(F.explode(WN.arrival_windows(F.col("a"), F.size("x"), F.col("r"), modes)).alias("w")).select("w.*")
    assert {r["mode"]: (r["i0"], r["i1"]) for r in w.collect()} == {"in": (100, 356), "cut": (0, 356)}


def test_locations_find_the_source(spark, sf):
    out = signals.gcc_phat_locations(spark, sf).collect()
    assert out and all(r["status"] == "ok" and abs(r["source_x"] - 4) < 0.5 for r in out)
    few = spark.createDataFrame([(1, i, [0.0, 1.0]) for i in range(20)], "w int, i int, c array<double>")
    assert LO.locate_windows(few, "w", "i", "c", 1000.0).first()["reason"] == "too_little_data"


def test_labels_and_names(spark):
    t = spark.createDataFrame([(" BK ", "-2048pt-1000Hz-", {"Sample_Rate": "5"})], "l string, n string, p map<string,string>")
    r = t.select(L.normalize_label(F.col("l")).alias("l"), L.points_per_frame(F.col("n")).alias("n"), L.first_property(F.col("p"), "x", "sample_rate").alias("p")).first()
    assert tuple(r) == (1, 2048, "5")
    with pytest.raises(Exception, match="unknown label"):
        t.select(L.normalize_label(F.lit("what"))).collect()
    name = t.select(L.output_name(F.lit("BK-100K-a"), 500, F.lit(0.5), F.lit(1.25), F.lit(0.001), F.lit("ab")).alias("o")).first()["o"]
    assert name == "BK-500K-a-0.50_1.25_0.001-ab.npz"


def test_splits_keep_groups_together(spark):
    t = spark.range(300).select("id", (F.col("id") % 30).alias("g"), (F.col("id") % 30 % 2).alias("y"))
    s = SP.group_split(t, "y", "g", 0.7)
    assert s.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert s.where("split = 'train'").select("g").distinct().count() == 20
    bad = t.withColumn("y", F.col("id") % 2).withColumn("g", F.lit(1))
    with pytest.raises(Exception, match="two labels"):
        SP.group_split(bad, "y", "g", 0.5, strict=True).collect()
    w = SP.bootstrap_weights(t.select("id"), "id", 50)
    assert w.agg(F.sum("weight") / 300 / 50).first()[0] == pytest.approx(1, abs=0.05)
    assert SP.sample_per_root(t, "g", "id", 1.5, up=True).count() == 300


def test_draws_and_mixtures(spark):
    t = spark.createDataFrame([("a", 1.0, 0.5)], "k string, off double, dur double")
    d = WN.draw_window(t, "k", F.col("off"), F.lit(2.0), WN.shift_grid(0.0, 0.9, 0.1), 0.5).first()
    assert 0 <= d["window_start"] and d["window_start"] + 0.5 <= 2.0
    with pytest.raises(Exception, match="no valid window"):
        WN.draw_window(t, "k", F.col("off"), F.col("dur"), [0.0], 3.0).collect()
    specs = MX.draw_specs(spark, 50, 3, 2)
    n = spark.createDataFrame([(i, [float(i)] * 4) for i in (1, 2, 3)], "number long, signal array<double>")
    e = spark.createDataFrame([(1, [1.0] * 4), (2, [1.0] * 3)], "number long, signal array<double>")
    m = MX.mix_samples(specs, n, e)
    assert m.count() == 50 and {r["status"] for r in m.collect()} == {"ok", "failed"}
    assert all(r["signal"][0] == pytest.approx(r["w1"] * r["noise"] + r["w2"]) for r in m.collect() if r["status"] == "ok")


def test_greedy_choices():
    corr = {("a", "b"): 0.99, ("b", "a"): 0.99, ("a", "c"): 0.1, ("c", "a"): 0.1, ("b", "c"): 0.1, ("c", "b"): 0.1}
    rel = {"a": 0.9, "b": 0.8, "c": 0.3}
    assert [f for f, _ in SL.mrmr(list("abc"), rel, corr, 3)] == ["a", "c", "b"]
    assert C.greedy_prune(["a", "b", "c"], corr, 0.95) == ["a", "c"]
    assert [r["feature"] for r in C.redundancy_components(list("abc"), corr, rel, 0.9) if r["keep"]] == ["a", "c"]
    assert {r["lead"] for r in C.greedy_clusters(list("abc"), corr, rel, 0.9)} == {"a", "c"}


def test_models_learn_and_choose(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] + 0.2 * rng.normal(size=240) > 0).astype(int)
    t = spark.createDataFrame(pd.DataFrame({"g": np.arange(240) // 4, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y}))
    pool = [c for c in ML.candidates(3, 8) if c.name in ("lr_c1", "svm_rbf")]
    table, best = ML.search(t, ["a", "b", "c"], "g", 2, pool)
    assert max(r["auc"] for r in table) > 0.9 and 0 < best["threshold"] < 1
    assert ML.experiments(["A", "B", "C"])[-1] == ("A", "B", "C") and len(ML.experiments(["A", "B", "C"])) == 7
    auc, sep = SB.lda_auc(x, y)
    assert auc > 0.95 and sep > 1
    assert int(np.argmax(SB.relief(x, y))) == 0
    assert SB.forward_search(spark, pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y}), "label", ["a", "b", "c"], 2)[0][0] == "a"


def test_onset_and_event_rows():
    rng = np.random.default_rng(1)
    x = 0.01 * rng.normal(size=6000)
    x[3000:] += np.exp(-np.arange(3000) / 500) * np.sin(np.arange(3000) / 3)
    assert abs(R.onset(x, 100_000.0) - 3000) < 80
    row = R.event_row(x, 100_000.0, None)
    assert row["arrival_source"] == "estimated" and row["cumulative"][-1] == pytest.approx(1)
    assert R.event_row(x, 100_000.0, 10)["arrival_source"] == "labelled"


def test_stream_windows_cross_batches(spark, tmp_path):
    schema = "k string, i long, v double"
    source = tmp_path / "in"
    for b in range(3):
        spark.createDataFrame([("a", 10 * b + i, float(10 * b + i)) for i in range(10)], schema).coalesce(1).write.mode("append").parquet(str(source))
    s = ST.overlapped_windows(ST.read_files(spark, str(source), schema, files_per_batch=1), "k", "i", "v", 8, 4)
    ST.write_once(s, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("window_id").collect()
    assert [r["window_id"] for r in got] == list(range(6))
    assert all(r["mean"] == pytest.approx(np.mean(np.arange(4 * r["window_id"], 4 * r["window_id"] + 8))) for r in got)


def test_row_values_bound_once(spark):
    t = spark.createDataFrame([([3.0, 1.0, 2.0, 10.0],)], "x array<double>")
    r = t.select(S.robust_normalize(F.col("x")).alias("z"), S.moving_average(F.col("x"), 3).alias("m"), S.energy_entropy(F.col("x"), 2).alias("e")).first()
    x = np.array([3.0, 1.0, 2.0, 10.0])
    m = np.median(x)
    assert np.allclose(r["z"], (x - m) / (1.4826 * np.median(np.abs(x - m))))
    assert np.allclose(r["m"], np.convolve(x, np.ones(3) / 3, "same"))


def test_neighbour_information_and_noise(spark):
    from echoloom.operators import stability as ST2

    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 600)
    assert ST2.neighbour_information(y + 0.01 * rng.normal(size=600), y) > 0.6
    assert ST2.neighbour_information(rng.normal(size=600), y) < 0.05
    assert float(ST2._digamma(np.array(1.0))) == pytest.approx(-0.5772156649, abs=1e-8)
    t = spark.createDataFrame([(1, [math.sin(i / 3) for i in range(4000)])], "k long, x array<double>")
    r = t.select(S.with_noise(F.col("x"), 10.0, F.col("k")).alias("y"), "x").first()
    noise = np.array(r["y"]) - np.array(r["x"])
    assert 10 * math.log10(np.mean(np.square(r["x"])) / np.mean(noise**2)) == pytest.approx(10, abs=0.4)


def test_reports_and_records(spark, tmp_path):
    counts = spark.createDataFrame([("a", "train", 3)], "dataset string, split string, n long")
    rank = spark.createDataFrame([("f1", 0.5, 1, "A"), ("f2", 0.1, 2, "C")], "feature string, total double, rank int, grade string")
    text = T.markdown_report(counts, rank)
    assert "| a | train | 3 |" in text and "f1" in text and "f2" not in text
    r = spark.createDataFrame([("/d/a.npz", 0, "QJ", 1000.0, [0.0] * 500, "20260101T000000.000", "20260101T000000.250")], "path string, channel_index int, type string, sample_rate double, signal array<double>, starttime string, arrival_time string")
    i = T.record_index(r).first()
    assert (i["npts"], i["duration_s"], i["arrival_offset_s"], i["arrival_source"], i["sample_stem"]) == (500, 0.5, 0.25, "labelled", "a")
    assert T.unique_inputs(spark.createDataFrame([("/a//b",), ("/a/b",)], "path string")).count() == 1
    info = T.data_info(MX.draw_specs(spark, 1, 3, 2), 0.02).first()["data_info"]
    assert '"window_duration_s":0.02' in info
    two = spark.createDataFrame([("e", "0_30", 0.0, 30.0)] * 2, "event string, window_mode string, window_start_ms double, window_end_ms double")
    with pytest.raises(Exception, match="two canonical"):
        WN.canonical_windows(two, "event").collect()


def test_running_sums_over_pieces(spark):
    from echoloom.operators.ordered import order_statistic, running

    rng = np.random.default_rng(9)
    rows = [(g, float(v), int(rng.integers(0, 4))) for g in "ab" for v in sorted(rng.permutation(500)[:200])] + [("c", 1.0, 2)]
    t = spark.createDataFrame(rows, "g string, v double, p long")
    for rows_each in (10_000, 150, 7):
        got = running(t, ["g"], "v", ["p"], piece_rows=rows_each).orderBy("g", "v").collect()
        for g in "abc":
            mine = sorted((v, p) for k, v, p in rows if k == g)
            before = np.concatenate([[0], np.cumsum([p for _, p in mine])[:-1]]).tolist()
            assert [r["before_p"] for r in got if r["g"] == g] == before
            assert [r["next_value"] for r in got if r["g"] == g] == [v for v, _ in mine[1:]] + [None]
            assert {r["all_p"] for r in got if r["g"] == g} == {sum(p for _, p in mine)}
    whole = np.repeat([v for k, v, _ in rows if k == "a"], [p for k, _, p in rows if k == "a"])
    r = running(t.where("g = 'a'").drop("g"), [], "v", ["p"]).agg(order_statistic("v", "p", F.lit(len(whole) // 3)).alias("k")).first()
    assert r["k"] == np.sort(whole)[len(whole) // 3]


def test_quality_of_empty_and_constant_features(spark):
    t = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), ("c", 2.0), ("c", 2.0), ("c", 2.0), ("c", 50.0)], "feature string, value double")
    q = {r["feature"]: r for r in Q.feature_quality(t).collect()}
    assert q["a"]["missing_rate"] == 0.5 and q["a"]["median"] == 1.0 and q["a"]["iqr"] == 0.0
    assert q["b"]["missing_rate"] == 1.0 and q["b"]["n_unique"] == 0 and q["b"]["mean"] is None
    assert q["c"]["n_unique"] == 2 and q["c"]["iqr"] == pytest.approx(12.0) and q["c"]["outlier_rate"] == 0.0


def test_density_overlap_counts_every_row(spark):
    from echoloom.operators import discrimination as DI

    rng = np.random.default_rng(5)
    long = pd.DataFrame({"feature": ["tied"] * 16_000 + ["fine"] * 8_000 + ["flat"] * 10, "side": np.r_[np.arange(16_000) % 2, np.arange(8_000) % 2, np.arange(10) % 2]})
    long["value"] = np.r_[rng.integers(0, 11, 16_000) / 100 + 0.02 * (np.arange(16_000) % 2), rng.normal(size=8_000) + np.arange(8_000) % 2, np.ones(10)]
    got = {r["feature"]: r["overlap"] for r in DI.kde_overlap_table(spark.createDataFrame(long), ["feature"]).collect()}
    for f in ("tied", "fine"):
        one = long[long["feature"] == f]
        assert got[f] == pytest.approx(DI.kde_overlap(one.loc[one["side"] == 1, "value"], one.loc[one["side"] == 0, "value"]), abs=1e-9)
    assert math.isnan(got["flat"])


def test_density_overlap_of_tied_features(spark):
    from echoloom.plans import stats

    got = {r["feature"]: r["overlap"] for r in stats.kde_overlap(spark, "/root/testdata/sf0.1").collect()}
    assert len(got) == 4 and all(0.5 < v <= 1.001 for v in got.values())


def test_bootstrap_and_neighbours_use_every_row(spark):
    from echoloom.operators import stability as ST2

    rng = np.random.default_rng(11)
    n = 60_000
    long = pd.DataFrame({"feature": "f", "side": np.arange(n) % 2, "value": rng.integers(0, 11, n) / 100 + 0.03 * (np.arange(n) % 2)})
    t, x = spark.createDataFrame(long), np.sort(long["value"].to_numpy())
    got = ST2.bootstrap_errors(t, ["feature"], [20, 50], 40).toPandas().sort_values(["size", "statistic"])
    draws = x[np.random.default_rng(42).integers(0, n, 40 * 70)]
    want = []
    for size, part in ((20, draws[:800].reshape(40, 20)), (50, draws[800:].reshape(40, 50))):
        s = ST2._statistics(part)
        want += [(size, k, v) for k, v in zip(ST2.STATISTICS, s.std(0) / (np.abs(s.mean(0)) + 1e-12), strict=True)]
    assert np.allclose(got["rse"], [v for *_, v in sorted(want)])
    draws = x[np.random.default_rng(42).integers(0, n, 2 * 40 * 30)].reshape(2, 40, 30).mean(-1)
    gap = ST2.paired_gaps(t, ["feature"], [30], 40).first()["gap"]
    assert gap == pytest.approx(np.abs(draws[0] - draws[1]).mean() / np.sqrt((x * x).mean()))
    # on values with many ties the estimate is near the information of the table of counts
    p = pd.crosstab(long["value"].round(6), long["side"]).to_numpy() / n
    plain = np.nansum(np.where(p > 0, p * np.log(np.where(p > 0, p, 1) / (p.sum(1, keepdims=True) * p.sum(0))), 0))
    assert ST2.neighbour_information_table(t, ["feature"]).first()["mi_knn"] == pytest.approx(plain, abs=0.002)
    apart = t.withColumn("value", F.floor(F.rand(3) * 9) / 100)
    assert ST2.neighbour_information_table(apart, ["feature"]).first()["mi_knn"] < 0.001


def test_distance_curve_equals_all_rows_in_one_array(spark):
    """Samples by hash order, the label's mean of all rows and the distances, computed again in one array."""
    import hashlib

    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(300, 2)) * [1.0, 5.0], 3)
    made = [("a" if i < 200 else "b", i, float(p), float(q)) for i, (p, q) in enumerate(x)] + [("a", 900, None, 1.0)]
    t = spark.createDataFrame(made, "label string, k long, p double, q double")
    got = {(r["label"], r["size"]): r["mmd"] for r in STAB.distance_curve(t, "label", ["k"], ["p", "q"], [20, 60], 3, components=64, picked=1000).collect()}
    assert set(got) == {(l, n) for l, most in (("a", 200), ("b", 100)) for n in (20, 60, most)}
    base_rng = np.random.default_rng(42)
    base, phase = base_rng.normal(0, 1, (2, 64)), base_rng.uniform(0, 2 * np.pi, 64)
    for label, part in (("a", made[:200]), ("b", made[200:300])):
        v = np.array([r[2:] for r in part])
        low, mid, high = (np.sort(v, axis=0)[math.ceil(f * len(v)) - 1] for f in (0.25, 0.5, 0.75))
        z = (v - mid) / (high - low)
        d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
        phi = np.sqrt(2 / 64) * np.cos(z @ base / np.median(d[d > 0]) + phase)
        for n in (20, 60):
            each = []
            for r in range(3):
                order = sorted(range(len(part)), key=lambda i: hashlib.md5(f"{part[i][1]}|{r}|42".encode()).hexdigest())[:n]
                each.append(((phi[order].mean(0) - phi.mean(0)) ** 2).sum())
            assert abs(got[label, n] - np.mean(each)) < 1e-9
        assert got[label, len(part)] == 0.0


def test_stage_scores_take_the_neighbour_estimate(spark):
    from echoloom.operators import stability as ST2

    rng = np.random.default_rng(13)
    n, y = 2000, np.arange(2000) % 2
    # a fine comb tells the classes apart by the last digit, which 16 bins cannot see
    comb, half = rng.integers(0, 50, n) * 2.0 + y, rng.normal(size=n) + y
    t = spark.createDataFrame(pd.DataFrame({"key": np.arange(n), "y": y, "d": np.where(np.arange(n) % 3 > 0, "a", "b"), "comb": comb, "half": half}))
    got = {r["feature"]: r for r in SL.stage_scores(t, ["key"], ["comb", "half"], "y", "d").collect()}
    mi = {r["feature"]: r["mi_knn"] for r in ST2.neighbour_information_table(Q.long_features(t, ["key", "y"], ["comb", "half"]).withColumnRenamed("y", "side"), ["feature"]).collect()}
    assert mi["comb"] > 0.5 > mi["half"] and got["comb"]["rank"] == 1
    assert all(got[f]["mi"] == pytest.approx(mi[f]) for f in mi)


def test_subsets_are_scored_on_every_row(spark, sf):
    rows = signals._labelled(spark, sf)
    names = signals.FEATURES
    got = {r["name"]: r for r in signals.subset_search(spark, sf).collect()}
    t, moments = SB.prepared(rows, "label", names)
    f = t.toPandas()
    assert sum(v[0] for v in moments.values()) == rows.count() == len(f) > 5000
    for k in (1, 4):
        s = np.zeros(len(f))
        for fold in range(5):
            a, b = (f[(f["_fold"] != fold) & (f["label"] == c)][names[:k]].to_numpy() for c in (0, 1))
            cov = np.atleast_2d(np.cov(a.T, ddof=0) * len(a) + np.cov(b.T, ddof=0) * len(b)) / (len(a) + len(b) - 2)
            w = np.linalg.solve(cov + 1e-6 * np.trace(cov) / k * np.eye(k), b.mean(0) - a.mean(0))
            at = (f["_fold"] == fold).to_numpy()
            s[at] = (f.loc[at, names[:k]].to_numpy() - (a.mean(0) + b.mean(0)) / 2) @ w
        y = f["label"].to_numpy() == 1
        r = pd.Series(s).rank().to_numpy()
        auc = (r[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
        assert got[f"top{k}"]["auc"] == pytest.approx(abs(auc - 0.5) + 0.5, abs=1e-4)
        assert got[f"top{k}"]["separation"] == pytest.approx((s[y].mean() - s[~y].mean()) / np.sqrt((s[y].var() + s[~y].var()) / 2), rel=1e-6)


def test_pairs_skip_missing_values_and_constants(spark):
    rng = np.random.default_rng(21)
    f = pd.DataFrame(rng.normal(size=(400, 3)) + 1e6, columns=["a", "b", "c"])
    f["b"] += f["a"]
    f.loc[::7, "a"], f.loc[3::11, "b"], f["d"] = np.nan, np.inf, 0.1
    got = {(r[0], r[1]): r[2] for r in C.pairs(spark.createDataFrame(f).repartition(5), list("dcba")).collect()}
    want = f.replace(np.inf, np.nan).corr()
    assert len(got) == 6 and all(v == pytest.approx(0.0 if "d" in k else want.loc[k], abs=1e-9) for k, v in got.items())
    empty = C.pairs(spark.createDataFrame(f).where("a < 0"), ["a", "b"]).collect()
    assert [r["corr"] for r in empty] == [0.0]


def test_ranks_keep_rows_of_repeated_keys(spark):
    f = pd.DataFrame({"k": [1, 1, 2, 2, 2], "a": [3.0, 1.0, 3.0, np.nan, 2.0], "b": [np.nan] * 5})
    got = C.with_ranks(spark.createDataFrame(f), ["a", "b"], ["k"]).toPandas()
    assert sorted(got["k"]) == [1, 1, 2, 2, 2] and got["b"].isna().all()
    assert sorted(got["a"].dropna()) == [1.0, 2.0, 3.5, 3.5] and len(got) == 5


def most_read(spark, run):
    """Most shuffled rows that one task read while run() ran."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return [found.apply(i) for i in range(found.size())]

    old = {s.stageId() for s in stages()}
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    most = 0
    for s in stages():
        if s.stageId() not in old:
            tasks = store.taskList(s.stageId(), s.attemptId(), 1000)
            read = [tasks.apply(i).taskMetrics() for i in range(tasks.size())]
            most = max([most, *(m.get().shuffleReadMetrics().recordsRead() for m in read if m.isDefined())])
    return most


@pytest.mark.parametrize("wide_joins", [4, 0])
def test_no_task_of_ranks_holds_the_rows_of_a_value(spark, monkeypatch, wide_joins):
    """One value and the missing one have most rows; ranks are too many to be broadcast."""
    for name, n in {"BROADCAST_RANKS": 10, "WIDE_JOINS": wide_joins, "JOIN_CELLS": 2000, "COMMON_ROWS": 500}.items():
        monkeypatch.setattr(C, name, n, raising=False)
    rng = np.random.default_rng(5)
    a = np.where(rng.random(20_000) < 0.5, 7.0, rng.integers(0, 200, 20_000))
    b = np.where(rng.random(20_000) < 0.5, np.nan, rng.integers(0, 150, 20_000))
    f = pd.DataFrame({"k": np.arange(20_000), "a": a, "b": b, "c": a % 3})
    df, got = spark.createDataFrame(f), None

    def run():
        nonlocal got
        got = C.with_ranks(df, ["a", "b", "c"], ["k"]).toPandas()

    # as on large tables: partitions aren't merged to one task, and Spark doesn't broadcast the ranks unasked
    as_large = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, v in as_large.items():
        spark.conf.set(name, v)
    try:
        assert most_read(spark, run) < 6000
    finally:
        for name in as_large:
            spark.conf.unset(name)
    got = got.sort_values("k", ignore_index=True)
    for c in "abc":
        assert np.array_equal(got[c], f[c].rank(), equal_nan=True)


def test_describe_and_medians_equal_pandas(spark):
    rng = np.random.default_rng(22)
    f = pd.DataFrame({"a": rng.normal(size=301), "b": rng.integers(0, 4, 301) * 1.0, "c": [np.nan] * 300 + [5.0], "none": [np.nan] * 301})
    got = Q.describe(Q.long_features(spark.createDataFrame(f), [], list(f))).toPandas().set_index("feature")
    for c in ("a", "b"):
        want = f[c].describe(percentiles=[0.1, 0.25, 0.5, 0.75, 0.9])
        assert np.allclose(got.loc[c, ["count", "mean", "std", "min", "p10", "p25", "p50", "p75", "p90", "max"]].astype(float), want)
    assert got.loc["c", "count"] == 1 and np.isnan(got.loc["c", "std"]) and got.loc["none", "count"] == 0
    filled = Q.median_impute(spark.createDataFrame(f), list(f)).toPandas()
    assert np.allclose(filled["c"], 5.0) and np.allclose(filled["none"], 0.0) and np.allclose(filled["a"], f["a"])


def test_permuted_rows_give_their_values_once(spark):
    t = spark.createDataFrame(pd.DataFrame({"a": np.arange(500) * 1.0, "b": np.arange(500) * 2.0, "label": np.arange(500) % 2}))
    got = ML.permuted(t, ["a", "b"], 2, 7, block=64).toPandas()
    for _, r in got.groupby("repeat"):
        donors = [d["a"] for d in r["_donor"]]
        assert sorted(donors) == list(range(500)) and (np.array(donors) != r["a"].to_numpy()).mean() > 0.95


def test_curves_and_average_precision(spark):
    f = pd.DataFrame({"m": ["x"] * 6, "label": [1, 0, 1, 1, 0, 0], "score": [0.9, 0.8, 0.8, 0.4, 0.3, 0.1]})
    curve = M.roc_curve(spark.createDataFrame(f), "label", "score", ["m"])
    got = {r["threshold"]: (r["tpr"], r["fpr"], r["precision"]) for r in curve.collect()}
    assert got[0.8] == pytest.approx((2 / 3, 1 / 3, 2 / 3)) and got[0.1] == pytest.approx((1, 1, 0.5))
    assert M.average_precision(curve, ["m"]).first()["average_precision"] == pytest.approx(1 / 3 + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 4))


def test_sample_info_has_all_keys(spark):
    import json

    got = json.loads(T.sample_info(spark.createDataFrame([(0.5, "n.npz")], "w1 double, source_noise_file string")).first()["data_info"])
    assert list(got) == T.INFO_KEYS and len(got) == 23
    assert got["w1"] == 0.5 and got["window_duration_s"] == 0.02 and got["mixed_rms"] is None


def test_curves_are_written_by_method(spark, tmp_path):
    T.write_curves(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "method string, psd double"), f"{tmp_path}/curves")
    assert sorted(p.name for p in tmp_path.glob("curves/method=*")) == ["method=a", "method=b"]
