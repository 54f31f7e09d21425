"""Datasets by folder, arrivals, folder batches, aliases and run descriptions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.functions import labels as L
from echoloom.kernels import features as K
from echoloom.kernels.spectra import analytic, estimate_arrival
from echoloom.sources import decode as D
from echoloom.sources import files as FI
from echoloom.sources import records as R
from echoloom.sources import tables as T


def plain_estimate(x, rate):
    """The definition sample by sample."""
    e = np.abs(analytic(x)) ** 2
    n, width = len(e), max(1, round(rate * 0.0005))
    smooth = np.convolve(e, np.ones(width) / width, "same") if n >= width else None
    base = smooth[: max(10, min(n // 5, round(rate * 0.01)))]
    over = [k for k in range(n) if smooth[k] >= base.mean() + 6 * base.std()]
    return over[0] if over else int(np.argmax(smooth))


def test_estimated_arrivals():
    rng = np.random.default_rng(4)
    for n, rate, at in ((2000, 50_000.0, 900), (600, 8_000.0, 250), (300, 1_000.0, 200)):
        x = 0.01 * rng.normal(size=n)
        x[at:] += np.sin(np.arange(n - at) * 0.8) * np.exp(-np.arange(n - at) / 100)
        assert estimate_arrival(x, rate) == plain_estimate(x, rate) and abs(estimate_arrival(x, rate) - at) < 40
    assert estimate_arrival(np.zeros(50), 1e3) == 0 and estimate_arrival(np.r_[np.ones(40), 1.01], 1e3) == plain_estimate(np.r_[np.ones(40), 1.01], 1e3)


def test_arrivals_of_odd_records(spark):
    rows = [
        ("a", [0.0] * 9 + [1.0], 10.0, "20260101T000000.000", "20260101000000.420000", "ok"), ("late", [0.0] * 10, 10.0, "20260101T000000.000", "20260101000009.000000", "ok"),
        ("before", [0.0] * 10, 10.0, "20260101T000000.000", "20251231235959.000000", "ok"), ("text", [0.0] * 10, 10.0, "20260101T000000.000", "soon", "ok"),
        ("empty", [], 10.0, "20260101T000000.000", None, "ok"), ("failed", None, None, None, None, "failed"),
    ]
    t = spark.createDataFrame(rows, "path string, signal array<double>, sample_rate double, starttime string, arrival_time string, status string")
    got = {r["path"]: (r["arrival_source"], r["arrival_index"]) for r in R.with_arrivals(t).collect()}
    assert got == {"a": ("labeled", 4), "late": ("labeled", 9), "before": ("labeled", 0), "text": ("estimated", 0), "empty": ("estimated", None), "failed": ("estimated", None)}
    one = R.with_arrivals(t.where("path = 'a'"), F.lit(False)).first()
    assert one["arrival_source"] == "estimated" and one["arrival_offset_s"] == one["arrival_index"] / 10.0


def test_datasets_lie_in_their_folders(spark, tmp_path):
    x = np.sin(np.arange(40) / 3)
    for folder in (f"{R.EVENT_FOLDER}/corrosion", f"{R.EVENT_FOLDER}/cut", f"{R.EVENT_FOLDER}/other", "F130", "F130/deeper", "F1300"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "x.npz").write_bytes(D.encode_npz(x, 1e3, starttime="20260101T000000.000", arrival_time="20260101000000.010000"))
    found = {(r["dataset"], r["method"], r["arrival_source"]) for r in R.dataset_records(spark, str(tmp_path), ["BK14", "F130", "gone"]).collect()}
    assert found == {("BK14", "corrosion", "labeled"), ("BK14", "cut", "labeled"), ("F130", None, "estimated")}
    assert R.dataset_files(spark, f"file://{tmp_path}/", ["F130"]).count() == 1


def test_folder_batches(spark, tmp_path):
    rng = np.random.default_rng(2)
    for k, folder in enumerate(("on", "off", "unknown")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / f"{k}.npz").write_bytes(D.encode_npz(5 + rng.normal(size=(600, 2)), 400_000.0))
    (tmp_path / "in" / "on" / "slow.npz").write_bytes(D.encode_npz(np.zeros(10), 10.0))
    records = D.decode(FI.discover(spark, str(tmp_path / "in")))
    bands = {"low": (2_000.0, 40_000.0), "high": (20_000.0, 90_000.0)}
    out = R.folder_features(records, {"on": 1, "off": 0}, bands, 400_000.0, str(tmp_path / "out"), families={b: ("classic",) for b in bands})
    rows = out.collect()
    assert {(r["folder"], r["label"], r["channel_index"]) for r in rows} == {("on", 1, 0), ("on", 1, 1), ("off", 0, 0), ("off", 0, 1)}
    assert set(K.output_columns(K.plan_bands(bands, 400_000.0, {b: ("classic",) for b in bands}))) <= set(out.columns)
    back = spark.read.option("header", "true").csv(str(tmp_path / "out"))
    assert back.count() == 4 and {p.name for p in (tmp_path / "out").glob("folder=*")} == {"folder=on", "folder=off"}


def test_source_labels(spark):
    t = spark.createDataFrame([("v05-flow",), (" QJ ",), (None,), ("",), ("flow",), ("nothing",), ("BK05",)], "v string")
    assert [r[0] for r in t.select(L.source_label(F.col("v"), F.lit("FL00"))).collect()] == ["FL05", "QJ00", "FL00", "FL00", "FL00", "FL00", "BK05"]
    with pytest.raises(Exception, match="no class: XX"):
        t.select(L.target_label(F.lit("XX"))).collect()


def test_run_descriptions(spark, tmp_path):
    path = str(tmp_path / "run_manifest")
    parts = spark.createDataFrame([("u", 0.5, ["a", "b"])], "train string, threshold double, features array<string>")
    for seed in (1, 2):
        T.write_manifest(spark, path, {"seed": seed, "targets": [0.95]}, parts)
    (text,) = [r["value"] for r in spark.read.text(path).collect()]
    got = json.loads(text)
    assert got["seed"] == 2 and got["experiments"] == [{"train": "u", "threshold": 0.5, "features": ["a", "b"]}] and "generated_at" in got
    assert not (tmp_path / "run_manifest.staged").exists()
