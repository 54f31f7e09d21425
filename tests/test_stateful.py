"""Windows over late and unordered events: released by the watermark, in order, and state that ends with its key."""

import numpy as np
import pandas as pd
import pytest

from echoloom.streaming import stateful as SW
from echoloom.streaming import windows as ST


def stream(spark, folder, parts, length, step, bucket=10.0, idle=1e9, late="60 seconds"):
    for k, rows in enumerate(parts):
        f = pd.DataFrame(rows, columns=["k", "s", "n", "v"])
        f["ts"] = pd.to_datetime(f["s"], unit="s")
        spark.createDataFrame(f[["k", "ts", "n", "v"]], "k string, ts timestamp, n long, v double").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    s = ST.timed(ST.read_files(spark, f"{folder}/in", "k string, ts timestamp, n long, v double", files_per_batch=1), "ts", late)
    ST.write_once(SW.late_windows(s, "k", "ts", "n", "v", length, step, bucket, idle), f"{folder}/out", f"{folder}/ck")
    return spark.read.parquet(f"{folder}/out").orderBy("k", "window_id").collect()


def test_late_rows_are_sorted_in(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [("ab"[k % 2], 1000 + 3 * k + int(rng.integers(0, 40)), k, float(rng.normal())) for k in range(200)]
    parts = [rows[k : k + 50] for k in range(0, 200, 50)]
    got = stream(spark, str(tmp_path), [[rows[k] for k in rng.permutation(50) + 50 * j] for j in range(len(parts))], 6, 3)
    mark = max(s for _, s, *_ in rows) - 60
    assert got
    for key in "ab":
        mine = [v for _, _, v in sorted((s, n, v) for k, s, n, v in rows if k == key and (s // 10 + 1) * 10 <= mark)]
        mine_rows = [r for r in got if r["k"] == key]
        assert [r["window_id"] for r in mine_rows] == list(range((len(mine) - 6) // 3 + 1))
        for r in mine_rows:
            w = np.array(mine[3 * r["window_id"] : 3 * r["window_id"] + 6])
            assert (r["mean"], r["rms"], r["peak"]) == pytest.approx((w.mean(), np.sqrt((w * w).mean()), np.abs(w).max()))


def test_state_ends_with_a_silent_key(spark, tmp_path):
    """A key that comes back after its idle time starts anew: neither its numbers nor its samples go on."""
    first, again = [("a", 100 + k, k, 1.0) for k in range(5)], [("a", 9000 + k, k, 2.0) for k in range(5)]
    others = [[("b", t, 0, 0.0)] for t in (300, 4000, 8000)]
    got = stream(spark, str(tmp_path), [first, *others, again, [("b", 20_000, 0, 0.0)]], 4, 4, idle=500.0)
    assert [(r["k"], r["window_id"], r["mean"]) for r in got if r["k"] == "a"] == [("a", 0, 1.0), ("a", 0, 2.0)]
    got = stream(spark, str(tmp_path / "longer"), [first, *others, again, [("b", 20_000, 0, 0.0)]], 4, 4)
    assert [(r["window_id"], r["mean"]) for r in got if r["k"] == "a"] == [(0, 1.0), (1, 1.75)]


def test_steps_longer_than_windows_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        stream(spark, str(tmp_path), [[("a", 1, 1, 1.0)]], 2, 3)
