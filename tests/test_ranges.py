"""Recordings read by ranges equal recordings read whole, whatever the container, the range and the margins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom import features_engine as E
from echoloom.operators.windows import window_ranges, windows_between
from echoloom.sources import decode as D
from echoloom.sources import ranges as R


def containers(folder):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1000, 3))
    whole = rng.integers(-(2**31), 2**31, (700, 4))
    (folder / "sub").mkdir()
    (folder / "rows.npz").write_bytes(D.encode_npz(x, 1e3, starttime="20260101T000000.000"))
    (folder / "one.npz").write_bytes(D.encode_npz(x[:, 0], 1e3, type="QJ00"))
    (folder / "packed.npz").write_bytes(D.encode_npz(x, 2e3, compressed=True))
    np.savez(folder / "sub" / "columns.npz", phase_data=np.asfortranarray(x), sample_rate=1e3, channel_names=np.array(["p", "q", "r"]))
    np.savez(folder / "sub" / "small.npz", phase_data=x[:5].astype("f4"), sample_rate=1e3)
    np.savez_compressed(folder / "sub" / "packed_columns.npz", phase_data=np.asfortranarray(x), sample_rate=1e3)
    (folder / "dev-4pt-500Hz-1.bin").write_bytes(D.encode_bin(whole))
    (folder / "runs.tdms").write_bytes(D.encode_tdms({"noise": x[:, 1], "phase": x[:, 0]}, {"sample_rate": 1e3, "type": "FL00"}, segment=300))
    (folder / "mixed_1k.tdms").write_bytes(D.encode_tdms({"a": x[:, 2], "b": x[:, 1]}, {"wf_increment": 1e-3}, segment=77, interleaved=True))
    return {
        **{("rows.npz", c): x[:, c] for c in range(3)}, ("one.npz", 0): x[:, 0], **{("packed.npz", c): x[:, c] for c in range(3)}, **{("columns.npz", c): x[:, c] for c in range(3)},
        **{("packed_columns.npz", c): x[:, c] for c in range(3)}, **{("small.npz", c): x[:5, c].astype("f4").astype(float) for c in range(3)},
        **{("dev-4pt-500Hz-1.bin", c): whole[:, c] * D.PHASE_SCALE for c in range(4)}, ("runs.tdms", 0): x[:, 0], ("mixed_1k.tdms", 0): x[:, 2],
    }


@pytest.mark.parametrize("values,before,after", [(1 << 20, 0, 0), (90, 0, 0), (90, 13, 31), (1, 2, 0), (400, 5000, 5000)])
def test_ranges_join_to_the_recording(spark, tmp_path, values, before, after):
    want = containers(tmp_path)
    if values == 1:
        want = {k: v for k, v in want.items() if k[0] == "small.npz"}
    pattern = "small.npz" if values == 1 else "*"
    t = R.read_ranges(spark, str(tmp_path), pattern=pattern, range_values=values, before=before, after=after)
    got = {}
    for r in t.collect():
        assert r["status"] == "ok" and r["lead"] == min(before, r["first"])
        key = (r["path"].rsplit("/", 1)[-1], r["channel_index"])
        signal, n = np.array(r["signal"]), r["total"]
        assert np.array_equal(signal, want[key][r["first"] - r["lead"] : r["last"] + after])
        got.setdefault(key, []).append((r["first"], r["last"], n))
    assert set(got) == set(want)
    for key, parts in got.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == len(want[key]) == parts[0][2] and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    if values == 90:
        assert t.rdd.getNumPartitions() > 50
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
        by_tasks = R.ranges_of(files, values, before, after)
        said = lambda df: sorted((r["path"].rsplit("/", 1)[-1], r["channel_index"], r["first"], r["last"], r["lead"], tuple(r["signal"])) for r in df.collect())
        assert said(by_tasks) == said(t)


def test_headers_say_what_containers_say(spark, tmp_path):
    containers(tmp_path)
    got = {(r["path"].rsplit("/", 1)[-1], r["channel_index"]): r for r in R.read_ranges(spark, f"file://{tmp_path}").collect()}
    assert got["rows.npz", 1]["starttime"] == "20260101T000000.000" and got["one.npz", 0]["type"] == "QJ00" and got["small.npz", 0]["type"] == "sub"
    assert got["columns.npz", 2]["channel_name"] == "r" and got["mixed_1k.tdms", 0]["sample_rate"] == pytest.approx(1e3) and got["mixed_1k.tdms", 0]["channel_name"] == "a"
    assert got["dev-4pt-500Hz-1.bin", 3]["sample_rate"] == 500 and got["runs.tdms", 0]["channel_name"] == "phase"
    named = R.read_ranges(spark, str(tmp_path / "runs.tdms"), channel="NOISE").collect()
    assert [r["channel_name"] for r in named] == ["noise"]


def test_files_that_cannot_be_read_are_rows(spark, tmp_path):
    (tmp_path / "broken.npz").write_bytes(b"nothing")
    (tmp_path / "dev-5pt-10Hz-1.bin").write_bytes(np.arange(12, dtype="<i4").tobytes())
    (tmp_path / "empty-1pt-.bin").write_bytes(b"")
    (tmp_path / "text.csv").write_text("a")
    np.savez(tmp_path / "objects.npz", phase_data=np.array([1, "a"], dtype=object), sample_rate=1.0)
    np.savez(tmp_path / "none.npz", phase_data=np.zeros((0, 2)), sample_rate=1.0)
    np.savez(tmp_path / "no_rate.npz", phase_data=np.zeros(4))
    whole = D.encode_npz(np.zeros(5000), 1.0)
    got = {r["path"].rsplit("/", 1)[-1]: r for r in R.read_ranges(spark, str(tmp_path)).collect()}
    assert len(got) == 7 and all(r["status"] == "failed" and r["message"] and r["signal"] is None for r in got.values())
    assert "multiple" in got["dev-5pt-10Hz-1.bin"]["message"] and "sample_rate" in got["no_rate.npz"]["message"] and got["none.npz"]["message"] == "no samples"
    (tmp_path / "later.npz").write_bytes(whole)
    header = R.read_header(str(tmp_path / "later.npz"))
    (tmp_path / "later.npz").write_bytes(whole[:3000])  # cut off after it was planned
    (piece,) = R.cut(header)
    assert [b.to_pylist()[0]["status"] for b in R.read_piece(piece)] == ["failed"]
    with pytest.raises(Exception, match="range_values"):
        R.read_ranges(spark, str(tmp_path), range_values=0).collect()
    (tmp_path / "nothing").mkdir()
    assert R.read_ranges(spark, str(tmp_path / "nothing")).collect() == []


def test_a_range_is_all_that_is_read(tmp_path, monkeypatch):
    """Bytes read of a large container: its directory, its small members, and the range."""
    (tmp_path / "big.npz").write_bytes(D.encode_npz(np.arange(500_000.0), 1e3))
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, *n):
            data = self.f.read(*n)
            read.append(len(data))
            return data

        def __getattr__(self, name):
            return getattr(self.f, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

    real = R._store

    class Store:
        def __init__(self, store):
            self.store = store

        def open_input_file(self, p):
            return Counted(self.store.open_input_file(p))

    monkeypatch.setattr(R, "_store", lambda uri: (Store(real(uri)[0]), real(uri)[1]))
    header = R.read_header(str(tmp_path / "big.npz"))
    assert header.error is None and sum(read) < 100_000
    read.clear()
    piece = R.cut(header, 1000)[123]
    (batch,) = R.read_piece(piece, 10, 20)
    assert batch.to_pylist()[0]["signal"][0] == 122_990.0 and sum(read) == 1030 * 8


def test_many_segments_cost_a_range_only_its_own(tmp_path):
    (tmp_path / "s.tdms").write_bytes(D.encode_tdms({"a": np.arange(5000.0), "b": np.zeros(5000)}, {"sample_rate": 1.0}, segment=10))
    header = R.read_header(str(tmp_path / "s.tdms"))
    assert len(header.groups[0].extents) == 500 and {len(p.header.groups[0].extents) for p in R.cut(header, 50, 3, 3)} <= {5, 6, 7}


def test_windows_of_ranges_equal_windows_of_recordings(spark, tmp_path):
    rng = np.random.default_rng(6)
    rate, bands = 2000.0, {"b": (100.0, 700.0)}
    families = {"b": ("classic", "time", "spectral")}
    waves = {"a": rng.normal(size=6000) + 3, "b": rng.normal(size=2111)}
    for n, x in waves.items():
        (tmp_path / f"{n}.npz").write_bytes(D.encode_npz(x, rate))
    (tmp_path / "other.npz").write_bytes(D.encode_npz(waves["a"], 1.5 * rate))
    before, after = E.range_margins(bands, rate, 0.1, families)
    ranges = R.read_ranges(spark, str(tmp_path), range_values=700, before=before, after=after)
    got = E.range_features(ranges, bands, rate, 0.1, 0.5, families).toPandas()
    failed = got[got["status"] == "failed"]
    assert list(failed["path"].str.endswith("other.npz")) == [True] and "sample_rate" in failed["message"].iloc[0]
    got = got[got["status"] == "ok"].assign(path=lambda f: f["path"].str.extract(r"(\w)\.npz$")[0]).sort_values(["path", "window_id"]).reset_index(drop=True)
    records = spark.createDataFrame([(n, x.tolist()) for n, x in waves.items()], "path string, signal array<double>")
    want = E.recording_features(records, bands, rate, 0.1, 0.5, families=families).toPandas().sort_values(["path", "window_id"]).reset_index(drop=True)
    assert len(got) == len(want) > 70
    for c in want.columns:
        if c.startswith("b__"):
            assert np.allclose(got[c], want[c], rtol=1e-6, atol=1e-9, equal_nan=True), c
        elif c != "message":
            assert list(got[c]) == list(want[c]), c


def test_windows_between_are_those_of_the_whole():
    for first, last in ((0, 50), (7, 8), (10, 400), (390, 1000)):
        want = [w for w in window_ranges(407, 100.0, 0.5, 0.7) if first <= w[1] < last]
        assert windows_between(407, 100.0, 0.5, 0.7, first, last) == want
