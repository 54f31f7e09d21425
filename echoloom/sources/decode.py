"""Decoders of waveform containers: bytes -> rows (one per channel). A file that can't be read gives a row with its error.

Arrays are read without unpickling: object arrays of untrusted files never run code.
"""

from __future__ import annotations

import io
import math
import re
import struct
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = "path string, channel_index int, channel_name string, signal array<double>, sample_rate double, starttime string, arrival_time string, type string, metadata map<string,string>, status string, message string"
PHASE_SCALE = math.pi / 32767
#: Channel names tried in this order.
PREFERRED_CHANNELS = ("phase_data", "phase", "data", "signal", "ch0", "channel0", "channel_0")


def _text(v) -> str | None:
    if v is None:
        return None
    a = np.asarray(v)
    if a.size == 0 or a.dtype == object:
        return None
    s = str(a.reshape(-1)[0])
    return None if s.strip().lower() in ("", "none", "nan") else s


def _number(v) -> float | None:
    try:
        f = float(np.asarray(v).reshape(-1)[0])
        return f if math.isfinite(f) else None
    except (TypeError, ValueError, IndexError):
        return None


def read_npz(data: bytes, path: str) -> list[dict]:
    """Every channel of phase_data; keys that need unpickling are left out."""
    got = {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            try:
                got[name.removesuffix(".npy")] = np.load(io.BytesIO(z.read(name)), allow_pickle=False)
            except ValueError:
                continue
    if "phase_data" not in got:
        raise ValueError("phase_data is missing")
    wave, rate = np.asarray(got["phase_data"], float), _number(got.get("sample_rate"))
    if rate is None or rate <= 0:
        raise ValueError("sample_rate is missing or not positive")
    wave = wave.reshape(-1, 1) if wave.ndim < 2 else wave
    names = [str(x) for x in got["channel_names"].reshape(-1)] if "channel_names" in got and got["channel_names"].dtype.kind in "US" else []
    plain = {k: t for k, v in got.items() if k != "phase_data" and v.size == 1 and (t := _text(v)) is not None}
    folder = path.rsplit("/", 2)[-2] if path.count("/") > 1 else None
    return [
        {"channel_index": c, "channel_name": names[c] if c < len(names) else f"ch{c}", "signal": wave[:, c], "sample_rate": rate, "starttime": _text(got.get("starttime")), "arrival_time": _text(got.get("arrival_time")), "type": _text(got.get("type")) or folder, "metadata": plain}
        for c in range(wave.shape[1])
    ]


def read_bin(data: bytes, path: str) -> list[dict]:
    """Little-endian 32-bit frames by points, scaled to radians; points and rate come from the name."""
    n, r = points_and_rate(path)
    if not data:
        raise ValueError("the file is empty")
    raw = np.frombuffer(data, "<i4")
    if len(raw) % n:
        raise ValueError(f"{len(raw)} values are no multiple of {n} points")
    frames = raw.reshape(-1, n) * PHASE_SCALE
    return [{"channel_index": c, "channel_name": f"ch{c}", "signal": frames[:, c], "sample_rate": r, "starttime": None, "arrival_time": None, "type": None, "metadata": {}} for c in range(n)]


def points_and_rate(path: str) -> tuple[int, float | None]:
    """What the name of a file of frames says: points a frame, and samples a second where it does."""
    name = path.rsplit("/", 1)[-1]
    points, rate = re.search(r"-(\d+)pt-", name), re.search(r"-(\d+)Hz-", name)
    if not points or not int(points[1]):
        raise ValueError("the name has no point count")
    return int(points[1]), float(rate[1]) if rate else None


#: Numbers of the segment format's data types and their NumPy kinds.
_TDMS_KINDS = {1: "<i1", 2: "<i2", 3: "<i4", 4: "<i8", 5: "<u1", 6: "<u2", 7: "<u4", 8: "<u8", 9: "<f4", 10: "<f8"}


class _Reader:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, fmt: str):
        v = struct.unpack_from("<" + fmt, self.data, self.at)
        self.at += struct.calcsize("<" + fmt)
        return v[0] if len(v) == 1 else v

    def text(self) -> str:
        n = self.take("I")
        self.at += n
        return self.data[self.at - n : self.at].decode("utf-8", "replace")

    def value(self, kind: int):
        if kind == 0x20:
            return self.text()
        if kind == 0x21:
            return bool(self.take("B"))
        if kind == 0x44:
            fraction, seconds = self.take("Qq")
            return seconds - 2082844800 + fraction / 2**64
        v = np.frombuffer(self.data, _TDMS_KINDS[kind], 1, self.at)
        self.at += v.nbytes
        return v[0].item()


def tdms_places(read: Callable[[int, int], bytes], size: int) -> tuple[dict[str, list[tuple[int, int, int, str]]], dict[str, dict]]:
    """Where the numeric channels' samples lie (offset, count, bytes from one to the next, kind), and the properties of all
    objects of a segmented file, contiguous or interleaved. Only lead-ins and metadata are read: read(offset, bytes)."""
    order: list[str] = []
    layout: dict[str, tuple[int, int]] = {}
    places: dict[str, list[tuple[int, int, int, str]]] = {}
    properties: dict[str, dict] = {}
    at = 0
    while at + 28 <= size and (lead := read(at, 28))[:4] == b"TDSm":
        toc, _, ahead, raw_at = struct.unpack_from("<IIQQ", lead, 4)
        start = at + 28
        end = size if ahead == 0xFFFFFFFFFFFFFFFF else start + ahead
        if toc & 2:
            r = _Reader(read(start, min(raw_at, size - start) if raw_at else end - start), 0)
            if toc & 4:
                order = []
            for _ in range(r.take("I")):
                name, index = r.text(), r.take("I")
                if index not in (0xFFFFFFFF, 0):
                    kind, _, count = r.take("IIQ")
                    if kind == 0x20:
                        r.take("Q")
                    layout[name] = (kind, count)
                if index != 0xFFFFFFFF and name not in order:
                    order.append(name)
                for _ in range(r.take("I")):
                    key = r.text()
                    properties.setdefault(name, {})[key] = r.value(r.take("I"))
        pos, live = start + raw_at, [n for n in order if n in layout and layout[n][0] in _TDMS_KINDS]
        widths = [np.dtype(_TDMS_KINDS[layout[n][0]]).itemsize for n in live]
        block = sum(w * layout[n][1] for n, w in zip(live, widths, strict=True)) if toc & 8 else 0
        while block and pos + block <= end:
            inside = 0
            for n, w in zip(live, widths, strict=True):
                kind, count = _TDMS_KINDS[layout[n][0]], layout[n][1]
                if toc & 32:
                    # one sample of each channel in turn
                    places.setdefault(n, []).append((pos + inside, layout[live[0]][1], sum(widths), kind))
                    inside += w
                else:
                    places.setdefault(n, []).append((pos + inside, count, w, kind))
                    inside += w * count
            pos += block
        at = end
    return places, properties


def tdms_channels(data: bytes) -> tuple[dict[str, np.ndarray], dict[str, dict]]:
    """Numeric channels and the properties of all objects of a segmented file that is in memory."""
    places, properties = tdms_places(lambda at, n: data[at : at + n], len(data))
    return {n: np.concatenate([np.ndarray(count, kind, data, offset, step).astype(float) for offset, count, step, kind in v]) for n, v in places.items()}, properties


def tdms_choice(lengths: dict[str, int], properties: dict[str, dict], path: str, channel: str | None, fallback_rate: float | None) -> tuple[str, str, float, dict]:
    """The channel to read (the named one, else a preferred name, else the longest), its short name, its rate (from properties,
    wf_increment, the file's name, the fallback) and the properties that hold for it."""
    if not lengths:
        raise ValueError("no numeric channel")
    short = {n: n.rsplit("'/'", 1)[-1].strip("/'") for n in lengths}
    by = {s.lower(): n for n, s in short.items()}
    if channel is not None and channel.lower() not in by:
        raise ValueError(f"no channel named {channel}")
    name = by.get((channel or "").lower()) or next((by[p] for p in PREFERRED_CHANNELS if p in by), None) or max(lengths, key=lengths.__getitem__)
    merged: dict[str, object] = {}
    for scope in ("/", name.rsplit("/'", 1)[0], name):
        merged |= {k.lower(): v for k, v in properties.get(scope, {}).items()}
    step = _number(merged.get("wf_increment"))
    token = re.search(r"(?i)(\d+(?:\.\d+)?)\s*([km])(?:hz)?(?![a-z])", path.rsplit("/", 1)[-1])
    rate = _number(merged.get("sample_rate")) or (1 / step if step else None) or (float(token[1]) * (1e6 if token[2].lower() == "m" else 1e3) if token else None) or fallback_rate
    if not rate:
        raise ValueError("no sample rate")
    return name, short[name], float(rate), merged


def read_tdms(data: bytes, path: str, channel: str | None = None, fallback_rate: float | None = None) -> list[dict]:
    """One channel: the named one, else a preferred name, else the longest. Rate from properties, wf_increment, name, fallback."""
    waves, properties = tdms_channels(data)
    name, short, rate, merged = tdms_choice({n: len(w) for n, w in waves.items()}, properties, path, channel, fallback_rate)
    return [{"channel_index": 0, "channel_name": short, "signal": waves[name], "sample_rate": rate, "starttime": _text(merged.get("starttime")), "arrival_time": _text(merged.get("arrival_time")), "type": _text(merged.get("type")), "metadata": {k: str(v) for k, v in merged.items()}}]


READERS: dict[str, Callable[[bytes, str], list[dict]]] = {".npz": read_npz, ".tdms": read_tdms, ".bin": read_bin}
_KINDS = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "map<string,string>": pa.map_(pa.string(), pa.string())}
_SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (c.split() for c in RECORD.split(", "))])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    """Rows as Arrow; signals go over as one flat array with offsets."""
    signals = [r.get("signal") for r in rows]
    sizes = [None if x is None else len(x) for x in signals]
    ends = np.cumsum([n or 0 for n in sizes])
    offsets = pa.array([None if n is None else int(e - n) for n, e in zip(sizes, ends, strict=True)] + [int(ends[-1])], pa.int32())
    flat = np.concatenate([np.asarray(x, float) for x in signals if x is not None]) if any(n is not None for n in sizes) else np.zeros(0)
    columns = [
        pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float64())) if f.name == "signal"
        else pa.array([list((r.get("metadata") or {}).items()) for r in rows], f.type) if f.name == "metadata"
        else pa.array([r.get(f.name) for r in rows], f.type)
        for f in _SCHEMA
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def decode(files: DataFrame) -> DataFrame:
    """path, content -> records by suffix. A failure is a row with status failed, not an exception."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    reader = READERS.get("." + path.rsplit(".", 1)[-1].lower())
                    if reader is None:
                        raise ValueError("no reader for this suffix")
                    rows = [r | {"path": path, "status": "ok"} for r in reader(content, path)]
                except Exception as e:  # the row carries it
                    rows = [{"path": path, "status": "failed", "message": f"{type(e).__name__}: {e}"}]
                yield _batch(rows)

    return files.select("path", "content").mapInArrow(run, RECORD)


def dead_letters(records: DataFrame) -> DataFrame:
    return records.where(F.col("status") == "failed").select("path", "message")


def encode_npz(signal, rate: float, compressed: bool = False, **extra) -> bytes:
    """The waveform container with its counts."""
    out, wave = io.BytesIO(), np.asarray(signal, float)
    (np.savez_compressed if compressed else np.savez)(out, phase_data=wave, sample_rate=np.float64(rate), comm_count=len(wave), npts=len(wave), **{k: v for k, v in extra.items() if v is not None})
    return out.getvalue()


def encode_bin(frames) -> bytes:
    """Frames (samples by points) of whole numbers, as read_bin reads them before scaling."""
    return np.asarray(frames, "<i4").tobytes()


def encode_tdms(channels: dict[str, np.ndarray], properties: dict | None = None, segment: int | None = None, interleaved: bool = False, group: str = "g") -> bytes:
    """A segmented file of 64-bit floats: the root's properties and one group's channels, `segment` samples a segment."""

    def text(s: str) -> bytes:
        b = s.encode()
        return struct.pack("<I", len(b)) + b

    def described(p: dict) -> bytes:
        return struct.pack("<I", len(p)) + b"".join(text(k) + (struct.pack("<I", 0x20) + text(v) if isinstance(v, str) else struct.pack("<Id", 10, v)) for k, v in p.items())

    longest, out = max((len(x) for x in channels.values()), default=0), b""
    size = segment or max(1, longest)
    for a in range(0, max(1, longest), size):
        parts = {n: np.asarray(x, "<f8")[a : a + size] for n, x in channels.items()}
        meta = struct.pack("<I", 1 + len(parts)) + text("/") + struct.pack("<I", 0xFFFFFFFF) + described((properties or {}) if a == 0 else {})
        for n, x in parts.items():
            meta += text(f"/'{group}'/'{n}'") + struct.pack("<IIIQ", 20, 10, 1, len(x)) + described({})
        raw = np.column_stack(list(parts.values())).tobytes() if interleaved else b"".join(x.tobytes() for x in parts.values())
        out += b"TDSm" + struct.pack("<IIQQ", 2 | 4 | 8 | (32 if interleaved else 0), 4713, len(meta) + len(raw), len(meta)) + meta + raw
    return out


def write_npz(samples: DataFrame, folder: str) -> DataFrame:
    """file_name, signal, sample_rate and any string columns -> one container a row in the (shared) folder, through the store
    of its URI; returns file_name and bytes. A task that is tried again writes the same files anew.

    A row without name, signal or rate is an error. Lazy, as every DataFrame is: the files exist once the result is read.
    """
    extra = [c for c, k in samples.dtypes if k == "string" and c != "file_name"]
    return write_files(samples.select("file_name", "signal", "sample_rate", *extra), folder, lambda r: encode_npz(r["signal"], r["sample_rate"], **{c: r[c] for c in extra}))


def write_files(samples: DataFrame, folder: str, encode: Callable[[dict], bytes]) -> DataFrame:
    """One file a row, named by file_name, of what encode(row) gives; as write_npz otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            sizes = []
            for r in b.to_pylist():
                data = encode(r)
                with store.open_output_stream(f"{root}/{r['file_name']}") as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column("file_name"), pa.array(sizes, pa.int64())], names=["file_name", "bytes"])

    return samples.mapInArrow(run, "file_name string, bytes long")
