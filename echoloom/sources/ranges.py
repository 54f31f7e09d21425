"""Recordings read by sample ranges: a Python data source that plans ranges from the files' headers.

A recording of any length is many partitions, each of which reads only its own samples and a margin on both sides (what
filters and windows that begin in the range need). Headers name the places of samples as extents (first sample, count,
byte offset, bytes from sample to sample), so a range is a seek and a read through the store of the file's URI. Small
recordings share a partition. A compressed container can't be entered in the middle: it is one partition that streams its
ranges, of which it holds one at a time.

    spark.dataSource.register(RecordingRanges)
    spark.read.format("recording_ranges").option("range_values", 1 << 20).option("after", 9_999).load("hdfs://.../runs")

A file whose header can't be read gives one row with its error. Nothing is unpickled. Signals are 64-bit floats.
"""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import decode as D

RANGE = "path string, channel_index int, channel_name string, first long, last long, total long, lead int, signal array<double>, sample_rate double, starttime string, arrival_time string, type string, status string, message string"
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
_SCHEMA = pa.schema([(n, _ARROW[k]) for n, k in (c.split() for c in RANGE.split(", "))])
#: Values (samples times channels) of one range, and files whose headers the planner reads at once.
RANGE_VALUES, HEADER_THREADS = 1 << 20, 16
#: Partitions made of small ranges, unless one would pass RANGE_VALUES values; files up to which the planner reads all headers.
PARTITIONS, PLANNED_FILES = 128, 256
#: Members of a container up to so many bytes are read as its description.
SMALL_MEMBER = 1 << 16


@dataclass
class Extent:
    """Samples `first` to `first + count` lie from byte `offset` on, `step` bytes apart."""

    first: int
    count: int
    offset: int
    step: int
    kind: str


@dataclass
class Group:
    """Channels that lie together: (index, name, byte within the step) each, over the same extents."""

    channels: list[tuple[int, str, int]]
    extents: list[Extent]
    total: int
    scale: float = 1.0
    member: str | None = None  # of a compressed container: offsets count from the member's first byte

    def within(self, a: int, b: int) -> Group:
        """The same with the extents of these samples only, as a range's task needs no others."""
        return replace(self, extents=[e for e in self.extents if e.first < b and e.first + e.count > a])


@dataclass
class Header:
    path: str
    groups: list[Group] = field(default_factory=list)
    rate: float | None = None
    starttime: str | None = None
    arrival_time: str | None = None
    type: str | None = None
    error: str | None = None


@dataclass
class Piece:
    """Ranges of one group of one file."""

    header: Header
    ranges: list[tuple[int, int]]


@dataclass
class Share(InputPartition):
    pieces: list[Piece]
    files: list[str] = field(default_factory=list)  # small ones, whose headers the task reads itself


def _store(uri: str):
    from pyarrow import fs

    if "://" in uri or uri.startswith("/"):
        return fs.FileSystem.from_uri(uri)
    # one slash after the scheme, as Spark names local files
    scheme, rest = uri.split(":", 1)
    return fs.FileSystem.from_uri(f"{scheme}://{rest}")


# ---- headers


def _npz_header(f, path: str) -> Header:
    with zipfile.ZipFile(f) as z:
        members = {i.filename.removesuffix(".npy"): i for i in z.infolist()}
        wave = members.get("phase_data")
        if wave is None:
            raise ValueError("phase_data is missing")
        got = {}
        for name, info in members.items():
            if name != "phase_data" and info.file_size <= SMALL_MEMBER:
                try:
                    got[name] = np.load(io.BytesIO(z.read(info)), allow_pickle=False)
                except ValueError:
                    continue
        with z.open(wave) as m:
            version = np.lib.format.read_magic(m)
            shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(m)
            start = m.tell()
    if kind.hasobject or kind.kind not in "iufb":
        raise ValueError("phase_data holds no plain numbers")
    rate = D._number(got.get("sample_rate"))
    if rate is None or rate <= 0:
        raise ValueError("sample_rate is missing or not positive")
    stored = wave.compress_type == zipfile.ZIP_STORED
    if stored:
        f.seek(wave.header_offset + 26)
        start += wave.header_offset + 30 + sum(np.frombuffer(f.read(4), "<u2").tolist())
    rows, width = (shape[0] if shape else 1), int(np.prod(shape[1:], dtype=np.int64)) if len(shape) > 1 else 1
    names = [str(x) for x in got["channel_names"].reshape(-1)] if "channel_names" in got and got["channel_names"].dtype.kind in "US" else []
    name = lambda c: names[c] if c < len(names) else f"ch{c}"
    size, member = kind.itemsize, None if stored else wave.filename
    if by_column and width > 1:
        groups = [Group([(c, name(c), 0)], [Extent(0, rows, start + c * rows * size, size, kind.str)], rows, 1.0, member) for c in range(width)]
    else:
        groups = [Group([(c, name(c), c * size) for c in range(width)], [Extent(0, rows, start, width * size, kind.str)], rows, 1.0, member)]
    folder = path.rsplit("/", 2)[-2] if path.count("/") > 1 else None
    return Header(path, groups, rate, D._text(got.get("starttime")), D._text(got.get("arrival_time")), D._text(got.get("type")) or folder)


def _bin_header(f, path: str) -> Header:
    points, rate = D.points_and_rate(path)
    size = f.size()
    if not size:
        raise ValueError("the file is empty")
    if size % 4 or size // 4 % points:
        raise ValueError(f"{size // 4} values are no multiple of {points} points")
    return Header(path, [Group([(c, f"ch{c}", 4 * c) for c in range(points)], [Extent(0, size // 4 // points, 0, 4 * points, "<i4")], size // 4 // points, D.PHASE_SCALE)], rate)


def _tdms_header(f, path: str, channel: str | None, fallback_rate: float | None) -> Header:
    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    places, properties = D.tdms_places(read, f.size())
    extents: list[Extent] = []
    name, short, rate, said = D.tdms_choice({n: sum(p[1] for p in v) for n, v in places.items()}, properties, path, channel, fallback_rate)
    first = 0
    for offset, count, step, kind in places[name]:
        last = extents[-1] if extents else None
        if last and last.kind == kind and last.step == step and last.offset + last.count * step == offset:
            last.count += count
        else:
            extents.append(Extent(first, count, offset, step, kind))
        first += count
    return Header(path, [Group([(0, short, 0)], extents, first)], rate, D._text(said.get("starttime")), D._text(said.get("arrival_time")), D._text(said.get("type")))


def read_header(path: str, channel: str | None = None, fallback_rate: float | None = None) -> Header:
    """Where a recording's samples lie; a failure is a header with its error."""
    try:
        store, inside = _store(path)
        with store.open_input_file(inside) as f:
            suffix = path.rsplit(".", 1)[-1].lower()
            if suffix == "npz":
                return _npz_header(f, path)
            if suffix == "bin":
                return _bin_header(f, path)
            if suffix == "tdms":
                return _tdms_header(f, path, channel, fallback_rate)
            raise ValueError("no reader for this suffix")
    except Exception as e:  # the row carries it
        return Header(path, error=f"{type(e).__name__}: {e}")


# ---- ranges


def cut(header: Header, values: int = RANGE_VALUES, before: int = 0, after: int = 0) -> list[Piece]:
    """A file's ranges of at most `values` values (one sample of all channels at least). Those of a compressed member stay together."""
    if header.error or not any(g.total for g in header.groups):
        return [Piece(header, [])]
    out = []
    for g in header.groups:
        size = max(1, values // len(g.channels))
        ranges = [(a, min(a + size, g.total)) for a in range(0, g.total, size)]
        if g.member:
            out.append(Piece(replace(header, groups=[g]), ranges))
        else:
            out += [Piece(replace(header, groups=[g.within(a - before, b + after)]), [(a, b)]) for a, b in ranges]
    return out


def _size(p: Piece) -> int:
    return sum(b - a for a, b in p.ranges) * len(p.header.groups[0].channels) if p.ranges else 1


def together(pieces: list[Piece]) -> list[Piece]:
    """Neighbouring ranges of one file over the same extents become one piece, which opens the file once."""
    out: list[Piece] = []
    for p in pieces:
        if out and p.ranges and out[-1].ranges and out[-1].header == p.header and not p.header.groups[0].member:
            out[-1] = Piece(p.header, [*out[-1].ranges, *p.ranges])
        else:
            out.append(p)
    return out


def shares(pieces: list[Piece], values: int = RANGE_VALUES) -> list[Share]:
    """Partitions of about `values` values, or of more where that gave over PARTITIONS of them: their number follows the
    data, not the size of a range. Small files and neighbouring ranges share one."""
    values = max(values, min(RANGE_VALUES, -(-sum(map(_size, pieces)) // PARTITIONS)))
    out, held, size = [], [], 0
    for p in pieces:
        n = _size(p)
        if held and size + n > values:
            out.append(Share(together(held)))
            held, size = [], 0
        held.append(p)
        size += n
    return [*out, Share(together(held))] if held else out


def dealt(files: list[tuple[str, int]]) -> list[Share]:
    """Partitions of whole small files (path, bytes), whose headers nobody has read."""
    most = max(1, min(8 * RANGE_VALUES, -(-sum(n for _, n in files) // PARTITIONS)))
    out, held, size = [], [], 0
    for path, n in files:
        if held and size + n > most:
            out.append(Share([], held))
            held, size = [], 0
        held.append(path)
        size += n
    return [*out, Share([], held)] if held else out


def _values(data: bytes, extent: Extent, group: Group) -> np.ndarray:
    """Samples by channels of whole steps of bytes."""
    kind = np.dtype(extent.kind)
    table = np.frombuffer(data, np.uint8)
    pad = -len(table) % extent.step  # the last sample of interleaved channels may end the file
    table = (np.concatenate([table, np.zeros(pad, np.uint8)]) if pad else table).reshape(-1, extent.step)
    out = np.empty((len(table), len(group.channels)))
    for k, (_, _, at) in enumerate(group.channels):
        out[:, k] = np.ascontiguousarray(table[:, at : at + kind.itemsize]).view(kind)[:, 0]
    return out * group.scale if group.scale != 1.0 else out


def _direct(f, group: Group, a: int, b: int) -> np.ndarray:
    parts = []
    width = max(at for _, _, at in group.channels)
    for e in group.extents:
        lo, hi = max(a, e.first), min(b, e.first + e.count)
        if lo < hi:
            f.seek(e.offset + (lo - e.first) * e.step)
            want = (hi - lo - 1) * e.step + width + np.dtype(e.kind).itemsize
            data = f.read(want)
            if len(data) < want:
                raise ValueError(f"the file ends within samples {lo} to {hi}")
            parts.append(_values(data, e, group))
    return np.concatenate(parts) if parts else np.zeros((0, len(group.channels)))


def _streamed(f, group: Group, spans: list[tuple[int, int]]) -> Iterator[np.ndarray]:
    """Overlapping ascending spans of a compressed member; what the next span shares with this one is kept."""
    (e,) = group.extents
    with zipfile.ZipFile(f) as z, z.open(group.member) as m:
        m.read(e.offset)
        held, start, end = np.zeros((0, len(group.channels))), 0, 0
        for a, b in spans:
            while end < b:
                n = min(b - end, max(1, (1 << 22) // e.step))
                data = m.read(n * e.step)
                if len(data) < n * e.step:
                    raise ValueError(f"the member ends within samples {end} to {end + n}")
                held, end = np.concatenate([held[max(0, a - start) :], _values(data, e, group)]), end + n
                start = end - len(held)
            yield held[a - start : b - start]


def _row(header: Header, status: str = "ok", message: str | None = None) -> dict:
    return {"path": header.path, "sample_rate": header.rate, "starttime": header.starttime, "arrival_time": header.arrival_time, "type": header.type, "status": status, "message": message}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    signals = [r.get("signal") for r in rows]
    offsets = pa.array([None if x is None else 0 for x in signals] + [0], pa.int32())
    if any(x is not None for x in signals):
        ends = np.cumsum([0 if x is None else len(x) for x in signals])
        offsets = pa.array([None if x is None else int(e) - len(x) for x, e in zip(signals, ends, strict=True)] + [int(ends[-1])], pa.int32())
    flat = np.concatenate([x for x in signals if x is not None]) if any(x is not None for x in signals) else np.zeros(0)
    columns = [pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float64())) if c.name == "signal" else pa.array([r.get(c.name) for r in rows], c.type) for c in _SCHEMA]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def read_piece(piece: Piece, before: int = 0, after: int = 0) -> Iterator[pa.RecordBatch]:
    """A batch per range, a row per channel, with up to `before` and `after` samples around it."""
    header = piece.header
    if header.error or not piece.ranges:
        yield _batch([_row(header, "failed", header.error or "no samples")])
        return
    group = header.groups[0]
    spans = [(max(0, a - before), min(group.total, b + after)) for a, b in piece.ranges]

    def rows(a: int, b: int, lo: int, wave: np.ndarray) -> pa.RecordBatch:
        return _batch([{**_row(header), "channel_index": c, "channel_name": n, "first": a, "last": b, "total": group.total, "lead": a - lo, "signal": np.ascontiguousarray(wave[:, k])} for k, (c, n, _) in enumerate(group.channels)])

    def failed(e: Exception) -> pa.RecordBatch:
        return _batch([_row(header, "failed", f"{type(e).__name__}: {e}")])

    left = 1 if group.member else len(spans)  # rows that a failure gives: one a range, or one for a stream that breaks
    try:
        store, inside = _store(header.path)
        with store.open_input_file(inside) as f:
            if group.member:
                for (a, b), (lo, _), wave in zip(piece.ranges, spans, _streamed(f, group, spans), strict=True):
                    yield rows(a, b, lo, wave)
                return
            for (a, b), span in zip(piece.ranges, spans, strict=True):
                try:
                    batch = rows(a, b, span[0], _direct(f, group, *span))
                except (OSError, ValueError) as e:
                    batch = failed(e)
                left -= 1
                yield batch
    except (OSError, ValueError, zipfile.BadZipFile) as e:
        for _ in range(left):
            yield failed(e)


def listed(path: str, pattern: str) -> list[tuple[str, int]]:
    """Files under a folder (or the one file) whose names match, in order, with their bytes."""
    from pyarrow import fs

    store, inside = _store(path)
    info = store.get_file_info(inside)
    scheme = path[: len(path.rstrip("/")) - len(inside.rstrip("/"))] if path.rstrip("/").endswith(inside.rstrip("/")) else ""
    if info.type == fs.FileType.File:
        return [(path, info.size or 0)]
    found = store.get_file_info(fs.FileSelector(inside, recursive=True))
    return sorted((scheme + i.path, i.size or 0) for i in found if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, pattern))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.values = int(options.get("range_values", RANGE_VALUES))
        self.before, self.after = int(options.get("before", 0)), int(options.get("after", 0))
        self.channel = options.get("channel")
        self.rate = float(options["fallback_rate"]) if options.get("fallback_rate") else None
        if self.values < 1 or self.before < 0 or self.after < 0:
            raise ValueError("range_values is 1 or more, before and after are 0 or more")

    def _pieces(self, path: str) -> list[Piece]:
        return cut(read_header(path, self.channel, self.rate), self.values, self.before, self.after)

    def partitions(self) -> list[Share]:
        files = listed(self.path, self.pattern)
        # of many files only those that fill a partition are cut here
        large = files if len(files) <= PLANNED_FILES else [f for f in files if f[1] > 8 * RANGE_VALUES]
        with ThreadPoolExecutor(HEADER_THREADS) as pool:
            planned = shares([p for c in pool.map(lambda f: self._pieces(f[0]), large) for p in c], self.values)
        return planned if large is files else planned + dealt([f for f in files if f[1] <= 8 * RANGE_VALUES])

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        for p in share.pieces if share is not None else ():
            yield from read_piece(p, self.before, self.after)
        for path in share.files if share is not None else ():
            for p in together(self._pieces(path)):
                yield from read_piece(p, self.before, self.after)


class RecordingRanges(DataSource):
    """Options: path (folder or file), pattern, range_values, before, after, channel and fallback_rate (of segmented files)."""

    @classmethod
    def name(cls) -> str:
        return "recording_ranges"

    def schema(self) -> str:
        return RANGE

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_ranges(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows of the ranges under a folder; options as in RecordingRanges."""
    spark.dataSource.register(RecordingRanges)
    reader = spark.read.format("recording_ranges")
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)


def ranges_of(files: DataFrame, values: int = RANGE_VALUES, before: int = 0, after: int = 0, channel: str | None = None, fallback_rate: float | None = None, tasks: int | None = None) -> DataFrame:
    """The same rows for a table of paths: where files are many, their headers are read by tasks and only the ranges are
    dealt anew, so that neither the driver nor one task sees all of them."""
    import pickle

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column("path").to_pylist():
                yield pa.RecordBatch.from_pydict({"piece": [pickle.dumps(x) for x in cut(read_header(p, channel, fallback_rate), values, before, after)]}, schema=pa.schema([("piece", pa.binary())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column("piece").to_pylist():
                yield from read_piece(pickle.loads(p), before, after)

    n = tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path").mapInArrow(plan, "piece binary").repartition(n).mapInArrow(read, RANGE)


def owned(signal: str = "signal"):
    """A range's own samples, without the margins."""
    return F.slice(signal, F.col("lead") + 1, (F.col("last") - F.col("first")).cast("int"))
