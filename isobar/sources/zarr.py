"""Chunked arrays (Zarr, version 2) as a Spark source.

``open_store(spark, path, ["t", "u"], {"level": (850, 850)})`` gives a row a cell:
the coordinates of the variables' dimensions and the variables themselves.  The
driver reads the store's metadata and one-dimensional coordinates only.  A
partition is a chunk (or ``chunks`` of them); closed ranges of coordinates choose
the chunks that are opened and the rows taken of them.  Ranges are an option of
the read, not pushed filters: Spark 4.1 keeps filters that were pushed into a
Python source for later uses of the same DataFrame, which would then lack rows.

Defined results: the fill value, ``_FillValue``, ``missing_value`` and NaN are
null; a chunk that isn't stored is all fill; ``scale_factor`` and ``add_offset``
give doubles; times ("... since ...") are timestamps without zone, of the standard
calendars, or of 365 days (29 February never comes).  Descending coordinates are
as good as ascending ones.  All variables of a read must have the same
dimensions, shape and chunks; read others on their own and join them
(``merge_stores``).  Compressors: none, zlib, gzip, zstd; filters and others are an
error.  Paths with a scheme go through ``pyarrow.fs``.
"""

from __future__ import annotations

import datetime as dt
import gzip
import itertools
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, FloatType, LongType, StructField, StructType, TimestampNTZType

#: Rows of an Arrow batch at most, and chunks of a partition.
BATCH_ROWS = 1 << 16
_EPOCH = dt.datetime(1970, 1, 1)
_UNIT = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1000, "microsecond": 1}


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    fs, at = pafs.FileSystem.from_uri(path) if re.match(r"^[a-z][a-z0-9+.-]*:/", path) else (pafs.LocalFileSystem(), path)
    return fs, at.rstrip("/")


def _bytes(fs: pafs.FileSystem, path: str) -> bytes | None:
    """A file's content; None if there is no such file."""
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(path) as f:
        return f.read()


@dataclass
class Array:
    """What ``.zarray`` and ``.zattrs`` say of one array."""

    name: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    kind: np.dtype
    fill: float | int | str | None
    codec: str | None
    order: str
    separator: str
    dims: list[str] = field(default_factory=list)
    attrs: dict = field(default_factory=dict)

    @classmethod
    def of(cls, name: str, head: dict, attrs: dict) -> Array:
        if head.get("filters"):
            raise ValueError(f"{name}: filters aren't supported")
        codec = (head.get("compressor") or {}).get("id")
        if codec not in (None, "zlib", "gzip", "zstd"):
            raise ValueError(f"{name}: compressor {codec} isn't supported")
        dims = attrs.get("_ARRAY_DIMENSIONS") or [f"{name}_{i}" for i in range(len(head["shape"]))]
        return cls(name, tuple(head["shape"]), tuple(head["chunks"]), np.dtype(head["dtype"]), head.get("fill_value"), codec, head.get("order", "C"), head.get("dimension_separator", "."), dims, attrs)

    def chunk(self, fs: pafs.FileSystem, root: str, at: tuple[int, ...]) -> np.ndarray | None:
        """A chunk's values as stored, of the full chunk shape; None if it isn't stored."""
        raw = _bytes(fs, f"{root}/{self.name}/{self.separator.join(map(str, at)) or '0'}")
        if raw is None:
            return None
        if self.codec == "zlib":
            raw = zlib.decompress(raw)
        elif self.codec == "gzip":
            raw = gzip.decompress(raw)
        elif self.codec == "zstd":
            import zstandard

            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        return np.frombuffer(raw, self.kind).reshape(self.chunks, order=self.order)

    def whole(self, fs: pafs.FileSystem, root: str) -> np.ndarray:
        """All values of a one-dimensional array."""
        parts = [self.chunk(fs, root, (i,)) for i in range(-(-self.shape[0] // self.chunks[0]))]
        filled = [np.full(self.chunks, self._fill(), self.kind) if p is None else p for p in parts]
        return np.concatenate(filled)[: self.shape[0]] if filled else np.empty(0, self.kind)

    def _fill(self):
        return np.nan if self.fill in ("NaN", None) and self.kind.kind == "f" else 0 if self.fill is None else {"Infinity": np.inf, "-Infinity": -np.inf}.get(self.fill, self.fill)

    @property
    def scaled(self) -> bool:
        return "scale_factor" in self.attrs or "add_offset" in self.attrs

    def spark_type(self):
        if is_time(self):
            return TimestampNTZType()
        if self.scaled or self.kind.kind == "f" and self.kind.itemsize > 4:
            return DoubleType()
        return FloatType() if self.kind.kind == "f" else LongType()

    def arrow(self, values: np.ndarray) -> pa.Array:
        """Stored values as they are returned."""
        if is_time(self):
            micros, null = times(values, self)
            return pa.array(micros, pa.timestamp("us"), mask=null)
        null = np.isnan(values) if values.dtype.kind == "f" else np.zeros(values.shape, bool)
        marks = [m for m in (self.fill, self.attrs.get("_FillValue"), self.attrs.get("missing_value")) if m is not None and not isinstance(m, str)]
        for mark in marks:
            null = null | (values == np.asarray(mark).astype(values.dtype))
        if self.scaled:
            values = values.astype(float) * float(self.attrs.get("scale_factor", 1.0)) + float(self.attrs.get("add_offset", 0.0))
        kind = {DoubleType: pa.float64(), FloatType: pa.float32(), LongType: pa.int64()}[type(self.spark_type())]
        return pa.array(np.ascontiguousarray(values).astype(kind.to_pandas_dtype()), kind, mask=null)


def is_time(a: Array) -> bool:
    return a.kind.kind == "M" or " since " in str(a.attrs.get("units", ""))


def times(values: np.ndarray, a: Array) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds since 1970, and which are missing."""
    if a.kind.kind == "M":
        return values.astype("datetime64[us]").astype(np.int64), np.isnat(values)
    unit, start = re.match(r"(\w+?)s? since (.*)", a.attrs["units"]).groups()
    y, m, d, *clock = [int(x) for x in re.findall(r"\d+", start.split(".")[0])][:6]
    null = np.isnan(values) if values.dtype.kind == "f" else np.zeros(values.shape, bool)
    step = np.round(np.where(null, 0, values).astype(float) * _UNIT[unit.lower()]).astype(np.int64)
    calendar = a.attrs.get("calendar", "standard")
    base = dt.datetime(y, m, d, *clock)
    if calendar in ("standard", "gregorian", "proleptic_gregorian"):
        return step + (base - _EPOCH) // dt.timedelta(microseconds=1), null
    if calendar not in ("noleap", "365_day"):
        raise ValueError(f"calendar {calendar} isn't supported")
    day = 86_400_000_000
    before = np.cumsum([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30])
    first = (y * 365 + int(before[m - 1]) + d - 1) * day + ((base.hour * 60 + base.minute) * 60 + base.second) * 1_000_000
    days, rest = np.divmod(first + step, day)
    year, of_year = np.divmod(days, 365)
    month = np.searchsorted(before, of_year, "right")
    dates = (year - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (month - 1)
    return (dates.astype("datetime64[D]") + (of_year - before[month - 1])).astype("datetime64[us]").astype(np.int64) + rest, null


def read_meta(path: str) -> dict[str, Array]:
    """The arrays of a store, from its consolidated metadata if there is any."""
    fs, root = _fs(path)
    held = _bytes(fs, f"{root}/.zmetadata")
    if held is not None:
        found = json.loads(held)["metadata"]
        names = [k.removesuffix("/.zarray") for k in found if k.endswith("/.zarray")]
        return {n: Array.of(n, found[f"{n}/.zarray"], found.get(f"{n}/.zattrs", {})) for n in names}
    if fs.get_file_info(root).type != pafs.FileType.Directory:
        raise FileNotFoundError(path)
    out = {}
    for info in fs.get_file_info(pafs.FileSelector(root)):
        head = _bytes(fs, f"{info.path}/.zarray") if info.type == pafs.FileType.Directory else None
        if head is not None:
            attrs = _bytes(fs, f"{info.path}/.zattrs")
            out[info.base_name] = Array.of(info.base_name, json.loads(head), json.loads(attrs) if attrs else {})
    return out


# --- the source -------------------------------------------------------------------


@dataclass
class Chunks(InputPartition):
    """Chunk positions and, by dimension, the places taken of each."""

    held: list[tuple[tuple[int, ...], list[np.ndarray]]]


def _chosen(options: dict) -> tuple[list[Array], dict[str, Array]]:
    meta = read_meta(options["path"])
    coordinates = {n: a for n, a in meta.items() if a.dims == [n]}
    asked = [v.strip() for v in options["variables"].split(",")] if options.get("variables") else [n for n in sorted(meta) if n not in coordinates]
    if missing := [v for v in asked if v not in meta]:
        raise LookupError(f"no array {missing} in {options['path']}")
    arrays = [meta[v] for v in asked]
    if not arrays or len({(tuple(a.dims), a.shape, a.chunks) for a in arrays}) > 1:
        raise ValueError(f"variables of one read must share dimensions, shape and chunks: {asked}")
    return arrays, {d: coordinates[d] for d in arrays[0].dims if d in coordinates}


class ZarrReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.each = options["path"], int(options.get("chunks", "1"))
        self.arrays, self.coordinates = _chosen(options)
        self.ranges: dict[str, list] = json.loads(options.get("ranges", "{}"))
        if unknown := set(self.ranges) - set(self.arrays[0].dims):
            raise LookupError(f"no dimension {sorted(unknown)}; there are {self.arrays[0].dims}")

    def _kept(self, name: str, size: int) -> np.ndarray:
        """Which places of a dimension lie in its range; a missing coordinate lies in none."""
        if name not in self.ranges:
            return np.ones(size, bool)
        a, values, known = self.coordinates.get(name), np.arange(size), np.ones(size, bool)
        low, high = self.ranges[name]
        if a is not None:
            fs, root = _fs(self.path)
            column = a.arrow(a.whole(fs, root))
            known = ~column.is_null().to_numpy(zero_copy_only=False)
            values = (column.cast(pa.int64()) if is_time(a) else column).fill_null(0).to_numpy(zero_copy_only=False)
            if is_time(a):
                low, high = (None if v is None else (dt.datetime.fromisoformat(v) - _EPOCH) // dt.timedelta(microseconds=1) for v in (low, high))
        return known & (values >= low if low is not None else True) & (values <= high if high is not None else True)

    def partitions(self) -> list[InputPartition]:
        a = self.arrays[0]
        by_dim = []
        for name, size, step in zip(a.dims, a.shape, a.chunks, strict=True):
            places = np.flatnonzero(self._kept(name, size))
            by_dim.append([(int(c), places[places // step == c]) for c in np.unique(places // step)])
        held = [(tuple(c for c, _ in pick), [p for _, p in pick]) for pick in itertools.product(*by_dim)]
        return [Chunks(held[i : i + self.each]) for i in range(0, len(held), self.each)]

    def read(self, partition: Chunks | None) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(self.path)
        first = self.arrays[0]
        axis = {n: a.whole(fs, root) for n, a in self.coordinates.items()}
        for at, places in partition.held if partition else []:  # no chunk is left: Spark asks once, with None
            inner = [p - c * step for p, c, step in zip(places, at, first.chunks, strict=True)]
            cells = int(np.prod([len(p) for p in places])) if places else 1
            stored = [a.chunk(fs, root, at) for a in self.arrays]
            fields = [np.full(cells, a._fill(), a.kind) if v is None else v[np.ix_(*inner)].ravel() if inner else v.ravel() for a, v in zip(self.arrays, stored, strict=True)]
            grid = np.unravel_index(np.arange(cells), [len(p) for p in places]) if places else []
            for lo in range(0, cells, BATCH_ROWS):
                hi = min(cells, lo + BATCH_ROWS)
                columns = []
                for name, p, g in zip(first.dims, places, grid, strict=True):
                    own = p[g[lo:hi]]
                    columns.append(self.coordinates[name].arrow(axis[name][own]) if name in axis else pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays([*columns, *[a.arrow(v[lo:hi]) for a, v in zip(self.arrays, fields, strict=True)]], [*first.dims, *[a.name for a in self.arrays]])


class ZarrDataSource(DataSource):
    """Format "zarr"; options path, variables (comma-separated; default all but coordinates), ranges (JSON), chunks (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "zarr"

    def schema(self) -> StructType:
        arrays, coordinates = _chosen(self.options)
        dims = [StructField(d, coordinates[d].spark_type() if d in coordinates else LongType()) for d in arrays[0].dims]
        return StructType([*dims, *[StructField(a.name, a.spark_type()) for a in arrays]])

    def reader(self, schema: StructType) -> ZarrReader:
        return ZarrReader(self.options)


def open_store(spark: SparkSession, path: str, variables: list[str] | None = None, ranges: dict[str, tuple] | None = None, chunks: int = 1) -> DataFrame:
    """Cells of a store inside of closed ``ranges`` of coordinates (times as datetimes; None leaves a side open)."""
    spark.dataSource.register(ZarrDataSource)
    plain = {d: [v.isoformat() if isinstance(v, dt.date) else v for v in pair] for d, pair in (ranges or {}).items()}
    reader = spark.read.format("zarr").option("chunks", str(chunks)).option("ranges", json.dumps(plain))
    return (reader.option("variables", ",".join(variables)) if variables else reader).load(path)


def levels(path: str, name: str) -> list[float]:
    """The values of a coordinate."""
    fs, root = _fs(path)
    a = read_meta(path)[name]
    return a.arrow(a.whole(fs, root)).to_pylist()


def nearest_level(path: str, name: str, wanted: float, tolerance: float) -> dict[str, tuple]:
    """The range of ``open_store`` that takes the level nearest to ``wanted`` (ties: the first); LookupError beyond ``tolerance``."""
    held = [v for v in levels(path, name) if v is not None]
    best = min(held, key=lambda v: abs(v - wanted), default=None)
    if best is None or abs(best - wanted) > tolerance:
        raise LookupError(f"no {name} within {tolerance} of {wanted}")
    return {name: (best, best)}


def newest(spark: SparkSession, pattern: str) -> str:
    """Of the folders that match ``pattern`` the one whose last part (a version) is greatest; LookupError if none does."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)  # noqa: SLF001
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)  # noqa: SLF001
    paths = [f.getPath().toString() for f in found or []]
    if not paths:
        raise LookupError(f"nothing matches {pattern}")
    return max(paths, key=lambda p: p.rstrip("/").rsplit("/", 1)[1])


def merge_stores(frames: list[DataFrame], on: list[str], how: str = "full") -> DataFrame:
    """Stores side by side on their coordinates; of a variable that several have the first that isn't null."""
    out = frames[0]
    for other in frames[1:]:
        shared = [c for c in other.columns if c in out.columns and c not in on]
        side = other.withColumnsRenamed({c: f"_other_{c}" for c in shared})
        both = out.join(side, on, how)
        out = both.select(*[F.coalesce(c, f"_other_{c}").alias(c) if c in shared else F.col(c) for c in both.columns if not c.startswith("_other_")])
    return out
