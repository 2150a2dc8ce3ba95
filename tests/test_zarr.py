"""The chunked-array source on stores written here."""

import datetime as dt
import gzip
import json
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from isobar.sources import zarr

PACK = {None: bytes, "zlib": zlib.compress, "gzip": gzip.compress, "zstd": lambda b: zstandard.ZstdCompressor().compress(b)}


def write(root, name, values, chunks, dims, codec="zlib", fill=None, order="C", separator=".", kind=None, skip=(), **attrs):
    at = root / name
    at.mkdir(parents=True)
    kind = np.dtype(kind or values.dtype)
    head = {"zarr_format": 2, "shape": list(values.shape), "chunks": list(chunks), "dtype": kind.str, "compressor": codec and {"id": codec}, "fill_value": fill, "order": order, "filters": None, "dimension_separator": separator}
    (at / ".zarray").write_text(json.dumps(head))
    (at / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims, **attrs}))
    for c in np.ndindex(*[-(-n // k) for n, k in zip(values.shape, chunks, strict=True)]):
        if c in skip:
            continue
        part = np.zeros(chunks, kind)
        own = values[tuple(slice(i * k, (i + 1) * k) for i, k in zip(c, chunks, strict=True))]
        part[tuple(slice(0, n) for n in own.shape)] = own
        file = at / separator.join(map(str, c))
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(PACK[codec](part.astype(kind).tobytes(order=order)))


@pytest.fixture
def store(tmp_path):
    root = tmp_path / "s.zarr"
    rng = np.random.default_rng(0)
    t = rng.normal(size=(5, 3, 7, 6)).astype("f4")
    t[1, 2, 3, 4] = np.nan
    write(root, "time", np.arange(5) * 6, (5,), ["time"], units="hours since 1999-12-31 18:00:00", calendar="proleptic_gregorian")
    write(root, "level", np.array([1000.0, 850.0, 500.0]), (3,), ["level"], codec=None)
    write(root, "latitude", np.array([60.0, 50, 40, 30, 20, 10, 0]), (7,), ["latitude"], codec="zstd")
    write(root, "longitude", np.arange(6) * 10.0, (4,), ["longitude"])
    write(root, "t", t, (2, 1, 3, 4), ["time", "level", "latitude", "longitude"], codec="zstd", fill="NaN")
    packed = np.round((t.astype(float) + 10) / 0.01)
    write(root, "q", np.where(np.isnan(packed), -999, packed).astype("i2"), (2, 1, 3, 4), ["time", "level", "latitude", "longitude"], fill=-999, order="F", separator="/", scale_factor=0.01, add_offset=-10.0)
    return root, t


def rows(df):
    return {tuple(r)[:-1]: r[-1] for r in df.collect()}


def test_cells_are_those_of_the_array(spark, store):
    root, t = store
    df = zarr.open_store(spark, str(root), ["t"])
    assert df.dtypes == [("time", "timestamp_ntz"), ("level", "double"), ("latitude", "double"), ("longitude", "double"), ("t", "float")]
    got = rows(df)
    start = dt.datetime(1999, 12, 31, 18)
    expected = {(start + dt.timedelta(hours=6 * i), lv, la, lo): t[i, j, k, m] for i in range(5) for j, lv in enumerate((1000.0, 850.0, 500.0)) for k, la in enumerate(range(60, -1, -10)) for m, lo in enumerate(range(0, 60, 10))}
    assert got.keys() == expected.keys() and all(got[k] is None if np.isnan(v) else got[k] == v for k, v in expected.items())
    # Packed integers in Fortran order and nested folders, with a fill value.
    both = zarr.open_store(spark, str(root), ["t", "q"], chunks=5)
    assert both.rdd.getNumPartitions() == -(-3 * 3 * 3 * 2 // 5)
    assert both.where("abs(t - q) > 0.0051 OR (t IS NULL) <> (q IS NULL)").isEmpty() and both.where("q IS NULL").count() == 1
    assert dict(both.dtypes)["q"] == "double"


def test_ranges_choose_chunks(spark, store):
    root, t = store
    keep = {(0, 1, 1, 0), (0, 1, 1, 1)}
    for c in np.ndindex(3, 3, 3, 2):
        if c not in keep:
            (root / "t" / ".".join(map(str, c))).write_bytes(b"broken")
    box = {"level": (850, 850), "latitude": (25, 35), "time": (None, dt.datetime(1999, 12, 31, 23))}
    df = zarr.open_store(spark, str(root), ["t"], box)
    assert df.rdd.getNumPartitions() == 2
    got = rows(df)
    assert len(got) == 6 and got[dt.datetime(1999, 12, 31, 18), 850.0, 30.0, 50.0] == t[0, 1, 3, 5]
    # Filters on top are Spark's own; the frame is whole when it is used again.
    assert df.where("longitude > 20 AND t > -100").count() == 3 and df.count() == 6
    assert zarr.open_store(spark, str(root), ["t"], {"level": (7, 8)}).isEmpty()
    with pytest.raises(Exception, match="zstd"):
        zarr.open_store(spark, str(root), ["t"], {"level": (500, None)}).count()
    with pytest.raises(Exception, match="no dimension"):
        zarr.open_store(spark, str(root), ["t"], {"lev": (500, None)}).count()


def test_nearest_level_and_merge(spark, store):
    root, t = store
    df = zarr.open_store(spark, str(root), ["t"])
    one = zarr.open_store(spark, str(root), ["t"], zarr.nearest_level(str(root), "level", 499.5, 1.0))
    assert one.count() == 5 * 42 and one.rdd.getNumPartitions() == 18
    with pytest.raises(LookupError):
        zarr.nearest_level(str(root), "level", 700.0, 50.0)
    on = ["time", "level", "latitude", "longitude"]
    early, late = df.where("time <= timestamp_ntz'2000-01-01 06:00:00'"), df.where("time > timestamp_ntz'2000-01-01 00:00:00'").withColumn("t", F.lit(9.0).cast("float")).withColumn("u", F.col("level"))
    both = zarr.merge_stores([early, late], on)
    assert both.count() == df.count() and both.where("t = 9").count() == 2 * 126 and both.where("u IS NULL").count() == 2 * 126


def test_missing_chunks_consolidated_metadata_and_errors(spark, tmp_path):
    root = tmp_path / "v.zarr"
    write(root, "x", np.arange(10, dtype="i4").reshape(5, 2), (2, 2), ["row", "col"], fill=-1, skip={(1, 0)})
    write(root, "odd", np.arange(3.0), (3,), ["odd_0"])
    got = {(r.row, r.col): r.x for r in zarr.open_store(spark, str(root), ["x"]).collect()}
    assert got == {(i, j): None if i in (2, 3) else 2 * i + j for i in range(5) for j in range(2)}
    heads = {f"{n}/{f}": json.loads((root / n / f).read_text()) for n in ("x", "odd") for f in (".zarray", ".zattrs")}
    (root / ".zmetadata").write_text(json.dumps({"zarr_consolidated_format": 1, "metadata": heads}))
    assert zarr.open_store(spark, str(root), ["x"], {"row": (4, 4)}).count() == 2
    for wrong in (["nothing"], ["x", "odd"], None):
        with pytest.raises(Exception, match="no array|share"):
            zarr.open_store(spark, str(root), wrong).count()
    bad = json.loads((root / "x/.zarray").read_text()) | {"compressor": {"id": "blosc"}}
    with pytest.raises(ValueError, match="blosc"):
        zarr.Array.of("x", bad, {})
    with pytest.raises(FileNotFoundError):
        zarr.read_meta(str(tmp_path / "none"))


def test_calendars():
    a = lambda calendar, units="days since 2000-02-27 12:00:00": zarr.Array("time", (4,), (4,), np.dtype("f8"), None, None, "C", ".", ["time"], {"units": units, "calendar": calendar})
    read = lambda calendar: [str(np.datetime64(int(v), "us"))[:13] for v in zarr.times(np.array([0.0, 1.0, 2.0, 367.25]), a(calendar))[0]]
    assert read("standard") == ["2000-02-27T12", "2000-02-28T12", "2000-02-29T12", "2001-02-28T18"]
    assert read("noleap") == ["2000-02-27T12", "2000-02-28T12", "2000-03-01T12", "2001-03-01T18"]
    with pytest.raises(ValueError, match="360_day"):
        read("360_day")
    raw = np.array(["2001-01-01", "NaT"], "M8[ns]")
    micros, null = zarr.times(raw, zarr.Array("t", (2,), (2,), raw.dtype, None, None, "C", ".", ["t"]))
    assert null.tolist() == [False, True] and micros[0] == 978307200000000


def test_newest_folder(spark, tmp_path):
    for v in ("v20190101", "v20210505", "v20200101"):
        (tmp_path / "model/r1" / v).mkdir(parents=True)
    assert zarr.newest(spark, f"{tmp_path}/model/*/v*").endswith("v20210505")
    with pytest.raises(LookupError):
        zarr.newest(spark, f"{tmp_path}/none/*")
