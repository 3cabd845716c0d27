"""NetCDF classic files, Zarr stores and the raw archive."""

import gzip
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith import cli
from aerolith.schema import CELL, GRID_VARIABLES, SHORT_NAMES
from aerolith.sources import archive, arrays, netcdf, readers, zarr
from aerolith.sources.lattice import lattice

SIZES = {"time": 3, "pressure_level": 2, "latitude": 4, "longitude": 5}
DIMS = tuple(SIZES)


def cube(seed, form="f4"):
    return np.random.default_rng(seed).normal(250, 20, tuple(SIZES.values())).astype(form)


def made(version=2, unlimited="time", names=SHORT_NAMES):
    t, first = cube(1), cube(0)
    t[0, 0, 0, 0], t[2, 1, 3, 4] = np.nan, -999.0
    packed = np.arange(120, dtype="i2").reshape(tuple(SIZES.values()))
    packed[1, 1, 1, 1] = -32767
    axes = [
        ("time", ("time",), np.array([0, 6, 12], "i4"), {"units": "hours since 2024-01-01 00:00:0.0", "calendar": "gregorian"}),
        ("pressure_level", ("pressure_level",), np.array([200.0, 300.0]), {}), ("latitude", ("latitude",), np.arange(4, dtype="f4") * 10, {"units": "degrees_north"}),
        ("longitude", ("longitude",), np.arange(5, dtype="f4") * 2, {}),
    ]
    fields = [(n, DIMS, cube(k), {}) for k, n in enumerate(names) if n not in ("t", "u")]
    fields += [("t", DIMS, t, {"_FillValue": np.float32(-999.0)}), ("u", DIMS, packed, {"scale_factor": 0.5, "add_offset": 10.0, "missing_value": np.int16(-32767)})]
    more = [("number", (), np.array(7, "i4"), {}), ("surface", ("latitude", "longitude"), np.arange(20, dtype="i1").reshape(4, 5), {})]
    return netcdf.encoded(SIZES, [*axes, *more, *fields], unlimited, version), {"t": t, "u": packed, "first": first}


@pytest.mark.parametrize(("version", "unlimited"), [(1, "time"), (2, None), (5, "time"), (5, None), (2, "time")])
def test_netcdf(spark, tmp_path, version, unlimited):
    data, held = made(version, unlimited)
    (tmp_path / "a.nc").write_bytes(data)
    for rows in (7, 20, 1000):  # parts of a latitude's cells, whole levels, whole files
        df = netcdf.read_netcdf(spark, str(tmp_path), ["t", "u", "surface", "number"], rows=rows)
        assert dict(df.dtypes) == {"time": "timestamp_ntz", "pressure_level": "double", "latitude": "double", "longitude": "double", "t": "double", "u": "double", "surface": "bigint", "number": "bigint"}
        found = {(str(r.time), r.pressure_level, r.latitude, r.longitude): r for r in df.collect()}
        assert len(found) == 120
        for i, p, a, o in np.ndindex(3, 2, 4, 5):
            r = found[(f"2024-01-01 {6 * i:02}:00:00", [200.0, 300.0][p], a * 10.0, o * 2.0)]
            t, u = held["t"][i, p, a, o], int(held["u"][i, p, a, o])
            assert r.t == (None if np.isnan(t) or t == -999 else float(t)) and r.u == (None if u == -32767 else u * 0.5 + 10)
            assert r.surface == 5 * a + o and r.number == 7


def test_netcdf_reads_only_what_is_wanted(tmp_path):
    (tmp_path / "a.nc").write_bytes(made()[0])
    source = arrays.Bytes(str(tmp_path / "a.nc"))
    held = netcdf.header(source)
    found, dims = netcdf.chosen(held, ["t"])
    before = source.taken
    part = netcdf.table(source, held, found, dims, 1, 2, 1)
    assert part.num_rows == 40 and source.taken - before == 40 * 4 + 3 * 4 + 2 * 8 + 4 * 4 + 5 * 4


def test_netcdf_undecoded_and_numbered(spark, tmp_path):
    (tmp_path / "b.nc").write_bytes(netcdf.encoded({"x": 3}, [("v", ("x",), np.array([1, -9, 3], "i2"), {"_FillValue": np.int16(-9), "scale_factor": 2.0})]))
    assert [tuple(r) for r in netcdf.read_netcdf(spark, str(tmp_path / "b.nc"), decode=False).collect()] == [(0, 1), (1, -9), (2, 3)]
    assert [tuple(r) for r in netcdf.read_netcdf(spark, str(tmp_path / "b.nc")).collect()] == [(0, 2.0), (1, None), (2, 6.0)]


def test_netcdf_errors(spark, tmp_path):
    good = made()[0]
    for name, data in (("hdf", b"\x89HDF\r\n\x1a\n" + b"0" * 99), ("cut", good[:200]), ("text", b"no such file")):
        with pytest.raises(ValueError):
            netcdf.header(arrays.Held(data))
    with pytest.raises(EOFError):
        source = arrays.Held(good[:-500])
        netcdf.whole(source, h := netcdf.header(source), h.variables["u"])
    h = netcdf.header(arrays.Held(good))
    with pytest.raises(ValueError, match="lacks"):
        netcdf.chosen(h, ["nonsense"])
    (tmp_path / "x.txt").write_text("")
    with pytest.raises(Exception, match="no \\*.nc"):
        netcdf.read_netcdf(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="calendar"):
        arrays.epoch_of({"units": "days since 1900-01-01", "calendar": "360_day"})


def test_streamed_records():
    """A file whose number of records was never filled in."""
    data, _ = made()
    h = netcdf.header(arrays.Held(data[:4] + b"\xff\xff\xff\xff" + data[8:]))
    assert h.sizes == SIZES


def test_raw_grid_from_netcdf(spark, tmp_path):
    (tmp_path / "a.nc").write_bytes(made()[0])
    grid = readers.open_grid(spark, str(tmp_path))
    assert grid.count() == 120 and set(GRID_VARIABLES) <= set(grid.columns)
    assert grid.where("temperature is null").count() == 2 and grid.where("pressure_level = 200").first().altitude == pytest.approx(11784, rel=1e-2)


@pytest.mark.parametrize("compressor", ["zlib", None])
def test_zarr_round_trip(spark, sf_dir, tmp_path, compressor):
    names = ["altitude", *GRID_VARIABLES]
    grid = lattice(spark, sf_dir).withColumn("vorticity", F.when(F.col("latitude") != 6, F.col("vorticity")))
    path = str(tmp_path / "s")
    for _ in range(2):  # the second replaces the first
        zarr.write_zarr(grid, path, names, {"time": 3, "latitude": 5}, compressor)
    back = zarr.read_zarr(spark, path, names)
    assert back.rdd.getNumPartitions() == 2 * 1 * 3 * 1
    columns = ["time", "pressure_level", "latitude", "longitude", *names]
    assert back.select(columns).exceptAll(grid.select(columns)).count() == 0 and back.count() == grid.count()
    assert readers.open_grid(spark, path).select(columns).exceptAll(grid.select(columns)).count() == 0


def test_zarr_reads_only_its_chunks(spark, sf_dir, tmp_path):
    path = tmp_path / "s"
    zarr.write_zarr(lattice(spark, sf_dir), str(path), ["vorticity", "temperature"])
    for file in (path / "temperature").iterdir():
        if not file.name.startswith(".z"):
            file.write_bytes(b"damaged")
    assert zarr.read_zarr(spark, str(path), ["vorticity"]).where("vorticity is null").count() == 0
    with pytest.raises(Exception, match="zlib|decompress|header"):
        zarr.read_zarr(spark, str(path), ["temperature"]).collect()
    with pytest.raises(Exception, match="lacks"):
        zarr.read_zarr(spark, str(path), ["nonsense"]).collect()
    with pytest.raises(Exception, match="no Zarr store"):
        zarr.read_zarr(spark, str(tmp_path)).collect()


def test_zarr_of_others(spark, tmp_path):
    """Arrays without consolidated metadata, a missing chunk, whole numbers, gzip; another compressor is refused."""
    s = zarr.Store(str(tmp_path / "z"))
    array = lambda shape, of, form, fill, comp=None: json.dumps({"zarr_format": 2, "shape": shape, "chunks": of, "dtype": form, "compressor": comp and {"id": comp}, "fill_value": fill, "order": "C", "filters": None}).encode()
    s.put(".zgroup", b'{"zarr_format": 2}')
    s.put("time/.zarray", array([3], [2], "<i4", None))
    s.put("time/.zattrs", b'{"_ARRAY_DIMENSIONS": ["time"], "units": "days since 2024-02-28"}')
    s.put("time/0", np.array([0, 1], "<i4").tobytes())
    s.put("time/1", np.array([2, 99], "<i4").tobytes())
    s.put("v/.zarray", array([3, 2], [2, 2], ">f4", -1.0, "gzip"))
    s.put("v/.zattrs", b'{"_ARRAY_DIMENSIONS": ["time", "x"]}')
    s.put("v/0.0", gzip.compress(np.array([[1, 2], [-1, 4]], ">f4").tobytes()))
    found = [(str(r.time)[:10], r.x, r.v) for r in zarr.read_zarr(spark, str(tmp_path / "z")).orderBy("time", "x").collect()]
    assert found == [("2024-02-28", 0, 1.0), ("2024-02-28", 1, 2.0), ("2024-02-29", 0, None), ("2024-02-29", 1, 4.0), ("2024-03-01", 0, None), ("2024-03-01", 1, None)]
    s.put("v/.zarray", array([3, 2], [2, 2], ">f4", -1.0, "blosc"))
    with pytest.raises(ValueError, match="blosc"):
        zarr.opened(s)


def hour_file(k, more=()):
    """Seven records: good, a bad flag, a bad error, a missing index, then three good ones."""
    n = 7
    flag = lambda bad: np.array([b"X" if i == bad else b"V" for i in range(n)], "S1")
    held = {
        "altitude": np.full(n, 9000.0 + k, "f4"), "latitude": np.arange(n, dtype="f4"), "longitude": np.arange(n, dtype="f4"), "maxEDR": np.linspace(0, 1, n).astype("f4"),
        "medEDR": np.linspace(0, 0.5, n).astype("f4"), "turbIndex": np.array([1, 1, 1, -99, 1, 1, 1], "i2"), "windSpeed": np.full(n, 30.0, "f4"), "flight": np.zeros(n, "i4"),
        "altitudeDD": flag(1), "maxEDRDD": flag(1), "turbulenceError": np.array([112, 112, 102, 112, 45, 45, 112], "i1"), "speedError": np.full(n, ord("p"), "i1"), **dict(more),
    }
    fields = [(name, ("recNum",), x, {"_FillValue": np.int16(-99)} if name == "turbIndex" else {}) for name, x in held.items()]
    fields += [("timeObs", ("recNum",), np.full(n, 1704067200.0 + 3600 * k), {"units": "seconds since 1970-1-1 00:00:00.0"})]
    fields += [("en_tailNumber", ("recNum", "tailLen"), np.array([f"N{i}".encode() for i in range(n)], "S5"), {})]
    return netcdf.encoded({"recNum": n, "tailLen": 5}, fields, "recNum")


def test_raw_archive(spark, tmp_path):
    tree, out = tmp_path / "in", tmp_path / "out"
    (tree / "2024" / "01").mkdir(parents=True)
    (tree / "2024" / "02").mkdir(parents=True)
    for k in range(3):
        (tree / "2024" / "01" / f"20240101_0{k}00.gz").write_bytes(gzip.compress(hour_file(k)[:500]) + gzip.compress(hour_file(k)[500:]))
    (tree / "2024" / "02" / "20240201_0000.gz").write_bytes(gzip.compress(hour_file(9, [("vertGust", np.ones(7, "f4"))])))
    cli.main(["data", "amdar", "preprocess", "-s", "acars", "-i", str(tree), "-o", str(out), "--glob-pattern", "**/*.gz"], spark)
    assert sorted(str(p.relative_to(out)) for p in out.glob("*/*/*")) == [f"2024/01/20240101_0{k}00.parquet" for k in range(3)] + ["2024/02/20240201_0000.parquet"]
    assert not (out / "_made").exists()
    for k in range(3):
        df = spark.read.parquet(str(out / "2024" / "01" / f"20240101_0{k}00.parquet"))
        rows = df.orderBy("latitude").collect()
        assert [r.latitude for r in rows] == [0, 4, 5, 6] and {r.altitude for r in rows} == {9000.0 + k} and {str(r.timeObs) for r in rows} == {f"2024-01-01 0{k}:00:00"}
        assert [r.en_tailNumber for r in rows] == ["N0", "N4", "N5", "N6"] and not {"flight", "altitudeDD", "speedError", "path"} & set(df.columns)
    acars = readers.read_acars(spark, str(out / "2024" / "01" / "*"))
    assert acars.count() == 12 and {"altitude", "maxEDR", "turbIndex", "timeObs"} <= set(acars.columns)
    # the same records through parquet
    plain = str(tmp_path / "plain")
    archive.read_raw(spark, [str(tree)]).drop("path").write.parquet(plain)
    cli.main(["data", "amdar", "preprocess", "-s", "acars", "-i", plain, "-o", str(tmp_path / "again"), "--glob-pattern", "*.parquet"], spark)
    again = spark.read.parquet(str(tmp_path / "again")).drop("date")
    every = spark.read.option("recursiveFileLookup", "true").parquet(str(out))
    assert set(again.columns) == set(every.columns) and again.select(every.columns).exceptAll(every).count() == 0 and again.count() == every.count() == 16
    one = str(tree / "2024" / "02" / "20240201_0000.gz")
    cli.main(["data", "amdar", "preprocess", "-s", "acars", "-i", one, "-o", str(tmp_path / "one")], spark)
    assert [p.name for p in (tmp_path / "one").iterdir()] == ["20240201_0000.parquet"]


def test_members_of_gzip():
    assert netcdf.inflated(gzip.compress(b"a" * 99) + gzip.compress(b"b")) == b"a" * 99 + b"b" and netcdf.inflated(b"CDF") == b"CDF"
    assert zlib.decompress(zlib.compress(b"")) == b""


def test_pieces_are_put_together_in_order():
    assert [len(x) for x in arrays.packed(list(range(6)), 10)] == [1] * 6
    many = arrays.packed(list(range(100_000)), 1000)
    assert sum(many, []) == list(range(100_000)) and max(map(len, many)) == arrays.PACKED // 1000
    assert len(arrays.packed(list(range(1000)), 1 << 20)) == 1000


def test_many_small_files_and_chunks_are_few_tasks(spark, tmp_path):
    grid = lattice(spark, "/root/testdata/sf0.001").select(*CELL, "altitude")
    zarr.write_zarr(grid, f"{tmp_path}/z", ["altitude"], {"pressure_level": 1, "latitude": 2, "longitude": 6})
    back = zarr.read_zarr(spark, f"{tmp_path}/z", ["altitude"])
    assert back.rdd.getNumPartitions() <= arrays.LEAST and back.exceptAll(grid).count() == 0 and back.count() == grid.count()
