"""Zarr stores (version 2) of diagnostics or any grid: a sink with a task a chunk, and a source with a partition a chunk.

A store is a folder: .zgroup, .zmetadata, and for every array a folder with .zarray, .zattrs and one file a chunk. Axes are
arrays of one dimension. Chunks are plain, zlib or gzip; other compressors, filters and orders are refused.

    spark.dataSource.register(zarr.ZarrSource)
    spark.read.format("zarr2").option("variables", "ti1,f3d").load("store")
"""

from __future__ import annotations

import gzip
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product
from math import ceil, prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from aerolith.schema import CELL, LAT, LEVEL, LON, TIME
from aerolith.sources import arrays, files

#: Fixed: the name of the attribute that holds an array's dimensions, and how times are written.
DIMENSIONS = "_ARRAY_DIMENSIONS"
EPOCH = {"units": "microseconds since 1970-01-01 00:00:00", "calendar": "proleptic_gregorian"}
#: Chunk lengths of the sink: one time, levels and cells up to these.
CHUNKS = {TIME: 1, LEVEL: 64, LAT: 256, LON: 512}
#: Rows of an axis up to which it is broadcast to number the cells.
BROADCAST_ROWS = 1 << 20


class Store:
    """A folder of small files by name."""

    def __init__(self, path: str) -> None:
        self.system, self.at = arrays.located(path)
        self.at = self.at.rstrip("/")

    def get(self, name: str) -> bytes | None:
        if self.system.get_file_info(f"{self.at}/{name}").type != fs.FileType.File:
            return None
        with self.system.open_input_file(f"{self.at}/{name}") as file:
            return file.read()

    def put(self, name: str, data: bytes) -> None:
        """Whole or not at all: several attempts of a task may write the same file."""
        folder, _, last = f"{self.at}/{name}".rpartition("/")
        part = f"{folder}/.{last}.{uuid.uuid4().hex}"
        self.system.create_dir(folder, recursive=True)
        with self.system.open_output_stream(part) as file:
            file.write(data)
        self.system.move(part, f"{folder}/{last}")


@dataclass(frozen=True)
class Array:
    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    fill: object
    attrs: dict
    compressor: str | None
    separator: str = "."

    def counts(self) -> tuple[int, ...]:
        return tuple(ceil(n / c) for n, c in zip(self.shape, self.chunks, strict=True))


def opened(store: Store) -> dict[str, Array]:
    """The store's arrays by name."""
    held = store.get(".zmetadata")
    if held is not None:
        meta = json.loads(held)["metadata"]
    else:
        if store.get(".zgroup") is None:
            raise FileNotFoundError(f"no Zarr store in {store.at}")
        names = [x.base_name for x in store.system.get_file_info(fs.FileSelector(store.at)) if x.type == fs.FileType.Directory]
        meta = {f"{n}/{k}": json.loads(x) for n in names for k in (".zarray", ".zattrs") if (x := store.get(f"{n}/{k}")) is not None}
    out = {}
    for key, z in meta.items():
        name, _, kind = key.rpartition("/")
        if kind != ".zarray":
            continue
        attrs = dict(meta.get(f"{name}/.zattrs", {}))
        compressor = (z["compressor"] or {}).get("id")
        if z["zarr_format"] != 2 or z.get("filters") or z["order"] != "C" or compressor not in (None, "zlib", "gzip"):
            raise ValueError(f"{name}: format {z['zarr_format']}, filters {z.get('filters')}, order {z['order']}, compressor {compressor} are not read")
        dims = tuple(attrs.pop(DIMENSIONS, [f"dim_{i}" for i in range(len(z["shape"]))]))
        fill = z["fill_value"]
        if isinstance(fill, str) and np.dtype(z["dtype"]).kind == "f":
            fill = float(fill.replace("Infinity", "inf"))
        out[name] = Array(name, dims, tuple(z["shape"]), tuple(z["chunks"]), z["dtype"], fill, attrs, compressor, z.get("dimension_separator", "."))
    return out


def chunk(store: Store, a: Array, which: tuple[int, ...]) -> np.ndarray:
    """The cells of a chunk that lie in the array; all fill values if there is no file."""
    data = store.get(f"{a.name}/{a.separator.join(map(str, which)) if which else '0'}")
    form = np.dtype(a.dtype)
    if data is None:
        full = np.full(a.chunks, 0 if a.fill is None else a.fill, form)
    else:
        data = zlib.decompress(data) if a.compressor == "zlib" else gzip.decompress(data) if a.compressor == "gzip" else data
        full = np.frombuffer(data, form).reshape(a.chunks)
    return full[tuple(slice(0, min(c, n - k * c)) for k, c, n in zip(which, a.chunks, a.shape, strict=True))]


def whole(store: Store, a: Array) -> np.ndarray:
    out = np.empty(a.shape, np.dtype(a.dtype))
    for which in product(*map(range, a.counts())):
        out[tuple(slice(k * c, (k + 1) * c) for k, c in zip(which, a.chunks, strict=True))] = chunk(store, a, which)
    return out


def chosen(held: dict[str, Array], wanted: Iterable[str] | None) -> tuple[list[Array], Array]:
    """The wanted arrays and the first of them; all have its dimensions, shape and chunks."""
    axes = {n for n, a in held.items() if a.dims == (n,)}
    names = list(wanted) if wanted is not None else [n for n in held if n not in axes]
    if missing := [n for n in names if n not in held]:
        raise ValueError(f"the store lacks {missing}")
    found = [held[n] for n in names]
    if wanted is None and found:
        most = max((a.dims for a in found), key=len)
        found = [a for a in found if a.dims == most]
    if not found:
        raise ValueError("no array is wanted")
    if odd := [a.name for a in found if (a.dims, a.shape, a.chunks) != (found[0].dims, found[0].shape, found[0].chunks)]:
        raise ValueError(f"{odd} differ from {found[0].name} in dimensions, shape or chunks")
    return found, found[0]


def _attrs(a: Array) -> dict:
    """Attributes for decoding; a fill value of a number without scale is a missing one."""
    return a.attrs | ({"_FillValue": a.fill} if a.fill is not None and np.dtype(a.dtype).kind == "f" and "_FillValue" not in a.attrs else {})


@dataclass
class Chunks(InputPartition):
    """Chunks that one task reads one after the other, by their places."""

    which: list[tuple[int, ...]]


class ZarrSource(DataSource):
    """See the module. Option variables: names, by commas; else all arrays over the largest set of dimensions."""

    @classmethod
    def name(cls) -> str:
        return "zarr2"

    @property
    def wanted(self) -> list[str] | None:
        names = self.options.get("variables")
        return None if names is None else [x.strip() for x in names.split(",") if x.strip()]

    def schema(self) -> str:
        held = opened(Store(self.options["path"]))
        found, first = chosen(held, self.wanted)
        at = lambda d: arrays.kind(np.dtype(held[d].dtype), held[d].attrs) if d in held else "long"
        return ", ".join(f"`{n}` {k}" for n, k in [*((d, at(d)) for d in first.dims), *((a.name, arrays.kind(np.dtype(a.dtype), a.attrs)) for a in found)])

    def reader(self, schema) -> DataSourceReader:
        return ZarrReader(self.options["path"], self.wanted, schema.names)


class ZarrReader(DataSourceReader):
    def __init__(self, path: str, wanted: list[str] | None, names: list[str]) -> None:
        self.path, self.wanted, self.names = path, wanted, names
        self.held = opened(Store(path))

    def partitions(self) -> list[Chunks]:
        _, first = chosen(self.held, self.wanted)
        return [Chunks(w) for w in arrays.packed(list(product(*map(range, first.counts()))), prod(first.chunks))]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        store = Store(self.path)
        found, first = chosen(self.held, self.wanted)
        axes = {d: arrays.decoded(whole(store, self.held[d]), self.held[d].attrs) for d in first.dims if d in self.held}  # once a task
        for which in partition.which:
            values = {a.name: chunk(store, a, which) for a in found}
            shape = values[first.name].shape
            index = arrays.grid_index(shape, 0, prod(shape))
            out = {}
            for d, k, c, at in zip(first.dims, which, first.chunks, index, strict=True):
                at = at + k * c
                out[d] = arrays.taken(axes[d], at) if d in axes else pa.array(at.astype(np.int64))
            out |= {a.name: arrays.decoded(values[a.name], _attrs(a)) for a in found}
            yield pa.RecordBatch.from_pydict(out).select(self.names)


def read_zarr(spark: SparkSession, path: str, names: Iterable[str] | None = None) -> DataFrame:
    """Coordinates and the named arrays; only their chunks are read. A cell without a value is null."""
    spark.dataSource.register(ZarrSource)
    reader = spark.read.format("zarr2")
    return (reader if names is None else reader.option("variables", ",".join(names))).load(path)


def write_zarr(wide: DataFrame, path: str, names: list[str], chunks: dict[str, int] | None = None, compressor: str | None = "zlib", axes: list[str] = CELL) -> None:
    """The named columns of a grid as arrays over its axes; a store that is there is replaced.

    The grid is dealt by chunk, and a task writes the files of its chunks. An axis is its distinct values, rising; a time
    axis is whole microseconds. Cells without a row, and nulls, are NaN. Of several rows of a cell one stays.
    """
    spark, lengths = wide.sparkSession, CHUNKS | (chunks or {})
    wide = files.written(wide.select(*axes, *names))  # read once an axis and once for the chunks
    held = {a: [r[0] for r in wide.select(a).where(F.col(a).isNotNull()).distinct().orderBy(a).collect()] for a in axes}  # as long as an axis
    times = {a for a in axes if wide.schema[a].dataType.simpleString().startswith("timestamp")}
    shape = tuple(len(held[a]) for a in axes)
    size = tuple(min(lengths.get(a, n), n) or 1 for a, n in zip(axes, shape, strict=True))
    store = Store(path)
    if store.system.get_file_info(store.at).type == fs.FileType.Directory:
        store.system.delete_dir(store.at)
    meta: dict[str, dict] = {".zgroup": {"zarr_format": 2}, ".zattrs": {}}
    pack = (lambda x: zlib.compress(x, 1)) if compressor == "zlib" else (lambda x: x)
    array = lambda n, of, form, fill: {"zarr_format": 2, "shape": list(n), "chunks": list(of), "dtype": form, "compressor": {"id": "zlib", "level": 1} if compressor else None, "fill_value": fill, "order": "C", "filters": None}
    for a, n in zip(axes, shape, strict=True):
        x = np.array(held[a], "datetime64[us]").astype("<i8") if a in times else np.array(held[a], "<f8")
        meta[f"{a}/.zarray"] = array((n,), (max(n, 1),), x.dtype.str, None)
        meta[f"{a}/.zattrs"] = {DIMENSIONS: [a]} | (EPOCH if a in times else {})
        store.put(f"{a}/0", pack(x.tobytes()))
    for n in names:
        meta[f"{n}/.zarray"] = array(shape, size, "<f8", "NaN")
        meta[f"{n}/.zattrs"] = {DIMENSIONS: list(axes)}
    indexed = wide.select(*axes, *names)
    for i, (a, n) in enumerate(zip(axes, shape, strict=True)):
        numbers = spark.createDataFrame(list(enumerate(held[a])), f"_i{i} int, `{a}` {wide.schema[a].dataType.simpleString()}")
        indexed = indexed.join(F.broadcast(numbers) if n <= BROADCAST_ROWS else numbers, a).withColumn(f"_k{i}", (F.col(f"_i{i}") / size[i]).cast("int"))
    keys, inside = [f"_k{i}" for i in range(len(axes))], [f"_i{i}" for i in range(len(axes))]

    def put(key: tuple, rows):
        at = tuple(rows[c].to_numpy() - k * s for c, k, s in zip(inside, key, size, strict=True))
        for n in names:
            full = np.full(size, np.nan)
            full[at] = rows[n].to_numpy(dtype=np.float64, na_value=np.nan)
            Store(path).put(f"{n}/{'.'.join(str(int(k)) for k in key)}", pack(full.tobytes()))
        return pd.DataFrame({"n": [len(rows)]})

    indexed.select(*keys, *inside, *names).groupBy(*keys).applyInPandas(put, "n long").agg(F.sum("n")).first()
    for key, value in meta.items():
        store.put(key, json.dumps(value, indent=1).encode())
    store.put(".zmetadata", json.dumps({"zarr_consolidated_format": 1, "metadata": meta}, indent=1).encode())
