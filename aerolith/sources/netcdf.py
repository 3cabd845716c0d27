"""NetCDF classic files (formats 1, 2 and 5) as tables: a Python data source, and an archive of compressed ones.

A file's arrays over the same dimensions are columns of one long table whose keys are the dimensions' coordinates. Only the
header is read to plan; a partition is a range of cells along the leading dimensions, and of its bytes only those of the
wanted variables are read, in runs.

    spark.dataSource.register(netcdf.NetcdfSource)
    spark.read.format("netcdf").option("variables", "t,u,v").load("folder")

Options: variables (names, by commas; all over the largest set of dimensions, if not given), pattern (of file names, *.nc),
rows (most rows of a partition), decode (true: by convention, scales, fill values and times). All files have the wanted
variables; each has its own axes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from aerolith.sources import arrays

#: Fixed: the format's numbers of types.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
_DIMENSIONS, _VARIABLES, _ATTRIBUTES = 10, 11, 12
#: Rows of a partition at most, if one run of the last dimensions is not longer.
ROWS = 1 << 18


@dataclass(frozen=True)
class Variable:
    """dims: without the last one of text. width: bytes of a text. stride: bytes from one record to the next, 0 without records."""

    name: str
    dims: tuple[str, ...]
    dtype: str
    attrs: dict
    begin: int
    stride: int = 0

    @property
    def kind(self) -> np.dtype:
        return np.dtype(self.dtype)


@dataclass(frozen=True)
class Header:
    sizes: dict[str, int]
    variables: dict[str, Variable]
    attrs: dict


class _Short(Exception):
    """The header goes on."""


class _Cursor:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 4
        if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
            raise ValueError("no netCDF classic file" + " (it is a netCDF-4 file)" * (data[:4] == b"\x89HDF"))
        self.wide, self.offset = data[3] == 5, ">i4" if data[3] == 1 else ">i8"

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise _Short
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str | None = None) -> int:
        form = form or (">i8" if self.wide else ">i4")
        return int(np.frombuffer(self.take(int(form[2:])), form)[0])

    def name(self) -> str:
        n = self.number()
        return self.take(n + -n % 4)[:n].decode()

    def items(self, tag: int) -> range:
        found, n = self.number(">i4"), self.number()
        if found not in (0, tag) or (not found and n):
            raise ValueError("the header is damaged")
        return range(n)

    def attributes(self) -> dict:
        out = {}
        for _ in self.items(_ATTRIBUTES):
            name, form, n = self.name(), np.dtype(TYPES[self.number(">i4")]), self.number()
            held = self.take(n * form.itemsize + -(n * form.itemsize) % 4)[: n * form.itemsize]
            out[name] = held.decode("utf-8", "replace").rstrip("\0") if form.kind == "S" else (x.tolist() if len(x := np.frombuffer(held, form)) != 1 else x[0].item())
        return out


def header(source: arrays.Bytes) -> Header:
    """What a file holds and where."""
    n = min(1 << 14, source.size)
    while True:
        try:
            return _parsed(source.read(0, n), source.size)
        except _Short:
            if n == source.size:
                raise ValueError("the header is cut off") from None
            n = min(4 * n, source.size)


def _parsed(data: bytes, size: int) -> Header:
    c = _Cursor(data)
    records = c.number()
    names, lengths, unlimited = [], [], None
    for k in c.items(_DIMENSIONS):
        names.append(c.name())
        lengths.append(c.number())
        unlimited = k if not lengths[-1] else unlimited
    attrs, found = c.attributes(), []
    for _ in c.items(_VARIABLES):
        name = c.name()
        of = [c.number() for _ in range(c.number())]
        its, form = c.attributes(), np.dtype(TYPES[c.number(">i4")])
        c.number()  # a size that is worked out instead, as it may not fit its field
        found.append((name, of, its, form, c.number(c.offset)))
    each = [prod(lengths[d] for d in of[1:]) * form.itemsize for _, of, _, form, _ in found if of and of[0] == unlimited]
    record = each[0] if len(each) == 1 else sum(x + -x % 4 for x in each)
    if unlimited is not None:
        begins = [begin for _, of, _, _, begin in found if of and of[0] == unlimited]
        if records < 0:  # a file that was being written to as a stream
            records = (size - min(begins)) // record if begins and record else 0
        lengths[unlimited] = records
    counted = {d for _, of, _, form, _ in found if form.kind != "S" for d in of} | {unlimited}
    variables = {}
    for name, of, its, form, begin in found:
        if text := form.kind == "S" and len(of) > 0 and of[-1] not in counted:  # the last dimension is a text's length
            form = np.dtype(f"S{max(lengths[of[-1]], 1)}")
        variables[name] = Variable(name, tuple(names[d] for d in (of[:-1] if text else of)), form.str, its, begin, record if of and of[0] == unlimited else 0)
    return Header(dict(zip(names, lengths, strict=True)), variables, attrs)


def values(source: arrays.Bytes, held: Header, v: Variable, begin: int, end: int, run: int = 1) -> np.ndarray:
    """The variable's runs begin to end, of run cells each, in row order."""
    form, at, stop = v.kind, begin * run, end * run
    if not v.stride:
        return np.frombuffer(source.read(v.begin + at * form.itemsize, (stop - at) * form.itemsize), form) if stop > at else np.zeros(0, form)
    inner, parts = prod(held.sizes[d] for d in v.dims[1:]), []  # cells of a record
    while at < stop:
        record, k = divmod(at, inner)
        m = min(inner - k, stop - at)
        parts.append(source.read(v.begin + record * v.stride + k * form.itemsize, m * form.itemsize))
        at += m
    return np.frombuffer(b"".join(parts), form)


def whole(source: arrays.Bytes, held: Header, v: Variable) -> np.ndarray:
    return values(source, held, v, 0, prod(held.sizes[d] for d in v.dims))


def chosen(held: Header, wanted: Iterable[str] | None) -> tuple[list[Variable], tuple[str, ...]]:
    """The wanted variables and the dimensions of their table: those of the variable that has most."""
    if wanted is None:
        most = max((v.dims for v in held.variables.values()), key=len, default=())
        found = [v for v in held.variables.values() if v.dims == most and v.name not in most]
    else:
        if missing := [n for n in wanted if n not in held.variables]:
            raise ValueError(f"the file lacks variables {missing}")
        found = [held.variables[n] for n in wanted]
        most = max((v.dims for v in found), key=len, default=())
    for v in found:
        if [d for d in most if d in v.dims] != list(v.dims):
            raise ValueError(f"dimensions {v.dims} of {v.name} are not among {most}, in this order")
    return found, most


def columns(held: Header, found: list[Variable], dims: tuple[str, ...], decode: bool = True) -> list[tuple[str, str]]:
    """(name, Spark's type) of the table's columns: coordinates, then variables; a dimension without coordinates is numbered."""
    at = lambda d: arrays.kind(held.variables[d].kind, held.variables[d].attrs, decode) if _is_axis(held, d) else "long"
    return [*((d, at(d)) for d in dims), *((v.name, arrays.kind(v.kind, v.attrs, decode)) for v in found if v.name not in dims)]


def _is_axis(held: Header, name: str) -> bool:
    return name in held.variables and held.variables[name].dims == (name,)


def table(source: arrays.Bytes, held: Header, found: list[Variable], dims: tuple[str, ...], begin: int = 0, end: int | None = None, leading: int = 0, decode: bool = True) -> pa.RecordBatch:
    """Rows of the runs begin to end; a run is all cells of one index of the first `leading` dimensions."""
    shape = [held.sizes[d] for d in dims]
    run = prod(shape[leading:])
    end = prod(shape[:leading]) if end is None else end
    index = dict(zip(dims, arrays.grid_index(shape, begin * run, end * run), strict=True))
    out = {}
    for d in dims:
        if _is_axis(held, d):
            out[d] = arrays.taken(arrays.decoded(whole(source, held, held.variables[d]), held.variables[d].attrs, decode), index[d])
        else:
            out[d] = pa.array(index[d].astype(np.int64))
    for v in (v for v in found if v.name not in dims):
        if v.dims == dims:
            out[v.name] = arrays.decoded(values(source, held, v, begin, end, run), v.attrs, decode)
        else:  # over some of the dimensions only
            at = np.ravel_multi_index([index[d] for d in v.dims], [held.sizes[d] for d in v.dims]) if v.dims else np.zeros((end - begin) * run, np.int64)
            out[v.name] = arrays.taken(arrays.decoded(whole(source, held, v), v.attrs, decode), at)
    return pa.RecordBatch.from_pydict(out)


@dataclass
class Range:
    path: str
    begin: int
    end: int
    leading: int


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads one after the other."""

    held: list[Range]


class NetcdfSource(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def _option(self, name: str, default: str | None = None) -> str | None:
        return self.options.get(name, default)

    def files(self) -> list[str]:
        found = arrays.listed(self._option("path"), self._option("pattern", "*.nc"))
        if not found:
            raise FileNotFoundError(f"no {self._option('pattern', '*.nc')} in {self._option('path')}")
        return found

    @property
    def wanted(self) -> list[str] | None:
        names = self._option("variables")
        return None if names is None else [x.strip() for x in names.split(",") if x.strip()]

    @property
    def decode(self) -> bool:
        return self._option("decode", "true").lower() == "true"

    def schema(self) -> str:
        source = arrays.Bytes(self.files()[0])
        held = header(source)
        source.close()
        return ", ".join(f"`{n}` {k}" for n, k in columns(held, *chosen(held, self.wanted), self.decode))

    def reader(self, schema) -> DataSourceReader:
        return NetcdfReader(self, schema.names)


class NetcdfReader(DataSourceReader):
    def __init__(self, source: NetcdfSource, names: list[str]) -> None:
        self.paths, self.wanted, self.decode = source.files(), source.wanted, source.decode
        self.rows, self.names = int(source._option("rows", str(ROWS))), names

    def partitions(self) -> list[Ranges]:
        out = []
        for path in self.paths:
            source = arrays.Bytes(path)
            held = header(source)
            source.close()
            _, dims = chosen(held, self.wanted)
            shape = [held.sizes[d] for d in dims]
            leading = next((k for k in range(len(shape)) if prod(shape[k:]) <= self.rows), len(shape))
            runs, step = prod(shape[:leading]), max(1, self.rows // max(prod(shape[leading:]), 1))
            out += [Range(path, k, min(k + step, runs), leading) for k in range(0, runs, step)] if prod(shape) else []
        return [Ranges(x) for x in arrays.packed(out, self.rows)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for part in partition.held:
            source = arrays.Bytes(part.path)
            held = header(source)
            found, dims = chosen(held, self.wanted)
            yield table(source, held, found, dims, part.begin, part.end, part.leading, self.decode).select(self.names)
            source.close()


def read_netcdf(spark: SparkSession, path: str, variables: Iterable[str] | None = None, pattern: str = "*.nc", rows: int = ROWS, decode: bool = True) -> DataFrame:
    """The files of a folder, or one file, as one table: coordinates and variables."""
    spark.dataSource.register(NetcdfSource)
    reader = spark.read.format("netcdf").option("pattern", pattern).option("rows", rows).option("decode", str(decode).lower())
    return (reader if variables is None else reader.option("variables", ",".join(variables))).load(path)


def inflated(data: bytes) -> bytes:
    """The bytes of a gzip file, of as many members as it has; other bytes as they are."""
    out = []
    while data[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        out += [one.decompress(data), one.flush()]
        data = one.unused_data
    return b"".join(out) if out else data


def read_archive(spark: SparkSession, paths: str | list[str], variables: dict[str, str], pattern: str = "*.gz", rows: int = ROWS) -> DataFrame:
    """(path, *variables) of every record of the compressed (or plain) files of a folder and its folders, or of some files.

    variables: names and Spark's types, of arrays over the files' one dimension of records, or texts over it. Those that a
    file lacks are null there, as files of an archive differ. A file is one row to Spark, which reads it from any store; its
    records come in batches of so many rows.
    """
    names = list(variables)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "timestamp_ntz": pa.timestamp("us")}
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                source = arrays.Held(inflated(content.as_py()))
                held = header(source)
                found, dims = chosen(held, [n for n in names if n in held.variables])
                if len(dims) > 1:
                    raise ValueError(f"{path} has records over {dims}")
                n = held.sizes[dims[0]] if dims else 0
                for k in range(0, n, rows):
                    part = table(source, held, found, dims, k, min(k + rows, n), 1)
                    columns = [_as(part.column(part.schema.get_field_index(c)), kinds[t]) if c in part.schema.names else pa.nulls(len(part), kinds[t]) for c, t in variables.items()]
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(part), pa.string()), *columns], ["path", *names])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(paths)
    return files.select("path", "content").mapInArrow(parsed, ", ".join(["path string", *(f"`{n}` {t}" for n, t in variables.items())]))


def _as(column: pa.Array, kind: pa.DataType) -> pa.Array:
    """The column in another type; a text's first byte is its number."""
    if pa.types.is_string(column.type) and pa.types.is_integer(kind):
        return pa.array([None if not x else x.encode()[0] for x in column.to_pylist()], kind)
    return column.cast(kind)


def archive_kinds(spark: SparkSession, paths: str | list[str], names: Iterable[str], pattern: str = "*.gz", absent: bool = True) -> dict[str, str]:
    """Spark's types of the named variables as one file of the archive has them; those that it lacks are doubles, or left out."""
    import json

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held = header(arrays.Held(inflated(content.as_py())))
                yield pa.RecordBatch.from_pydict({"kinds": [json.dumps({n: arrays.kind(v.kind, v.attrs) for n, v in held.variables.items()})]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(paths)
    found = files.select("content").limit(1).mapInArrow(asked, "kinds string").first()
    if found is None:
        raise FileNotFoundError(f"no {pattern} in {paths}")
    kinds = json.loads(found[0])
    return {n: kinds.get(n, "double") for n in names if absent or n in kinds}


def encoded(sizes: dict[str, int], variables: list[tuple[str, tuple[str, ...], np.ndarray, dict]], unlimited: str | None = None, version: int = 2) -> bytes:
    """A classic file's bytes: (name, dimensions, values, attributes) each. unlimited: the dimension of records."""
    number = (lambda x: struct.pack(">q", x)) if version == 5 else (lambda x: struct.pack(">i", x))
    offset = (lambda x: struct.pack(">i", x)) if version == 1 else (lambda x: struct.pack(">q", x))
    padded = lambda x: x + b"\0" * (-len(x) % 4)
    name = lambda x: number(len(x.encode())) + padded(x.encode())
    items = lambda tag, parts: struct.pack(">i", tag if parts else 0) + number(len(parts)) + b"".join(parts)
    codes = {np.dtype(v).str.replace("|", ""): k for k, v in TYPES.items()}

    def typed(x: np.ndarray) -> tuple[int, np.ndarray]:
        if x.dtype.kind in "SU":
            x = x.astype("S")
            return 2, np.frombuffer(x.tobytes(), "S1")
        x = x.astype(x.dtype.newbyteorder(">"))
        return codes[x.dtype.str.replace("|", "")], x

    def attribute(key: str, value) -> bytes:
        code, held = typed(np.atleast_1d(np.array(value)))
        held = np.frombuffer(value.encode(), "S1") if isinstance(value, str) else held
        return name(key) + struct.pack(">i", code) + number(len(held)) + padded(held.tobytes())

    order = list(sizes)
    body = [(n, d, typed(np.asarray(x)), a) for n, d, x, a in variables]
    per = lambda d, x: x[1].nbytes // max(sizes[unlimited], 1) if d and d[0] == unlimited else x[1].nbytes
    records = [per(d, x) for _, d, x, _ in body if d and d[0] == unlimited]
    pad = (lambda n: n) if len(records) == 1 else (lambda n: n + -n % 4)

    def head(begins: list[int]) -> bytes:
        dims = [name(k) + number(0 if k == unlimited else n) for k, n in sizes.items()]
        held = [
            name(n) + number(len(d)) + b"".join(number(order.index(k)) for k in d) + items(_ATTRIBUTES, [attribute(k, v) for k, v in a.items()])
            + struct.pack(">i", x[0]) + number(per(d, x) + -per(d, x) % 4) + offset(begin)
            for (n, d, x, a), begin in zip(body, begins, strict=True)
        ]
        return b"CDF" + bytes([version]) + number(sizes[unlimited] if unlimited else 0) + items(_DIMENSIONS, dims) + items(_ATTRIBUTES, []) + items(_VARIABLES, held)

    at, begins, fixed = len(head([0] * len(body))), [0] * len(body), []
    for k, (_, d, x, _) in enumerate(body):
        if not d or d[0] != unlimited:
            begins[k], at = at, at + x[1].nbytes + -x[1].nbytes % 4
            fixed.append(padded(x[1].tobytes()))
    for k, (_, d, x, _) in enumerate(body):
        if d and d[0] == unlimited:
            begins[k], at = at, at + pad(per(d, x))
    rows = []
    for r in range(sizes[unlimited] if unlimited else 0):
        for _, d, x, _ in body:
            if d and d[0] == unlimited:
                n = per(d, x)
                rows.append(x[1].tobytes()[r * n : (r + 1) * n].ljust(pad(n), b"\0"))
    return head(begins) + b"".join(fixed) + b"".join(rows)


def write_netcdf(grid: DataFrame, path: str, axes: list[str], names: list[str], file: str) -> int:
    """The grid as files of a folder, one for each value of the column `file`, which names it; how many there are.

    A file holds the axes that its rows have, the first as records; cells without a row are NaN. A file is one task, so its
    rows must fit one: a day, or a month of a small domain.
    """

    def put(rows):
        held = {a: np.unique(rows[a].to_numpy()) for a in axes}
        shape = [len(x) for x in held.values()]
        at = np.ravel_multi_index([np.searchsorted(held[a], rows[a].to_numpy()) for a in axes], shape)
        made = []
        for a, x in held.items():
            is_time = x.dtype.kind == "M"
            made.append((a, (a,), x.astype("datetime64[us]").astype(np.int64) / 1e6 if is_time else x.astype(np.float64), {"units": "seconds since 1970-01-01 00:00:00"} if is_time else {}))
        for n in names:
            full = np.full(int(prod(shape)), np.nan)
            full[at] = rows[n].to_numpy(dtype=np.float64, na_value=np.nan)
            made.append((n, tuple(axes), full, {"_FillValue": float("nan")}))
        system, folder = arrays.located(path)
        system.create_dir(folder, recursive=True)
        target = f"{folder.rstrip('/')}/{rows[file].iloc[0]}.nc"
        with system.open_output_stream(target) as out:
            out.write(encoded(dict(zip(axes, shape, strict=True)), made, axes[0]))
        return rows[[file]].iloc[:1].rename(columns={file: "file"}).astype(str)

    return grid.select(file, *axes, *names).groupBy(file).applyInPandas(put, "file string").agg(F.count("*")).first()[0]
