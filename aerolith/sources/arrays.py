"""What sources of n-dimensional arrays share: ranges of bytes, decoding by convention, and arrays as rows of a table."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs

#: Microseconds of a unit of time, by its singular.
_UNITS = {"microsecond": 1, "millisecond": 1000} | {n: k * 1_000_000 for k, names in ((1, "second sec s"), (60, "minute min"), (3600, "hour hr h"), (86400, "day d")) for n in names.split()}
_SINCE = re.compile(r"^\s*([a-zA-Z]+?)s?\s+since\s+(\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2})(?::(\d{1,2})(?::(\d{1,2})(?:\.\d*)?)?)?)?\s*(?:Z|UTC|[+-]00:?00)?\s*$")
_CALENDARS = {"standard", "gregorian", "proleptic_gregorian"}


@lru_cache(maxsize=64)
def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and its place there: local, or any store that Arrow reaches by the path's scheme."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    if path.startswith("file:"):
        path = path.removeprefix("file:")
    return fs.LocalFileSystem(), path


class Bytes:
    """Ranges of one file's bytes. taken: how many were read."""

    def __init__(self, path: str) -> None:
        system, at = located(path)
        self._file = system.open_input_file(at)
        self.size, self.taken = self._file.size(), 0

    def read(self, start: int, n: int) -> bytes:
        if start + n > self.size:
            raise EOFError(f"{n} bytes wanted at {start}, the file has {self.size}")
        self.taken += n
        return self._file.read_at(n, start)

    def close(self) -> None:
        self._file.close()


class Held(Bytes):
    """The same of bytes in memory."""

    def __init__(self, data: bytes) -> None:
        self._file, self.size, self.taken = pa.BufferReader(data), len(data), 0


def listed(path: str, pattern: str) -> list[str]:
    """Paths, by name, of the files of a folder and its folders whose names match; a file's own path."""
    system, at = located(path)
    if system.get_file_info(at).type == fs.FileType.File:
        return [path]
    prefix = path[: len(path) - len(at)] if path.endswith(at) else path.split("://")[0] + "://" if "://" in path else ""
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(prefix + x.path for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, pattern))


def epoch_of(attrs: dict) -> tuple[int, int] | None:
    """(microseconds of the unit, and of the begin since 1970) of a variable that counts time; else None."""
    found = _SINCE.match(str(attrs.get("units", "")))
    if not found:
        return None
    if (calendar := str(attrs.get("calendar", "standard")).lower()) not in _CALENDARS:
        raise ValueError(f"times of a {calendar} calendar are no times of this one")
    unit, *parts = found.groups()
    if unit.lower() not in _UNITS:
        raise ValueError(f"unknown unit of time {unit}")
    y, mo, d, h, mi, s = (int(x or 0) for x in parts)
    begin = np.datetime64(f"{y:04}-{mo:02}-{d:02}T{h:02}:{mi:02}:{s:02}", "us").astype(np.int64)
    return _UNITS[unit.lower()], int(begin)


def kind(dtype: np.dtype, attrs: dict, decode: bool = True) -> str:
    """Spark's type of a decoded variable."""
    if dtype.kind in "SU":
        return "string"
    if decode and epoch_of(attrs):
        return "timestamp_ntz"
    scaled = decode and {"scale_factor", "add_offset"} & set(attrs)
    return "double" if dtype.kind == "f" or scaled else "long"


def decoded(values: np.ndarray, attrs: dict, decode: bool = True) -> pa.Array:
    """Values as Arrow has them: fill values, missing values and NaN null, scale and offset applied, times of this calendar."""
    values = values.ravel()
    if values.dtype.kind in "SU":
        texts = np.char.rstrip(values.astype("S"), b"\0 ") if values.dtype.itemsize else values
        return pa.array([x.decode("utf-8", "replace") for x in texts.tolist()], pa.string())
    none = np.isnan(values) if values.dtype.kind == "f" else np.zeros(len(values), bool)
    for name in ("_FillValue", "missing_value") if decode else ():
        for x in np.atleast_1d(attrs.get(name, [])):
            none |= values == np.asarray(x).astype(values.dtype)
    if decode and (epoch := epoch_of(attrs)):
        unit, begin = epoch
        whole = np.where(none, 0, values)
        micros = np.rint(whole * float(unit)).astype(np.int64) if values.dtype.kind == "f" else whole.astype(np.int64) * unit
        return pa.array(micros + begin, pa.int64(), mask=none).cast(pa.timestamp("us"))
    if kind(values.dtype, attrs, decode) == "double":
        out = values.astype(np.float64)
        if decode:
            out = out * float(attrs.get("scale_factor", 1.0)) + float(attrs.get("add_offset", 0.0)) if {"scale_factor", "add_offset"} & set(attrs) else out
        return pa.array(out, pa.float64(), mask=none)
    return pa.array(values.astype(np.int64), pa.int64(), mask=none)


def taken(column: pa.Array, index: np.ndarray) -> pa.Array:
    """The column's values at the places."""
    return column.take(pa.array(index))


def grid_index(shape: Sequence[int], begin: int, end: int) -> list[np.ndarray]:
    """For the cells begin to end of a shape in row order, the index of each axis."""
    return list(np.unravel_index(np.arange(begin, end), tuple(shape))) if shape else []


#: Cells that a partition of small pieces has, and partitions there are before pieces are put together.
PACKED, LEAST = 1 << 18, 64


def packed(pieces: list, cells: int) -> list[list]:
    """Pieces of so many cells each, neighbours put together: up to PACKED cells, so tasks do not grow with the number of files."""
    n = max(1, min(-(-len(pieces) // LEAST), PACKED // max(cells, 1)))
    return [pieces[k : k + n] for k in range(0, len(pieces), n)]
