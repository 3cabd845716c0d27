"""Small files and folders by Hadoop's file systems, so that a path may be in any store that Spark reads.

Without a session paths are this machine's.
"""

from __future__ import annotations

import atexit
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def _at(path: str):
    """(file system, Hadoop path), or None without a session."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(path: str) -> bool:
    held = _at(path)
    return Path(path).exists() if held is None else held[0].exists(held[1])


def is_folder(path: str) -> bool:
    held = _at(path)
    return Path(path).is_dir() if held is None else exists(path) and held[0].getFileStatus(held[1]).isDirectory()


def is_file(path: str) -> bool:
    return exists(path) and not is_folder(path)


def folders(path: str) -> list[str]:
    """Paths of the folders in a folder, in order of their names."""
    held = _at(path)
    if held is None:
        return sorted(str(x) for x in Path(path).iterdir() if x.is_dir())
    return sorted(x.getPath().toString() for x in held[0].listStatus(held[1]) if x.isDirectory())


def read_text(path: str) -> str:
    held = _at(path)
    if held is None:
        return Path(path).read_text()
    stream = held[0].open(held[1])
    try:
        return SparkSession.getActiveSession()._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> str:
    held = _at(path)
    if held is None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text)
    else:
        stream = held[0].create(held[1], True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
    return path


def qualified(path: str) -> str:
    """The path with its scheme, as Spark shows it."""
    held = _at(path)
    return str(Path(path).absolute()) if held is None else held[0].makeQualified(held[1]).toString()


def names(path: str, ending: str) -> list[str]:
    """Names of the files of a folder with the ending."""
    held = _at(path)
    if held is None:
        return sorted(x.name for x in Path(path).iterdir() if x.is_file() and x.name.endswith(ending))
    return sorted(n for x in held[0].listStatus(held[1]) if x.isFile() and (n := x.getPath().getName()).endswith(ending))


def delete(path: str) -> None:
    held = _at(path)
    if held is not None:
        held[0].delete(held[1], True)


def move(source: str, target: str) -> None:
    """Rename a folder, in place of what is there; the folders above are made."""
    system, at = _at(source)
    _, to = _at(target)
    if system.exists(to):
        system.delete(to, True)
    system.mkdirs(to.getParent())
    if not system.rename(at, to):
        raise OSError(f"{source} cannot be moved to {target}")


def scratch(spark: SparkSession) -> str:
    """A path, deleted when the interpreter ends, in the folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset the session's warehouse serves, which a cluster must share for tables anyhow.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{at.rstrip('/')}/sink-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            delete(path)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
            return

    atexit.register(drop)
    return path


def written(df):
    """df as a table in the shared folder, read again: lineage is cut and nothing is worked out twice."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
