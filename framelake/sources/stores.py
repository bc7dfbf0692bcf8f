"""Files of any store that pyarrow knows, by path or address; a path may be a file, a folder or a pattern."""

from __future__ import annotations

import fnmatch
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def split(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def opened(path: str):
    system, inner = split(path)
    return system.open_input_file(inner)


def listed(path: str, endings: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """(path, bytes) of the files at a path, by path. A folder gives the files in it that end so, a pattern those that match;
    hidden ones (with a dot or underscore first) are left out.
    """
    system, inner = split(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.Directory:
        folder, fits = inner, lambda name: not endings or name.lower().endswith(endings)
    else:
        folder, _, pattern = inner.rpartition("/")
        if not any(c in pattern for c in "*?["):
            raise FileNotFoundError(f"there is no {path}")
        fits = lambda name: fnmatch.fnmatchcase(name, pattern)
    found = system.get_file_info(fs.FileSelector(folder or ".", recursive=False))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and fits(f.base_name))


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Only a local session may go without: it gets one of its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        own = sc.getConf().get("spark.checkpoint.dir")
        if not own:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            own = tempfile.mkdtemp(prefix="framelake-shared-")
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows written as a table to the shared folder and read again: the plan ends here, and lost executors lose nothing."""
    path = f"{shared(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
