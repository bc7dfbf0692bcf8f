"""Sinks that commit: raw clips, image sequences and byte streams written by tasks, put in place on the driver.

Tasks write parts under names of their own in a hidden folder beside the result and report them; only what tasks that
succeeded reported is put in place, in order, when all have ended. So a task that is run again, or twice at once, leaves
nothing behind, and a failed job leaves neither result nor parts. What goes through the driver are names and numbers;
where a file has several parts it joins them in pieces of JOINED bytes, or keeps them as numbered parts (`join=False`).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators import decode
from .stores import split
from .video import to_bmp, to_ppm

JOINED = 8 << 20


@dataclass
class Part:
    file: str
    first: int
    last: int
    path: str
    size: int


@dataclass
class Parts(WriterCommitMessage):
    parts: list[Part] = field(default_factory=list)


def runs(file: pa.Array) -> list[tuple[int, int]]:
    """Stretches of equal values in an array, each as its first row and the row behind it."""
    n = len(file)
    ends = (np.flatnonzero(pc.not_equal(file.slice(1), file.slice(0, n - 1)).fill_null(True).to_numpy(zero_copy_only=False)) + 1).tolist() if n > 1 else []
    return list(zip([0, *ends], [*ends, n], strict=True)) if n else []


def joined(data: pa.Array) -> pa.Buffer | bytes:
    """The bytes of all values one after another; nulls are none. Values lie so in an Arrow array, so nothing is copied."""
    if data.null_count:
        data = data.fill_null(b"")
    _, offsets, body = data.buffers()
    wide = pa.types.is_large_binary(data.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[data.offset : data.offset + len(data) + 1]
    return b"" if body is None else body.slice(int(at[0]), int(at[-1] - at[0]))


class OrderedFiles(DataSource):
    """Rows (file, seq, data) to files of their bytes by seq. Options: path (a folder), join. Rows have to be dealt out in
    ranges of (file, seq) and sorted in them, as `save` does; a file's ranges may not overlap.
    """

    @classmethod
    def name(cls) -> str:
        return "orderedfiles"

    def schema(self) -> str:
        return "file string, seq long, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return OrderedWriter(self.options["path"].rstrip("/"), self.options.get("join", "true").lower() == "true")


class OrderedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, join: bool):
        self.path, self.join = path, join
        self.hidden = f"{path}/.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        system, hidden = split(self.hidden)
        system.create_dir(hidden, recursive=True)
        out, done = None, Parts()
        try:
            for batch in iterator:
                file, seq, data = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
                # rows of one file that follow each other lie together in the batch, and are written at once
                for at, end in runs(file):
                    name, first, last = file[at].as_py(), int(seq[at]), int(seq[end - 1])
                    part = done.parts[-1] if done.parts else None
                    if part is None or part.file != name:
                        if out:
                            out.close()
                        part = Part(name, first, first, f"{hidden}/{uuid.uuid4().hex}", 0)
                        done.parts.append(part)
                        out = system.open_output_stream(part.path)
                    steps = np.flatnonzero(np.diff(seq[at:end], prepend=part.last) < 0)
                    if len(steps):
                        k = at + int(steps[0])
                        raise ValueError(f"rows of {name} are out of order: {seq[k]} after {seq[k - 1] if k > at else part.last}")
                    body = joined(data.slice(at, end - at))
                    out.write(body)
                    part.size += len(body)
                    part.last = last
        finally:
            if out:
                out.close()
        return done

    def commit(self, messages: list[Parts | None]) -> None:
        system, inner = split(self.path)
        by_file: dict[str, list[Part]] = {}
        for part in (p for m in messages if m for p in m.parts):
            by_file.setdefault(part.file, []).append(part)
        for file, parts in by_file.items():
            parts.sort(key=lambda p: (p.first, p.last))
            if any(a.last >= b.first for a, b in zip(parts, parts[1:], strict=False)):
                self.abort(messages)
                raise ValueError(f"parts of {file} overlap: rows have to be dealt out by ranges")
        for file, parts in by_file.items():
            target = f"{inner}/{file}"
            system.create_dir(target.rpartition("/")[0], recursive=True)
            if len(parts) == 1:
                system.move(parts[0].path, target)
            elif not self.join:
                stem, dot, ending = file.rpartition(".")
                for k, part in enumerate(parts):
                    system.move(part.path, f"{inner}/{stem if dot else file}.{k:05d}{dot + ending if dot else ''}")
            else:
                whole = f"{parts[0].path}-joined"
                with system.open_output_stream(whole) as out:
                    for part in parts:
                        with system.open_input_stream(part.path) as piece:
                            while data := piece.read(JOINED):
                                out.write(data)
                system.move(whole, target)
        self.abort(messages)

    def abort(self, messages: list[Parts | None]) -> None:
        """Remove the parts, also those of tasks that didn't report."""
        system, hidden = split(self.hidden)
        if system.get_file_info(hidden).type != pa.fs.FileType.NotFound:
            system.delete_dir(hidden)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OrderedFiles)


def save(rows: DataFrame, path: str, join: bool = True) -> None:
    """Rows (file, seq, data) as files in a folder: of each file the bytes of its rows by seq. Null data are no bytes. Existing
    files of other names stay; one of the same name is replaced at the end.
    """
    register(rows.sparkSession)
    dealt = rows.select("file", F.col("seq").cast("long").alias("seq"), "data").repartitionByRange("file", "seq").sortWithinPartitions("file", "seq")
    dealt.write.format("orderedfiles").mode("append").options(path=path, join=join).save()


def plain_name(video: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(video, r"[^/]*$", 0), "[^A-Za-z0-9._-]", "_")


def save_clip(frames: DataFrame, path: str, start: int, end: int, fourcc: str | None = None) -> None:
    """Frames start to end, both included, of one video as one raw file, in their format or converted to another one."""
    folder, _, name = path.rpartition("/")
    chosen = frames.where(F.col("frame_idx").between(start, end))
    chosen = decode.to_format(chosen, fourcc) if fourcc else chosen
    save(chosen.select(F.lit(name).alias("file"), F.col("frame_idx").alias("seq"), "data"), folder or ".")


def convert(frames: DataFrame, folder: str, fourcc: str, ending: str = "yuv") -> None:
    """Each video as one file in another format: raw frames, or PPM images one after another where the format is PPM.

    A frame that can't be converted ends the job, and then nothing is written.
    """
    ppm = fourcc.upper() == "PPM"
    made = decode.to_rgb(frames).withColumn("data", image_of("ppm")("width", "height", "rgb")) if ppm else decode.to_format(frames, fourcc)
    whole = F.when(F.col("error").isNull(), F.col("data")).otherwise(F.raise_error(F.concat(F.lit("frame "), F.col("frame_idx").cast("string"), F.lit(": "), F.coalesce("error", F.lit("")))).cast("binary"))
    save(made.select(F.concat(plain_name(F.col("video")), F.lit(f".{'ppm' if ppm else ending}")).alias("file"), F.col("frame_idx").alias("seq"), whole.alias("data")), folder)


def image_of(kind: str):
    """(width, height, rgb) to the bytes of a PPM or BMP image."""
    make = {"ppm": to_ppm, "bmp": to_bmp}[kind]

    @F.pandas_udf("binary")
    def image(width: pd.Series, height: pd.Series, rgb: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else make(w, h, d) for w, h, d in zip(width, height, rgb, strict=True)], dtype=object)

    return image


def image_name(kind: str) -> Column:
    return F.concat(plain_name(F.col("video")), F.lit("_"), F.lpad(F.col("frame_idx").cast("string"), 6, "0"), F.lit(f".{kind}"))


def save_images(frames: DataFrame, folder: str, kind: str = "ppm") -> None:
    """Each RGB frame (video, frame_idx, width, height, data) as an image named by its video and number."""
    save(frames.select(image_name(kind).alias("file"), F.lit(0).alias("seq"), image_of(kind)("width", "height", "data").alias("data")), folder)
