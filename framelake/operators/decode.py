"""Frames of bytes to RGB, channels, pixels and other formats, in Arrow batches.

A row is a frame: (video, frame_idx, width, height, fourcc, data). A frame that can't be decoded gives a null and a
reason instead of failing the job. Pixels are exploded from the decoded bytes only where an operator asks for rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats, kernels

KEYS = ["video", "frame_idx", "width", "height", "fourcc"]


def each_frame(frames: DataFrame, work: Callable[[bytes, str, int, int], bytes], out: str) -> DataFrame:
    kinds = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in KEYS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a frame at a time: they are large
                row = batch.slice(i, 1)
                w, h, code = (row.column(k)[0].as_py() for k in (2, 3, 4))
                try:
                    done, reason = work(row.column(5)[0].as_py() or b"", code, w, h), None
                except ValueError as e:
                    done, reason = None, str(e)
                yield pa.RecordBatch.from_arrays([*(row.column(k) for k in range(5)), pa.array([done], pa.binary()), pa.array([reason], pa.string())], [*KEYS, out, "error"])

    return frames.select(*KEYS, "data").mapInArrow(run, f"{kinds}, {out} binary, error string")


def to_rgb(frames: DataFrame, matrix: str = "bt601") -> DataFrame:
    return each_frame(frames, lambda d, c, w, h: kernels.rgb_of(d, c, w, h, matrix).tobytes(), "rgb")


def to_format(frames: DataFrame, fourcc: str) -> DataFrame:
    """Frames converted to one format."""
    done = each_frame(frames, lambda d, c, w, h: kernels.converted(d, c, fourcc, w, h), "data")
    return done.withColumn("fourcc", F.lit(fourcc))


def planes_or_none(data: bytes | None, fourcc: str | None, width: int | None, height: int | None) -> dict[str, np.ndarray]:
    """The channels of a frame; none if it can't be decoded."""
    if data is None or fourcc not in formats.BY_FOURCC or width is None or height is None:
        return {}
    try:
        return kernels.channels_of(data, fourcc, width, height)
    except ValueError:
        return {}


def channels(frames: DataFrame) -> DataFrame:
    """One row a channel: its name and its plane of bytes; a frame that can't be decoded gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                w, h, code = (row.column(k)[0].as_py() for k in (2, 3, 4))
                for name, plane in planes_or_none(row.column(5)[0].as_py(), code, w, h).items():
                    yield pa.RecordBatch.from_arrays([*(row.column(k) for k in range(5)), pa.array([name]), pa.array([plane.tobytes()], pa.binary())], [*KEYS, "channel", "plane"])

    kinds = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in KEYS)
    return frames.select(*KEYS, "data").mapInArrow(run, f"{kinds}, channel string, plane binary")


def pixels(rgb: DataFrame) -> DataFrame:
    """RGB frames to rows (video, frame, x, y, r, g, b), as column arrays and not pixel by pixel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                w, h, data = (row.column(k)[0].as_py() for k in (2, 3, 4))
                if data is None:
                    continue
                a = np.frombuffer(data, np.uint8).reshape(h * w, 3).astype(np.int32)
                key = [row.column(k).take(pa.array(np.zeros(h * w, np.int64))) for k in range(2)]
                at = np.arange(h * w, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*key, *map(pa.array, (at % w, at // w, a[:, 0], a[:, 1], a[:, 2]))], ["video", "frame", "x", "y", "r", "g", "b"])

    v, f = (rgb.schema[c].dataType.simpleString() for c in ("video", "frame_idx"))
    return rgb.select("video", "frame_idx", "width", "height", "rgb").mapInArrow(run, f"video {v}, frame {f}, x int, y int, r int, g int, b int")


def pixel_info(frames: DataFrame, points: DataFrame, before: int = 4, after: int = 4) -> DataFrame:
    """For points (video, frame_idx, x, y): the channels' values there and the first channel around it, in hex.

    The window is 8 x 8 with the point in row and column 4; places outside the picture are empty, and a point outside
    has no values. Points of a frame are brought to it together, so its bytes move once.
    """
    asked = points.groupBy("video", "frame_idx").agg(F.collect_set(F.struct("x", "y")).alias("points"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                video, frame, w, h, code, data, wanted = (batch.column(k)[i].as_py() for k in range(7))
                planes = planes_or_none(data, code, w, h)
                first = next(iter(planes.values()), None)
                cols: list[list] = [[], [], [], []]
                for p in wanted:
                    x, y = p["x"], p["y"]
                    inside = first is not None and 0 <= x < w and 0 <= y < h
                    cols[0].append(x)
                    cols[1].append(y)
                    cols[2].append([(name, int(plane[y, x])) for name, plane in planes.items()] if inside else [])
                    cols[3].append([[f"{first[r, c]:02X}" if first is not None and 0 <= c < w and 0 <= r < h else "" for c in range(x - before, x + after)] for r in range(y - before, y + after)])
                n = len(wanted)
                yield pa.RecordBatch.from_arrays([pa.array([video] * n), pa.array([frame] * n, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.map_(pa.string(), pa.int32())), pa.array(cols[3], pa.list_(pa.list_(pa.string())))], ["video", "frame_idx", "x", "y", "components", "neighbourhood"])

    joined = frames.join(asked, ["video", "frame_idx"]).select("video", F.col("frame_idx").cast("long"), "width", "height", "fourcc", "data", F.transform("points", lambda p: F.struct(p["x"].cast("long").alias("x"), p["y"].cast("long").alias("y"))).alias("points"))
    return joined.mapInArrow(run, "video string, frame_idx long, x long, y long, components map<string,int>, neighbourhood array<array<string>>")
