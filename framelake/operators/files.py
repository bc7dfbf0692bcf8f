"""Files beside the data: what kind they are, lists of scenes, exports, the newest of several, and the layout of raw chroma."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.nal import EXTENSIONS
from ..sources.stores import stored

STREAMS = ["h265", "hevc", "h264", "264", "265"]


def kind(path: Column, head: Column) -> Column:
    """telemetry, bitstream or other, by the first bytes, the extension, and start codes where the extension says nothing."""
    name = F.regexp_extract(path, r"[^/\\]*$", 0)
    ext = F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))
    first = F.substring(head, 1, 32)
    coded = F.hex(first).rlike("^(?:..)*000001")
    return F.when(F.substring(head, 1, 8) == F.lit(b"CATB0001"), "telemetry").when(ext == "catb", "telemetry").when(ext.isin(STREAMS), "bitstream").when(ext.isin("", "bin") & coded, "bitstream").otherwise("other")


def bitstream_of(containers: DataFrame, listed: DataFrame) -> DataFrame:
    """For telemetry containers (path) the byte stream that they were made from, of the files that exist (path), null without one: in
    a folder NAME.catb-run the file NAME beside that folder, else a file of the same stem, by the order of extensions.
    """
    parent, name = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"[^/]*$", 0)
    run = F.regexp_extract(parent, r"^(?:.*/)?([^/]+)[.]catb-run$", 1)
    beside = F.when(run != "", F.concat(F.regexp_extract(parent, r"^((?:.*/)?)[^/]+$", 1), run))
    stem = F.concat(F.regexp_extract("path", r"^((?:.*/)?)[^/]*$", 1), F.regexp_replace(name, r"(?<=.)[.][^.]*$", ""), F.lit("."))
    options = F.filter(F.array(beside, *(F.concat(stem, F.lit(e)) for e in EXTENSIONS)), lambda c: c.isNotNull())
    tried = containers.select("path", F.posexplode(options).alias("k", "candidate"))
    there = listed.select(F.col("path").alias("candidate")).distinct().withColumn("there", F.lit(True))
    return tried.join(there, "candidate", "left").groupBy("path").agg(F.min(F.when(F.col("there"), F.struct("k", "candidate")))["candidate"].alias("bitstream"))


def scene_list(spark: SparkSession, path: str) -> DataFrame:
    """One frame number a line; empty lines are left out."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.trim("value").cast("long").alias("frame"))


def save_scenes(scenes: DataFrame, path: str) -> None:
    scenes.select(F.col("frame").cast("string").alias("value")).sort(F.col("value").cast("long")).write.text(path)


def export_cells(cells: DataFrame, path: str) -> None:
    """Aligned cells as CSV: frame, cell_x, cell_y, a, b, valid as 1 or 0."""
    cells.select("frame", F.col("gc").alias("cell_x"), F.col("gr").alias("cell_y"), "a", "b", F.col("valid").cast("int").alias("valid")).write.csv(path, header=True)


def newest(files: DataFrame, by: list[str]) -> DataFrame:
    """The file (path, mtime) last changed; of those as old the last by path."""
    return files.groupBy(*by).agg(F.max(F.struct("mtime", "path")).alias("f")).select(*by, "f.path", "f.mtime")


def with_stage(frames: DataFrame, listed: DataFrame, folder: str) -> DataFrame:
    """Frames with the file of their stage image: at its own path, else below the container's folder, else beside it by name; null without one."""
    options = F.array(F.col("stage"), F.concat(F.lit(folder + "/"), "stage"), F.concat(F.lit(folder + "/"), F.regexp_extract("stage", r"[^/]*$", 0)))
    tried = frames.select("*", F.posexplode(options).alias("k", "candidate"))
    there = listed.select(F.col("path").alias("candidate"), F.lit(True).alias("there"))
    best = F.min(F.when(F.col("there"), F.struct("k", "candidate")))
    return tried.join(there, "candidate", "left").groupBy(*frames.columns).agg(best.alias("b")).select(*frames.columns, F.col("b.candidate").alias("path"))


def neighbours(marks: DataFrame, at: DataFrame) -> DataFrame:
    """For frames `current` the next and the previous mark of their video, whatever their number and however few the videos.

    Frames and marks are dealt into ranges by video and frame, written once, as both steps have to see the same ranges. A window
    finds marks within a range, and one row a range gives those of the ranges around it.
    """
    both = marks.select("video", F.col("frame"), F.lit(True).alias("marked")).unionByName(at.select("video", F.col("current").alias("frame"), F.lit(False).alias("marked")))
    ranges = stored(both.repartitionByRange("video", "frame").withColumn("p", F.spark_partition_id()))
    mark, part = F.when(F.col("marked"), F.col("frame")), ["p", "video"]
    # frames only run up in both windows: one that is open at its end would be read anew for each row
    up = Window.partitionBy(*part).orderBy("frame").rangeBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*part).orderBy(F.desc("frame")).rangeBetween(Window.unboundedPreceding, -1)
    found = ranges.withColumn("previous", F.max(mark).over(up)).withColumn("next", F.min(mark).over(down)).where("not marked")
    ends = ranges.groupBy(*part).agg(F.min(mark).alias("least"), F.max(mark).alias("most"))
    before = Window.partitionBy("video").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("video").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)
    around = ends.select(F.col("p").alias("q"), F.col("video").alias("v"), F.max("most").over(before).alias("earlier"), F.min("least").over(after).alias("later"))
    joined = found.join(around.hint("merge"), (F.col("p") == F.col("q")) & F.col("video").eqNullSafe(F.col("v")))
    known = lambda own, other: F.when(F.col("frame").isNotNull(), F.coalesce(own, other)).alias(own)
    return joined.select("video", F.col("frame").alias("current"), known("previous", "earlier"), known("next", "later"))


def variation(plane: np.ndarray, most: int = 256) -> int:
    """Summed steps between neighbours along both axes, on at most 256 samples of each."""
    h, w = plane.shape
    p = plane[:: max(1, -(-h // most)), :: max(1, -(-w // most))].astype(np.int64)
    return int(np.abs(np.diff(p, axis=0)).sum() + np.abs(np.diff(p, axis=1)).sum())


def chroma_layout(frames: DataFrame) -> DataFrame:
    """Whether 4:2:0 frames (video, frame_idx, width, height, data) have separate (YU12) or mixed (NV12) chroma: the layout that varies less by a fifth, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                w, h, data = (row.column(k)[0].as_py() for k in (2, 3, 4))
                answer = None
                if w and h and w % 2 == 0 and h % 2 == 0 and len(data or b"") >= w * h * 3 // 2:
                    c = np.frombuffer(data, np.uint8)[w * h : w * h * 3 // 2]
                    split = sum(variation(p) for p in c.reshape(2, h // 2, w // 2))
                    mixed = sum(variation(c.reshape(h // 2, w // 2, 2)[:, :, k]) for k in range(2))
                    answer = "YU12" if split < mixed and 5 * split <= 4 * mixed else "NV12" if mixed < split and 5 * mixed <= 4 * split else None
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), pa.array([answer], pa.string())], ["video", "frame_idx", "layout"])

    v, f = (frames.schema[c].dataType.simpleString() for c in ("video", "frame_idx"))
    return frames.select("video", "frame_idx", "width", "height", "data").mapInArrow(run, f"video {v}, frame_idx {f}, layout string")
