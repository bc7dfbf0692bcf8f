"""Raw video, Y4M and still-image sequences as frames, and the writers back.

Raw and Y4M files are data sources "rawvideo" and "y4m". A partition of raw video is a range of frames, found by offset, and
the options first and last (both included) narrow the ranges before anything is read. Files are opened by pyarrow's file
systems, so a path can be in any store it knows. Still images are read by Spark's binaryFile and image sources.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import formats
from .stores import listed, opened, split

SCHEMA = "video string, frame_idx long, width int, height int, fourcc string, data binary"
MAX_SIDE = 8192
BYTES_PER_PARTITION = 64 << 20


@dataclass
class Frames(InputPartition):
    path: str
    first: int
    offset: int
    n: int


@dataclass
class Layout:
    """How frames lie in a file: from the byte `start` on, each of `size` bytes behind a marker of `gap`."""

    path: str
    width: int
    height: int
    fourcc: str
    start: int
    gap: int
    size: int
    total: int

    @property
    def count(self) -> int:
        return max(0, (self.total - self.start) // (self.size + self.gap))


def frame_row(at: Layout, i: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at.path]), pa.array([i], pa.int64()), pa.array([at.width], pa.int32()), pa.array([at.height], pa.int32()), pa.array([at.fourcc]), pa.array([data], pa.binary())], ["video", "frame_idx", "width", "height", "fourcc", "data"])


class FrameReader(DataSourceReader):
    """Reads frames of fixed size; a partition is a range of frames of one file."""

    def __init__(self, layouts: list[Layout], options: dict):
        self.layouts = layouts
        self.low, self.high = max(0, int(options.get("first", 0))), int(options.get("last", 1 << 62)) + 1

    def partitions(self) -> list[InputPartition]:
        found = []
        for at in self.layouts:
            step, high = max(1, BYTES_PER_PARTITION // max(1, at.size)), min(at.count, self.high)
            found += [Frames(at.path, i, at.start + i * (at.size + at.gap) + at.gap, min(step, high - i)) for i in range(self.low, high, step)]
        return found or [Frames("", 0, 0, 0)]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        if not partition.n:
            return
        at = next(x for x in self.layouts if x.path == partition.path)
        with opened(at.path) as f:
            for i in range(partition.n):
                f.seek(partition.offset + i * (at.size + at.gap))
                data = f.read(at.size)
                if len(data) < at.size:
                    raise ValueError(f"frame {partition.first + i} of {at.path} is cut off")
                yield frame_row(at, partition.first + i, data)


def checked(fourcc: str, width: int, height: int) -> None:
    """ValueError unless a format can be shown and divides the picture."""
    if fourcc not in formats.BY_FOURCC or not formats.viewable(fourcc):
        raise ValueError(f"format {fourcc} can't be shown")
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError(f"{width}x{height} is not a picture size up to {MAX_SIDE}")
    _, _, _, _, h, v, _, _, _ = formats.BY_FOURCC[fourcc]
    if width % h or height % v or fourcc == "T010" and (width % 4 or height % 8):
        raise ValueError(f"{width}x{height} doesn't fit the sampling of {fourcc}")


class RawVideo(DataSource):
    """Options: path (a file, a folder or a pattern), width, height, fourcc, first, last (of each file). A trailing part of a frame is left out."""

    @classmethod
    def name(cls) -> str:
        return "rawvideo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        fourcc, width, height = self.options.get("fourcc", "YU12"), int(self.options["width"]), int(self.options["height"])
        checked(fourcc, width, height)
        size = formats.frame_bytes(fourcc, width, height)
        found = [Layout(path, width, height, fourcc, 0, 0, size, total) for path, total in listed(self.options["path"])]
        if not any(x.count for x in found):
            raise ValueError(f"{self.options['path']} holds no whole frame")
        return FrameReader(found, self.options)


def y4m_format(colour: str) -> str:
    """The fourcc of a Y4M colour space: by depth first, then sampling; 4:2:0 where it doesn't say."""
    depth = "p12" if "p12" in colour else "p10" if "p10" in colour else ""
    if "mono" in colour:
        return {"": "GREY", "p10": "Y10 ", "p12": "Y12 "}[depth]
    sampling = "444" if "444" in colour else "422" if "422" in colour else "420"
    return {"420": "YU12", "422": "422P", "444": "444P", "420p10": "0T20", "422p10": "2T22", "444p10": "4T44", "420p12": "0C20", "422p12": "2C22", "444p12": "4C44"}[sampling + depth]


def y4m_header(line: str) -> dict:
    """Width, height, rate, colour space, interlacing and aspect of a stream header."""
    if not line.startswith("YUV4MPEG2"):
        raise ValueError("not a YUV4MPEG2 stream")
    found = {t[0]: t[1:] for t in line.split()[1:]}
    if not found.get("W", "").isdigit() or not found.get("H", "").isdigit():
        raise ValueError("a YUV4MPEG2 header without width or height")
    rate = re.fullmatch(r"(\d+):(\d+)", found.get("F", ""))
    fps = (int(rate[1]), int(rate[2])) if rate and int(rate[2]) else (30, 1)
    return {"width": int(found["W"]), "height": int(found["H"]), "fps": fps, "colour": found.get("C", "420"), "interlace": found.get("I", "p"), "aspect": found.get("A", "")}


class Y4m(DataSource):
    """Options: path (a file, a folder or a pattern), first, last (of each file). A task reads a file; `y4m` splits large ones."""

    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Y4mReader(y4m_layouts(self.options["path"]), self.options, whole=True)


def y4m_layouts(path: str) -> list[Layout]:
    return [y4m_layout(file, total) for file, total in listed(path, (".y4m",))]


def y4m_layout(path: str, total: int) -> Layout:
    """Where frames would lie if all markers had the length of the first."""
    with opened(path) as f:
        start = f.read(4096)
    line, _, behind = start.partition(b"\n")
    head = y4m_header(line.decode("latin-1"))
    fourcc = y4m_format(head["colour"])
    checked(fourcc, head["width"], head["height"])
    gap = behind.partition(b"\n")[0]
    return Layout(path, head["width"], head["height"], fourcc, len(line) + 1, len(gap) + 1, formats.frame_bytes(fourcc, head["width"], head["height"]), total)


@dataclass
class Stretch(InputPartition):
    path: str
    part: int
    low: int
    high: int


#: Markers in a row, each a whole frame behind the last, that make a place the start of a frame.
CHAIN = 3


def marker_at(f, at: Layout, place: int) -> int:
    """The length of the marker at a place; 0 if there is none."""
    f.seek(place)
    found = f.read(min(256, at.total - place))
    stop = found.find(b"\n")
    return stop + 1 if found.startswith(b"FRAME") and stop >= 0 else 0


def chained(f, at: Layout, place: int) -> bool:
    for _ in range(CHAIN):
        marker = marker_at(f, at, place)
        if not marker:
            return False
        place += marker + at.size
        if place >= at.total:
            return True
    return True


def first_frame(f, at: Layout, low: int) -> int:
    """The first place from `low` on where a frame's marker begins, as a walk from the file's start would find it.

    Within the length of a frame and a marker there is one such place, and it passes `chained` unless the stream breaks off
    right behind it. So if one place alone passes, that is it. Samples that look like chains of markers make it two, and then, or if
    none passes, the markers are walked from the start.
    """
    if low <= at.start:
        return at.start
    f.seek(low)
    window = f.read(min(at.size + 512, at.total - low))
    found = [low + m.start() for m in re.finditer(b"FRAME", window)]
    fits = [place for place in found if place < low + at.size + 256 and chained(f, at, place)]
    if len(fits) == 1:
        return fits[0]
    place = at.start
    while place < low and (marker := marker_at(f, at, place)):
        place += marker + at.size
    return place if place >= low else at.total


class Y4mReader(DataSourceReader):
    """Reads frames whose markers begin in a range of bytes. `whole`: a range is a file, so that a row's place is its number."""

    def __init__(self, layouts: list[Layout], options: dict, whole: bool):
        self.layouts, self.whole = layouts, whole
        self.low, self.high = max(0, int(options.get("first", 0))), int(options.get("last", 1 << 62)) + 1
        self.step = int(options.get("bytes_per_partition", BYTES_PER_PARTITION))

    def partitions(self) -> list[InputPartition]:
        found = []
        for at in self.layouts:
            step = at.total if self.whole else max(self.step, at.size + at.gap)
            found += [Stretch(at.path, k, low, min(low + step, at.total)) for k, low in enumerate(range(at.start, at.total, max(1, step)))]
        return found or [Stretch("", 0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if partition.low >= partition.high:
            return
        at = next(x for x in self.layouts if x.path == partition.path)
        with opened(at.path) as f:
            place, number, ended = first_frame(f, at, partition.low), 0, False
            while place < partition.high and not (self.whole and number >= self.high):
                if not (marker := marker_at(f, at, place)):
                    ended = True
                    break
                if not self.whole or number >= self.low:
                    f.seek(place + marker)
                    data = f.read(at.size)
                    if len(data) < at.size:
                        raise ValueError(f"frame {number} of {at.path} is cut off")
                    row = frame_row(at, number, data)
                    yield row if self.whole else pa.RecordBatch.from_arrays([*row.columns, pa.array([partition.part], pa.int32()), pa.array([False])], [*row.schema.names, "part", "ended"])
                place, number = place + marker + at.size, number + 1
            if ended and not self.whole:
                row = frame_row(at, number, None)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([partition.part], pa.int32()), pa.array([True])], [*row.schema.names, "part", "ended"])


class Y4mRanges(Y4m):
    """The frames of byte ranges, numbered within each; `y4m` numbers them in the file. Options as Y4m, and bytes_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "y4mranges"

    def schema(self) -> str:
        return f"{SCHEMA}, part int, ended boolean"

    def reader(self, schema) -> DataSourceReader:
        return Y4mReader(y4m_layouts(self.options["path"]), self.options, whole=False)


def y4m(spark: SparkSession, path: str, bytes_per_partition: int = BYTES_PER_PARTITION) -> DataFrame:
    """The frames of Y4M files, each file split among tasks by byte ranges.

    Ranges find their frames by themselves; one row a range adds up to the numbers of frames before it. A file ends where a
    marker should be and isn't, and ranges behind that place are left out, as when it is read from the start.
    """
    register(spark)
    found = spark.read.format("y4mranges").options(path=path, bytes_per_partition=bytes_per_partition).load()
    per = found.groupBy("video", "part").agg(F.count_if(~F.col("ended")).alias("n"), F.max("ended").alias("ended"))
    before = Window.partitionBy("video").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    known = per.select("video", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.coalesce(F.max("ended").over(before), F.lit(False)).alias("over"))
    joined = found.where("not ended").join(known.where("not over"), ["video", "part"])
    return joined.select("video", (F.col("frame_idx") + F.col("before")).alias("frame_idx"), "width", "height", "fourcc", "data")


def register(spark: SparkSession) -> None:
    """Make the sources known to a session."""
    for source in (RawVideo, Y4m, Y4mRanges):
        spark.dataSource.register(source)


def ppm(data: bytes) -> tuple[int, int, bytes]:
    """P3 or P6 to width, height and RGB bytes; samples are scaled to 8 bits."""
    fields, at = [], 0
    while len(fields) < 4:
        m = re.compile(rb"(?:\s|#[^\n]*\n?)*([^\s#]+)").match(data, at)
        if not m:
            raise ValueError("a PPM header that ends early")
        fields.append(m[1])
        at = m.end()
    kind, (w, h, most) = fields[0], map(int, fields[1:])
    if kind not in (b"P3", b"P6") or not w or not h or not 1 <= most <= 65535:
        raise ValueError("not a PPM image")
    n = w * h * 3
    if kind == b"P3":
        values = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n], dtype=np.int64)
    else:
        values = np.frombuffer(data[at + 1 :][: n * (2 if most > 255 else 1)], ">u2" if most > 255 else np.uint8).astype(np.int64)
    if len(values) < n:
        raise ValueError("a PPM image that ends early")
    if (values > most).any() and (kind == b"P3" or most != 255):
        raise ValueError("a PPM sample above the greatest")
    return w, h, ((values * 255 + most // 2) // most).astype(np.uint8).tobytes()


def bmp(data: bytes) -> tuple[int, int, bytes]:
    """Uncompressed 24- or 32-bit BMP to width, height and RGB bytes, rows from the top."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    u4 = lambda at: int.from_bytes(data[at : at + 4], "little", signed=True)
    start, header, w, h, bits, packing = u4(10), u4(14), u4(18), u4(22), int.from_bytes(data[28:30], "little"), u4(30)
    if header not in (40, 52, 56, 108, 124) or bits not in (24, 32) or packing != 0 or not 0 < w <= 32768 or not 0 < abs(h) <= 32768:
        raise ValueError("a BMP image of a kind that isn't read")
    row = (w * bits // 8 + 3) // 4 * 4
    raw = np.frombuffer(data[start : start + row * abs(h)], np.uint8)
    if len(raw) < row * abs(h):
        raise ValueError("a BMP image that ends early")
    rows = raw.reshape(abs(h), row)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    return w, abs(h), np.ascontiguousarray(rows[:: 1 if h < 0 else -1, :, 2::-1]).tobytes()


def to_ppm(width: int, height: int, rgb: bytes) -> bytes:
    if len(rgb) != width * height * 3:
        raise ValueError("RGB data of another size")
    return b"P6\n%d %d\n255\n" % (width, height) + rgb


def to_bmp(width: int, height: int, rgb: bytes) -> bytes:
    row = np.frombuffer(rgb, np.uint8).reshape(height, width, 3)[::-1, :, ::-1].reshape(height, width * 3)
    body = np.pad(row, ((0, 0), (0, -width * 3 % 4))).tobytes()
    put = lambda *v: b"".join(x.to_bytes(4, "little", signed=True) for x in v)
    return b"BM" + put(54 + len(body), 0, 54) + put(40, width, height) + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + put(0, len(body), 2835, 2835, 0, 0) + body


#: Numbers in a name by which the files of a sequence are ordered; names of digits alone are no sequence.
SEQUENCE = r"^(.*?[^0-9])([0-9]+)((?:_[0-9]+)*)$"


def images(spark: SparkSession, path: str, glob: str = "*.{ppm,bmp}") -> DataFrame:
    """A folder's numbered PPM and BMP images as RGB frames, in the order of their numbers within each name."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    stem = F.regexp_replace(F.regexp_extract("path", r"[^/]*$", 0), r"\.[^.]*$", "")
    named = listed.select("path", "content", F.regexp_extract(stem, SEQUENCE, 1).alias("name"), F.transform(F.regexp_extract_all(stem, F.lit("([0-9]+)"), F.lit(1)), lambda v: v.cast("long")).alias("numbers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                data = row.column(1)[0].as_py()
                try:
                    w, h, rgb = bmp(data) if data[:2] == b"BM" else ppm(data)
                    error = None
                except ValueError as e:
                    w = h = rgb = None
                    error = str(e)
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(2), row.column(3), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([rgb], pa.binary()), pa.array([error], pa.string())], ["path", "video", "numbers", "width", "height", "data", "error"])

    numbered = named.where("name <> ''")
    decoded = numbered.mapInArrow(run, "path string, video string, numbers array<long>, width int, height int, data binary, error string")
    # ranks need the names alone
    order = numbered.select("path", (F.row_number().over(Window.partitionBy("name").orderBy("numbers", "path")) - 1).cast("long").alias("frame_idx"))
    return decoded.join(order, "path").select("video", "frame_idx", "width", "height", F.lit("RGB3").alias("fourcc"), "data", "error")


def write_frames(frames: DataFrame, folder: str, kind: str = "ppm") -> DataFrame:
    """Writes each RGB frame as an image named by its number, by tasks that commit; returns path and bytes written."""
    from . import sinks

    sinks.save_images(frames, folder, kind)
    head = {"ppm": F.char_length(F.concat(F.lit("P6\n\n255\n"), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"))), "bmp": F.lit(54)}[kind]
    row = F.col("width") * 3 if kind == "ppm" else (F.col("width") * 3 + 3) - F.pmod(F.col("width") * 3 + 3, F.lit(4))
    return frames.select(F.concat(F.lit(f"{folder}/"), sinks.image_name(kind)).alias("path"), (head + row * F.col("height")).cast("long").alias("bytes"))


def write_clip(frames: DataFrame, path: str, start: int, end: int) -> int:
    """Frames start to end, both included, of one video as one raw file, by tasks that commit; returns the bytes written."""
    from . import sinks

    sinks.save_clip(frames, path, start, end)
    return frames.where(F.col("frame_idx").between(start, end)).agg(F.coalesce(F.sum(F.octet_length("data").cast("long")), F.lit(0))).first()[0]


#: Still formats that the JVM decodes.
STILLS = "*.{png,jpg,jpeg,gif,bmp,PNG,JPG,JPEG,GIF,BMP}"


def stills(spark: SparkSession, path: str, glob: str = STILLS) -> DataFrame:
    """A folder's PNG, JPEG, GIF and BMP images as RGB frames, decoded in the JVM by Spark's image source.

    Numbered ones are in the order of their numbers within each name, others are videos of one frame. Grey images become RGB, an
    alpha channel is dropped. An image that can't be decoded is a row with an error.
    """
    found = spark.read.format("image").option("pathGlobFilter", glob).load(path)
    image = F.col("image")
    stem = F.regexp_replace(F.regexp_extract("image.origin", r"[^/]*$", 0), r"\.[^.]*$", "")
    numbered = F.regexp_extract(stem, SEQUENCE, 1)
    name = F.when(numbered != "", numbered).otherwise(stem)
    numbers = F.when(numbered != "", F.transform(F.regexp_extract_all(stem, F.lit("([0-9]+)"), F.lit(1)), lambda v: v.cast("long")))
    good = (F.col("image.nChannels") > 0) & (F.octet_length("image.data") == F.col("image.width") * F.col("image.height") * F.col("image.nChannels"))
    named = found.select(F.col("image.origin").alias("path"), name.alias("video"), numbers.alias("numbers"), image["width"].alias("width"), image["height"].alias("height"), F.when(good, image["nChannels"]).alias("channels"), F.when(good, image["data"]).alias("bgr"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a frame at a time: they are large
                row = batch.slice(i, 1)
                w, h, c, data = (row.column(k)[0].as_py() for k in (3, 4, 5, 6))
                rgb = None if data is None else np.frombuffer(data, np.uint8).reshape(h, w, c)[:, :, [0, 0, 0] if c == 1 else [2, 1, 0]].tobytes()
                error = "an image that can't be decoded" if rgb is None else None
                size = [pa.array([v if rgb is not None else None], pa.int32()) for v in (w, h)]
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), *size, pa.array([rgb], pa.binary()), pa.array([error], pa.string())], ["path", "video", "width", "height", "data", "error"])

    decoded = named.mapInArrow(run, "path string, video string, width int, height int, data binary, error string")
    order = named.select("path", (F.row_number().over(Window.partitionBy("video").orderBy("numbers", "path")) - 1).cast("long").alias("frame_idx"))
    return decoded.join(order, "path").select("video", "frame_idx", "width", "height", F.lit("RGB3").alias("fourcc"), "data", "error")
