"""Parameters of raw files from their names and sizes, as column expressions and joins with small fixed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats

#: Named picture sizes: label, aliases, width, height, whether sizes are guessed from it. Fixed values.
RESOLUTIONS = [
    ("SQCIF", ["sqcif"], 128, 96, True), ("QCIF", ["qcif"], 176, 144, True), ("SIF", ["sif"], 352, 240, True), ("CIF", ["cif"], 352, 288, True),
    ("2CIF", ["2cif"], 704, 288, True), ("4CIF", ["4cif"], 704, 576, True), ("16CIF", ["16cif"], 1408, 1152, False),
    ("D1 NTSC", ["d1", "ntsc"], 720, 480, True), ("D1 PAL", ["sd", "pal", "576p"], 720, 576, True),
    ("QQVGA", ["qqvga"], 160, 120, False), ("QVGA", ["qvga", "240p"], 320, 240, True), ("HVGA", ["hvga"], 480, 320, False), ("360p", ["360p"], 640, 360, False),
    ("VGA", ["vga", "480p"], 640, 480, True), ("WVGA", ["wvga"], 800, 480, False), ("HEVC C", ["classc", "hevc_c"], 832, 480, True), ("SVGA", ["svga"], 800, 600, True),
    ("XGA", ["xga"], 1024, 768, True), ("WXGA", ["wxga"], 1280, 800, False), ("SXGA", ["sxga"], 1280, 1024, False), ("WSXGA+", ["wsxga"], 1680, 1050, False),
    ("UXGA", ["uxga"], 1600, 1200, False), ("WUXGA", ["wuxga"], 1920, 1200, False), ("QXGA", ["qxga"], 2048, 1536, False), ("WQXGA", ["wqxga"], 2560, 1600, False),
    ("qHD", ["qhd"], 960, 540, False), ("720p", ["hd", "720p"], 1280, 720, True), ("1080p", ["fhd", "fullhd", "1080p"], 1920, 1080, True),
    ("1440p", ["wqhd", "1440p", "2k"], 2560, 1440, True), ("4K UHD", ["uhd", "4kuhd", "4k", "2160p"], 3840, 2160, True), ("8K UHD", ["8k", "4320p"], 7680, 4320, False),
]
#: Spellings of formats in file names, and the fourcc they mean. Fixed values.
ALIASES = {
    "i420": "YU12", "yuv420p": "YU12", "yuv420": "YU12", "yv12": "YV12", "nv12": "NV12", "nv21": "NV21", "nv16": "NV16", "nv61": "NV61", "yuv422p": "422P", "yuv422": "422P",
    "yuv444p": "444P", "yuv444": "444P", "yuyv": "YUYV", "yuy2": "YUYV", "uyvy": "UYVY", "yvyu": "YVYU", "rgb24": "RGB3", "rgb": "RGB3", "bgr24": "BGR3", "bgr": "BGR3",
    "grey": "GREY", "gray": "GREY", "yuv420p10le": "0T20", "yuv420p10": "0T20", "yuv422p10le": "2T22", "yuv422p10": "2T22", "yuv444p10le": "4T44", "yuv444p10": "4T44",
    "p010": "P010", "p016": "P016", "p210": "P210", "y210": "Y210", "y212": "Y212", "y216": "Y216", "p012": "P012", "nv15": "NV15", "nv20": "NV20", "t010": "T010",
    "y10b": "Y10B", "y10bpack": "Y10B", "y10p": "Y10P", "yuv420p12le": "0C20", "yuv420p12": "0C20", "yuv422p12le": "2C22", "yuv422p12": "2C22", "yuv444p12le": "4C44", "yuv444p12": "4C44",
}
RATES = [1.0, 5.0, 10.0, 15.0, 24.0, 25.0, 29.97, 30.0, 50.0, 59.94, 60.0, 120.0]
GUESSED = ["YU12", "NV12", "YUYV", "RGB3"]
LISTED = ["YU12", "YV12", "NV12", "NV21", "422P", "NV16", "NV61", "YUYV", "UYVY", "YVYU", "444P", "RGB3", "BGR3", "GREY"]
EDGE = r"[_.\-/\\]"


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"[^/\\]*$", 0), r"\.[^.]*$", "")


def size_in(text: Column) -> tuple[Column, Column]:
    """The first WxH between separators with both from 16 to 8192."""
    found = F.regexp_extract_all(text, F.lit(rf"(?:^|(?<={EDGE}))([0-9]{{2,4}}[xX][0-9]{{2,4}})(?={EDGE}|$)"), F.lit(1))
    pairs = F.transform(found, lambda t: F.transform(F.split(F.lower(t), "x"), lambda v: v.cast("int")))
    good = F.filter(pairs, lambda p: p[0].between(16, 8192) & p[1].between(16, 8192))
    return F.get(F.get(good, 0), 0), F.get(F.get(good, 0), 1)


def lookup(tokens: Column, table: dict[str, str]) -> Column:
    """What the first token listed stands for."""
    names = F.create_map(*(F.lit(v) for kv in table.items() for v in kv))
    return F.get(F.filter(F.transform(tokens, lambda t: F.try_element_at(names, t)), lambda v: v.isNotNull()), 0)


def filename_hints(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds width, height, fourcc, fps and bit_depth, each null where the name doesn't say."""
    name = stem(F.col(path))
    low = F.lower(name)
    tokens = lambda s: F.filter(F.split(s, EDGE), lambda t: t != "")
    w1, h1 = size_in(name)
    w2, h2 = size_in(F.col(path))
    sizes = {a: f"{w}x{h}" for _, aliases, w, h, _ in RESOLUTIONS for a in aliases}
    named = lookup(tokens(low), sizes)
    part = lambda i: F.split(named, "x")[i].cast("int")
    usable = {a: c for a, c in ALIASES.items() if formats.viewable(c)} | {c.strip().lower(): c for c in formats.BY_FOURCC if formats.viewable(c) and c.strip().lower() not in ALIASES}
    exact = {c: c for c in formats.BY_FOURCC if formats.viewable(c)}
    rates = F.filter(F.transform(F.regexp_extract_all(low, F.lit(r"([0-9]+(?:\.[0-9]+)?)fps"), F.lit(1)), lambda v: v.cast("double")), lambda v: v.between(0.1, 240.0))
    bare = F.filter(F.transform(tokens(low), lambda t: F.when(t.rlike("^[0-9]+$"), t.try_cast("double"))), lambda v: v.isin(RATES))
    depth = F.filter(F.transform(F.regexp_extract_all(low, F.lit(rf"(?:^|(?<={EDGE}))([0-9]+)bit(?={EDGE}|$)"), F.lit(1)), lambda v: v.try_cast("int")), lambda v: v.isin(8, 10, 12, 16))
    return files.withColumns({
        "width": F.coalesce(w1, w2, part(0)), "height": F.coalesce(h1, h2, part(1)),
        "fourcc": F.coalesce(lookup(tokens(low), usable), lookup(tokens(name), exact)),
        "fps": F.coalesce(F.get(rates, 0), F.get(bare, 0)), "bit_depth": F.get(depth, 0),
    })


def candidates(spark: SparkSession, codes: list[str]) -> DataFrame:
    """Sizes and formats that files are held against, largest pictures first: a table of fixed size."""
    sizes = sorted((r for r in RESOLUTIONS if r[4]), key=lambda r: -r[2] * r[3])
    rows = [(i * len(codes) + j, w, h, c, formats.frame_bytes(c, w, h)) for i, (_, _, w, h, _) in enumerate(sizes) for j, c in enumerate(codes) if formats.viewable(c)]
    return spark.createDataFrame(rows, "ord int, width int, height int, fourcc string, frame_bytes long")


def with_candidates(files: DataFrame, codes: list[str]) -> DataFrame:
    """Files with each candidate whose frames fill them exactly; the candidates ride along as one literal array."""
    listed = sorted(candidates(files.sparkSession, codes).collect())
    array = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("ord", "width", "height", "fourcc", "frame_bytes"), r))) for r in listed))
    fits = F.filter(array, lambda c: (F.col("size") > 0) & (F.col("size") % c["frame_bytes"] == 0))
    return files.withColumn("c", F.explode(fits)).select(*files.columns, "c.*", F.floor(F.col("size") / F.col("c.frame_bytes")).alias("frames"))


def guess_first(files: DataFrame) -> DataFrame:
    """The first candidate for each size."""
    return formats.first_of(with_candidates(files, GUESSED), files.columns, [F.col("ord")]).drop("ord")


def guess_all(files: DataFrame) -> DataFrame:
    return with_candidates(files, LISTED).drop("ord")


def guess_with_count(files: DataFrame, count: Column) -> DataFrame:
    """Candidates that give that number of frames."""
    return guess_all(files).where(F.col("frames") == count)


def resolved(files: DataFrame, default: tuple[int, int, str] = (640, 480, "YU12")) -> DataFrame:
    """Width, height and format by name, then size, then default; files are (path, size)."""
    hinted = filename_hints(files)
    guessed = guess_first(files.select("size").distinct()).select("size", F.col("width").alias("gw"), F.col("height").alias("gh"), F.col("fourcc").alias("gf"))
    joined = hinted.join(guessed, "size", "left")
    w, h, f = default
    known = F.col("width").isNotNull() & F.col("height").isNotNull()
    return joined.select("path", "size", F.when(known, F.col("width")).otherwise(F.coalesce("gw", F.lit(w))).alias("width"), F.when(known, F.col("height")).otherwise(F.coalesce("gh", F.lit(h))).alias("height"), F.coalesce("fourcc", F.when(~known, F.col("gf")), F.lit(f)).alias("fourcc"))
