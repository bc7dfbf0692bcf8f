"""The registry of raw pixel formats, and what follows from a format: frame size, viewability, look-up by any of its names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PACKED, PLANAR, SEMI, RGB, BAYER, GREY = "packed yuv", "planar yuv", "semi-planar yuv", "rgb", "bayer", "grey"
#: Name, family, fourcc, bit depth, chroma subsampling across and down, bits a pixel (0: by family), planes, kernel name.
FORMATS = [
    ("YUYV (4:2:2)", PACKED, "YUYV", 8, 2, 1, 0, 1, "V4L2_PIX_FMT_YUYV"),
    ("UYVY (4:2:2)", PACKED, "UYVY", 8, 2, 1, 0, 1, "V4L2_PIX_FMT_UYVY"),
    ("YVYU (4:2:2)", PACKED, "YVYU", 8, 2, 1, 0, 1, "V4L2_PIX_FMT_YVYU"),
    ("VYUY (4:2:2)", PACKED, "VYUY", 8, 2, 1, 0, 1, "V4L2_PIX_FMT_VYUY"),
    ("Y41P (4:1:1)", PACKED, "Y41P", 8, 4, 1, 0, 1, "V4L2_PIX_FMT_Y41P"),
    ("AYUV (4:4:4)", PACKED, "AYUV", 8, 1, 1, 0, 1, "V4L2_PIX_FMT_AYUV32"),
    ("VUYA (4:4:4)", PACKED, "VUYA", 8, 1, 1, 0, 1, "V4L2_PIX_FMT_VUYA32"),
    ("Y210 (10-bit 4:2:2)", PACKED, "Y210", 10, 2, 1, 0, 1, "V4L2_PIX_FMT_Y210"),
    ("Y212 (12-bit 4:2:2)", PACKED, "Y212", 12, 2, 1, 0, 1, "V4L2_PIX_FMT_Y212"),
    ("Y216 (16-bit 4:2:2)", PACKED, "Y216", 16, 2, 1, 0, 1, "V4L2_PIX_FMT_Y216"),
    ("YUV420P10LE (10-bit 4:2:0)", PLANAR, "0T20", 10, 2, 2, 0, 1, ""),
    ("YUV422P10LE (10-bit 4:2:2)", PLANAR, "2T22", 10, 2, 1, 0, 1, ""),
    ("YUV444P10LE (10-bit 4:4:4)", PLANAR, "4T44", 10, 1, 1, 0, 1, ""),
    ("YUV420P12LE (12-bit 4:2:0)", PLANAR, "0C20", 12, 2, 2, 0, 1, ""),
    ("YUV422P12LE (12-bit 4:2:2)", PLANAR, "2C22", 12, 2, 1, 0, 1, ""),
    ("YUV444P12LE (12-bit 4:4:4)", PLANAR, "4C44", 12, 1, 1, 0, 1, ""),
    ("I420 (4:2:0)", PLANAR, "YU12", 8, 2, 2, 0, 1, "V4L2_PIX_FMT_YUV420"),
    ("YV12 (4:2:0)", PLANAR, "YV12", 8, 2, 2, 0, 1, "V4L2_PIX_FMT_YVU420"),
    ("YUV422P (4:2:2)", PLANAR, "422P", 8, 2, 1, 0, 1, "V4L2_PIX_FMT_YUV422P"),
    ("YUV411P (4:1:1)", PLANAR, "411P", 8, 4, 1, 0, 1, "V4L2_PIX_FMT_YUV411P"),
    ("YUV444P (4:4:4)", PLANAR, "444P", 8, 1, 1, 0, 1, "V4L2_PIX_FMT_YUV444"),
    ("YUV410 (4:1:0)", PLANAR, "YUV9", 8, 4, 4, 0, 1, "V4L2_PIX_FMT_YUV410"),
    ("YVU410 (4:1:0)", PLANAR, "YVU9", 8, 4, 4, 0, 1, "V4L2_PIX_FMT_YVU410"),
    ("YUV420M (4:2:0 Multi)", PLANAR, "YM12", 8, 2, 2, 0, 3, "V4L2_PIX_FMT_YUV420M"),
    ("YUV422M (4:2:2 Multi)", PLANAR, "YM16", 8, 2, 1, 0, 3, "V4L2_PIX_FMT_YUV422M"),
    ("NV12 (4:2:0)", SEMI, "NV12", 8, 2, 2, 0, 1, "V4L2_PIX_FMT_NV12"),
    ("NV21 (4:2:0)", SEMI, "NV21", 8, 2, 2, 0, 1, "V4L2_PIX_FMT_NV21"),
    ("NV16 (4:2:2)", SEMI, "NV16", 8, 2, 1, 0, 1, "V4L2_PIX_FMT_NV16"),
    ("NV61 (4:2:2)", SEMI, "NV61", 8, 2, 1, 0, 1, "V4L2_PIX_FMT_NV61"),
    ("NV24 (4:4:4)", SEMI, "NV24", 8, 1, 1, 0, 1, "V4L2_PIX_FMT_NV24"),
    ("NV42 (4:4:4)", SEMI, "NV42", 8, 1, 1, 0, 1, "V4L2_PIX_FMT_NV42"),
    ("P010 (10-bit NV12)", SEMI, "P010", 10, 2, 2, 0, 1, "V4L2_PIX_FMT_P010"),
    ("P016 (16-bit NV12)", SEMI, "P016", 16, 2, 2, 0, 1, "V4L2_PIX_FMT_P016"),
    ("P210 (10-bit NV16)", SEMI, "P210", 10, 2, 1, 0, 1, ""),
    ("P012 (12-bit NV12)", SEMI, "P012", 12, 2, 2, 0, 1, "V4L2_PIX_FMT_P012"),
    ("NV15 (10-bit packed NV12)", SEMI, "NV15", 10, 2, 2, 0, 1, "V4L2_PIX_FMT_NV15"),
    ("NV20 (10-bit packed NV16)", SEMI, "NV20", 10, 2, 1, 0, 1, "V4L2_PIX_FMT_NV20"),
    ("T010 (10-bit tiled NV12)", SEMI, "T010", 10, 2, 2, 0, 1, "V4L2_PIX_FMT_P010_4L4"),
    ("NV12M (4:2:0 Multi)", SEMI, "NM12", 8, 2, 2, 0, 2, "V4L2_PIX_FMT_NV12M"),
    ("NV21M (4:2:0 Multi)", SEMI, "NM21", 8, 2, 2, 0, 2, "V4L2_PIX_FMT_NV21M"),
    ("RGB332 (8-bit)", RGB, "RGB1", 8, 1, 1, 8, 1, "V4L2_PIX_FMT_RGB332"),
    ("RGB444 (16-bit)", RGB, "R444", 8, 1, 1, 16, 1, "V4L2_PIX_FMT_RGB444"),
    ("ARGB444 (16-bit)", RGB, "AR12", 8, 1, 1, 16, 1, "V4L2_PIX_FMT_ARGB444"),
    ("XRGB444 (16-bit)", RGB, "XR12", 8, 1, 1, 16, 1, "V4L2_PIX_FMT_XRGB444"),
    ("RGB555 (16-bit)", RGB, "RGBO", 8, 1, 1, 16, 1, "V4L2_PIX_FMT_RGB555"),
    ("ARGB555 (16-bit)", RGB, "AR15", 8, 1, 1, 16, 1, "V4L2_PIX_FMT_ARGB555"),
    ("XRGB555 (16-bit)", RGB, "XR15", 8, 1, 1, 16, 1, "V4L2_PIX_FMT_XRGB555"),
    ("RGB565 (16-bit)", RGB, "RGBP", 8, 1, 1, 16, 1, "V4L2_PIX_FMT_RGB565"),
    ("RGB555X (16-bit)", RGB, "RGBQ", 8, 1, 1, 16, 1, "V4L2_PIX_FMT_RGB555X"),
    ("RGB565X (16-bit)", RGB, "RGBR", 8, 1, 1, 16, 1, "V4L2_PIX_FMT_RGB565X"),
    ("BGR24 (24-bit)", RGB, "BGR3", 8, 1, 1, 24, 1, "V4L2_PIX_FMT_BGR24"),
    ("RGB24 (24-bit)", RGB, "RGB3", 8, 1, 1, 24, 1, "V4L2_PIX_FMT_RGB24"),
    ("BGR32 (32-bit)", RGB, "BGR4", 8, 1, 1, 32, 1, "V4L2_PIX_FMT_BGR32"),
    ("RGB32 (32-bit)", RGB, "RGB4", 8, 1, 1, 32, 1, "V4L2_PIX_FMT_RGB32"),
    ("ABGR32 (32-bit)", RGB, "AR24", 8, 1, 1, 32, 1, "V4L2_PIX_FMT_ABGR32"),
    ("ARGB32 (32-bit)", RGB, "BA24", 8, 1, 1, 32, 1, "V4L2_PIX_FMT_ARGB32"),
    ("BGRA32 (32-bit)", RGB, "RA24", 8, 1, 1, 32, 1, "V4L2_PIX_FMT_BGRA32"),
    ("RGBA32 (32-bit)", RGB, "AB24", 8, 1, 1, 32, 1, "V4L2_PIX_FMT_RGBA32"),
    ("XBGR32 (32-bit)", RGB, "XR24", 8, 1, 1, 32, 1, "V4L2_PIX_FMT_XBGR32"),
    ("XRGB32 (32-bit)", RGB, "XB24", 8, 1, 1, 32, 1, "V4L2_PIX_FMT_XRGB32"),
    ("BGRX32 (32-bit)", RGB, "RX24", 8, 1, 1, 32, 1, "V4L2_PIX_FMT_BGRX32"),
    ("RGBX32 (32-bit)", RGB, "BX24", 8, 1, 1, 32, 1, "V4L2_PIX_FMT_RGBX32"),
    ("HSV24 (24-bit)", RGB, "HSV3", 8, 1, 1, 24, 1, "V4L2_PIX_FMT_HSV24"),
    ("HSV32 (32-bit)", RGB, "HSV4", 8, 1, 1, 32, 1, "V4L2_PIX_FMT_HSV32"),
    ("Bayer RGGB (8-bit)", BAYER, "RGGB", 8, 1, 1, 0, 1, "V4L2_PIX_FMT_SRGGB8"),
    ("Bayer BGGR (8-bit)", BAYER, "BGGR", 8, 1, 1, 0, 1, "V4L2_PIX_FMT_SBGGR8"),
    ("Bayer GBRG (8-bit)", BAYER, "GBRG", 8, 1, 1, 0, 1, "V4L2_PIX_FMT_SGBRG8"),
    ("Bayer GRBG (8-bit)", BAYER, "GRBG", 8, 1, 1, 0, 1, "V4L2_PIX_FMT_SGRBG8"),
    ("Bayer RGGB (10-bit)", BAYER, "RG10", 10, 1, 1, 0, 1, "V4L2_PIX_FMT_SRGGB10"),
    ("Bayer BGGR (10-bit)", BAYER, "BG10", 10, 1, 1, 0, 1, "V4L2_PIX_FMT_SBGGR10"),
    ("Bayer GBRG (10-bit)", BAYER, "GB10", 10, 1, 1, 0, 1, "V4L2_PIX_FMT_SGBRG10"),
    ("Bayer GRBG (10-bit)", BAYER, "BA10", 10, 1, 1, 0, 1, "V4L2_PIX_FMT_SGRBG10"),
    ("Bayer RGGB (10-bit packed)", BAYER, "pRAA", 10, 1, 1, 0, 1, "V4L2_PIX_FMT_SRGGB10P"),
    ("Bayer BGGR (10-bit packed)", BAYER, "pBAA", 10, 1, 1, 0, 1, "V4L2_PIX_FMT_SBGGR10P"),
    ("Bayer GBRG (10-bit packed)", BAYER, "pGAA", 10, 1, 1, 0, 1, "V4L2_PIX_FMT_SGBRG10P"),
    ("Bayer GRBG (10-bit packed)", BAYER, "pGBA", 10, 1, 1, 0, 1, "V4L2_PIX_FMT_SGRBG10P"),
    ("Bayer RGGB (12-bit)", BAYER, "RG12", 12, 1, 1, 0, 1, "V4L2_PIX_FMT_SRGGB12"),
    ("Bayer BGGR (12-bit)", BAYER, "BG12", 12, 1, 1, 0, 1, "V4L2_PIX_FMT_SBGGR12"),
    ("Bayer GBRG (12-bit)", BAYER, "GB12", 12, 1, 1, 0, 1, "V4L2_PIX_FMT_SGBRG12"),
    ("Bayer GRBG (12-bit)", BAYER, "BA12", 12, 1, 1, 0, 1, "V4L2_PIX_FMT_SGRBG12"),
    ("Bayer RGGB (16-bit)", BAYER, "RG16", 16, 1, 1, 0, 1, "V4L2_PIX_FMT_SRGGB16"),
    ("Bayer BGGR (16-bit)", BAYER, "BG16", 16, 1, 1, 0, 1, "V4L2_PIX_FMT_SBGGR16"),
    ("Bayer GBRG (16-bit)", BAYER, "GB16", 16, 1, 1, 0, 1, "V4L2_PIX_FMT_SGBRG16"),
    ("Bayer GRBG (16-bit)", BAYER, "GR16", 16, 1, 1, 0, 1, "V4L2_PIX_FMT_SGRBG16"),
    ("Greyscale (8-bit)", GREY, "GREY", 8, 1, 1, 0, 1, "V4L2_PIX_FMT_GREY"),
    ("Greyscale (10-bit)", GREY, "Y10 ", 10, 1, 1, 0, 1, "V4L2_PIX_FMT_Y10"),
    ("Greyscale (12-bit)", GREY, "Y12 ", 12, 1, 1, 0, 1, "V4L2_PIX_FMT_Y12"),
    ("Greyscale (16-bit)", GREY, "Y16 ", 16, 1, 1, 0, 1, "V4L2_PIX_FMT_Y16"),
    ("Greyscale (10-bit BE packed)", GREY, "Y10B", 10, 1, 1, 0, 1, "V4L2_PIX_FMT_Y10BPACK"),
    ("Greyscale (10-bit MIPI)", GREY, "Y10P", 10, 1, 1, 0, 1, "V4L2_PIX_FMT_Y10P"),
]
#: Formats that can be shown; of the mosaics and greys all can.
VIEWABLE = {"YU12", "YV12", "0T20", "2T22", "4T44", "0C20", "2C22", "4C44", "422P", "444P", "NV12", "NV21", "P010", "P012", "P016", "P210", "T010", "NV15", "NV20", "YUYV", "UYVY", "Y210", "Y212", "Y216", "RGB3", "BGR3"}
#: Bytes of a frame as a fraction of its pixels, where the family's rule doesn't give them: fixed values.
BYTES = {"NV15": (15, 8), "NV20": (5, 2), "P010": (3, 1), "P012": (3, 1), "P016": (3, 1), "T010": (3, 1), "P210": (4, 1), "AYUV": (4, 1), "VUYA": (4, 1), "Y41P": (3, 2), "Y210": (4, 1), "Y212": (4, 1), "Y216": (4, 1), "pRAA": (5, 4), "pBAA": (5, 4), "pGAA": (5, 4), "pGBA": (5, 4), "Y10B": (5, 4), "Y10P": (5, 4)}
COLUMNS = "format_idx int, name string, family string, fourcc string, bit_depth int, h_sub int, v_sub int, bpp int, planes int, kernel_name string"
BY_FOURCC = {f[2]: f for f in FORMATS}


def frame_bytes(fourcc: str, width: int, height: int) -> int:
    """Bytes of a frame of a listed format."""
    _, family, _, depth, h, v, bpp, _, _ = BY_FOURCC[fourcc]
    pixels, wide = width * height, 2 if depth > 8 else 1
    if fourcc in BYTES:
        top, bottom = BYTES[fourcc]
        return pixels * top // bottom
    if family == RGB:
        return pixels * bpp // 8
    if family in (BAYER, GREY):
        return pixels * wide
    if family == PACKED:
        return pixels * 2
    if fourcc in ("YU12", "YV12", "YM12", "NV12", "NV21", "NM12", "NM21"):
        return pixels * 3 // 2
    if h * v <= 2 and fourcc != "411P":
        return (pixels + 2 * pixels // (h * v)) * wide
    chroma = (width // h) * (height // v)
    return pixels * 3 if fourcc in ("0T20", "0C20") else pixels + 2 * chroma


def viewable(fourcc: str) -> bool:
    return fourcc in VIEWABLE or BY_FOURCC[fourcc][1] in (BAYER, GREY)


def registry(spark: SparkSession) -> DataFrame:
    """The formats as a table of fixed size, safe to broadcast."""
    rows = [(i, *f) for i, f in enumerate(FORMATS)]
    return spark.createDataFrame(rows, COLUMNS)


def name_table(spark: SparkSession) -> DataFrame:
    """Each key a format can be named by, with its place: full names first, then short ones, of which the first listed wins."""
    exact, loose = {}, {}
    for i, f in enumerate(FORMATS):
        exact[f"{f[0]} [{f[2]}]"] = i
        exact.setdefault(f[0], i)
        for key in (f[0].split(" ")[0], f[2], f[2].strip()):
            loose.setdefault(key, i)
    return spark.createDataFrame(sorted((loose | exact).items()), "key string, format_idx int")


def look_up(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key names a format, with it."""
    spark = rows.sparkSession
    named = F.broadcast(name_table(spark).withColumnRenamed("key", key))
    return rows.join(named, key).join(F.broadcast(registry(spark)), "format_idx")


def frame_size(fourcc: Column, width: Column, height: Column) -> Column:
    """frame_bytes as an expression; null for unlisted formats."""
    pixels = width.cast("long") * height
    out = F.lit(None).cast("long")
    for code, (name, family, _, depth, h, v, bpp, _, _) in BY_FOURCC.items():
        wide = 2 if depth > 8 else 1
        if code in BYTES:
            size = F.floor(pixels * BYTES[code][0] / BYTES[code][1])
        elif family == RGB:
            size = F.floor(pixels * bpp / 8)
        elif family in (BAYER, GREY):
            size = pixels * wide
        elif family == PACKED:
            size = pixels * 2
        elif code in ("YU12", "YV12", "YM12", "NV12", "NV21", "NM12", "NM21"):
            size = F.floor(pixels * 3 / 2)
        elif h * v <= 2 and code != "411P":
            size = (pixels + F.floor(2 * pixels / (h * v))) * wide
        elif code in ("0T20", "0C20"):
            size = pixels * 3
        else:
            size = pixels + 2 * F.floor(width / h) * F.floor(height / v)
        out = F.when(fourcc == code, size).otherwise(out)
    return out


def by_family(spark: SparkSession) -> DataFrame:
    """The formats of each family, in order."""
    listed = registry(spark).groupBy("family").agg(F.sort_array(F.collect_list(F.struct("format_idx", "name"))).alias("f"))
    return listed.select("family", F.size("f").cast("long").alias("n"), F.array_join(F.col("f.name"), "; ").alias("names"))


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("k = 1").drop("k")
