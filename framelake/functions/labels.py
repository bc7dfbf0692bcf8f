"""Column expressions on labels and codes: frame types, block modes, NAL headers, intra modes, tiers and texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modes in the order in which a label is searched for them.
MODES = ["skip", "merge", "intra", "inter"]
MODE_RANK = {"inter": 0, "intra": 1, "skip": 2, "merge": 3, "other": 4}


def mode_class(label: Column) -> Column:
    low = F.lower(label)
    found = F.lit("other")
    for mode in reversed(MODES):
        found = F.when(low.contains(mode), mode).otherwise(found)
    return found


def mode_rank(mode: Column) -> Column:
    rank = F.lit(MODE_RANK["other"])
    for name, k in MODE_RANK.items():
        rank = F.when(mode == name, k).otherwise(rank)
    return rank


def frame_type_class(label: Column) -> Column:
    """I, P, B or Other; IDR, BLA and CRA pictures count as I."""
    up = F.upper(label)
    return F.when((up == "I") | (up == "KEY") | up.rlike("^(IDR|BLA|CRA)"), "I").when(up == "P", "P").when(up == "B", "B").otherwise("Other")


def opens_sequence(label: Column) -> Column:
    """Whether a frame type starts a coded video sequence."""
    return F.upper(label).isin("IDR", "BLA", "KEY")


def ref_tier(count: Column) -> Column:
    return F.when(count <= 0, 0).when(count == 1, 1).when(count <= 3, 2).otherwise(3)


def mv_pixels(x: Column, y: Column) -> Column:
    """Length of a quarter-sample vector in pixels, by the sum of its sides."""
    return (F.abs(x) + F.abs(y)) / 4.0


def lod_cell(codec: Column) -> Column:
    return F.when(F.lower(codec).contains("hevc") | F.lower(codec).contains("265"), 64).otherwise(32)


def lambda_scale(q8: Column) -> Column:
    return q8 / 256.0


def normalized(value: Column, least: Column, most: Column) -> Column:
    """Between its bounds from 0 to 1; equal bounds give 1."""
    return F.when(most <= least, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - least) / (most - least))))


def intra_angle_hevc(mode: Column) -> Column:
    """Degrees of an angular mode; null for planar, DC and what is out of range."""
    return F.when(mode.between(2, 34), 225.0 - (mode - 2) * 5.625)


def zscan_to_raster(k: Column) -> Column:
    """Of sixteen sub-blocks: place in z-order to place in raster order."""
    q, z = F.shiftright(k, 2), k.bitwiseAND(3)
    return F.shiftright(q, 1) * 8 + F.shiftright(z, 1) * 4 + q.bitwiseAND(1) * 2 + z.bitwiseAND(1)


#: Names of HEVC NAL unit types, first type and last: fixed values.
HEVC_NAMES = {
    (0, 0): "TRAIL_N", (1, 1): "TRAIL_R", (2, 2): "TSA_N", (3, 3): "TSA_R", (4, 4): "STSA_N", (5, 5): "STSA_R", (6, 6): "RADL_N", (7, 7): "RADL_R", (8, 8): "RASL_N", (9, 9): "RASL_R",
    (10, 10): "RSV_VCL_N", (11, 11): "RSV_VCL_R", (12, 12): "RSV_VCL_N", (13, 13): "RSV_VCL_R", (14, 14): "RSV_VCL_N", (15, 15): "RSV_VCL_R",
    (16, 16): "BLA_W_LP", (17, 17): "BLA_W_RADL", (18, 18): "BLA_N_LP", (19, 19): "IDR_W_RADL", (20, 20): "IDR_N_LP", (21, 21): "CRA_NUT", (22, 23): "RSV_IRAP_VCL", (24, 31): "RSV_VCL",
    (32, 32): "VPS_NUT", (33, 33): "SPS_NUT", (34, 34): "PPS_NUT", (35, 35): "AUD_NUT", (36, 36): "EOS_NUT", (37, 37): "EOB_NUT", (38, 38): "FD_NUT", (39, 39): "PREFIX_SEI_NUT", (40, 40): "SUFFIX_SEI_NUT", (41, 47): "RSV_NVCL",
}
#: Names of AVC NAL unit types, first type and last: fixed values.
AVC_NAMES = {
    (1, 1): "Slice (non-IDR)", (2, 2): "Slice partition A", (3, 3): "Slice partition B", (4, 4): "Slice partition C", (5, 5): "Slice (IDR)", (6, 6): "SEI", (7, 7): "SPS", (8, 8): "PPS", (9, 9): "AUD",
    (10, 10): "End of sequence", (11, 11): "End of stream", (12, 12): "Filler", (13, 13): "SPS extension", (14, 14): "Prefix NAL", (15, 15): "Subset SPS", (16, 16): "DPS", (17, 18): "Reserved",
    (19, 19): "Aux slice", (20, 20): "Slice extension", (21, 21): "Slice ext (depth)", (22, 23): "Reserved",
}


def nal_name(code: Column, codec: str) -> Column:
    names, rest = (HEVC_NAMES, "UNSPEC") if codec == "hevc" else (AVC_NAMES, "Unspecified")
    table = F.create_map(*(F.lit(v) for (low, high), name in names.items() for k in range(low, high + 1) for v in (k, name)))
    return F.coalesce(F.try_element_at(table, code), F.lit(rest))


def nal_fields(first: Column, second: Column, codec: str) -> dict[str, Column]:
    """The header fields of a NAL unit from its first two bytes, as integers."""
    if codec == "hevc":
        return {
            "forbidden": F.shiftright(first, 7), "nal_type": F.shiftright(first, 1).bitwiseAND(63),
            "layer_id": first.bitwiseAND(1) * 32 + F.shiftright(second, 3), "temporal_id": second.bitwiseAND(7) - 1, "nal_ref_idc": F.lit(None).cast("int"),
        }
    return {
        "forbidden": F.shiftright(first, 7), "nal_type": first.bitwiseAND(31), "layer_id": F.lit(None).cast("int"),
        "temporal_id": F.lit(None).cast("int"), "nal_ref_idc": F.shiftright(first, 5).bitwiseAND(3),
    }


def is_vcl(nal_type: Column, codec: str) -> Column:
    return nal_type < 32 if codec == "hevc" else nal_type.between(1, 5)


def opens_access_unit(nal_type: Column, codec: str) -> Column:
    """Whether a unit that holds no picture data starts a new access unit."""
    codes = [32, 33, 34, 35, 39, 41, 42, 43, 44] if codec == "hevc" else [6, 7, 8, 9, 13, 14, 15, 16]
    return nal_type.isin(codes)


def grouped_digits(bits: Column) -> Column:
    return F.format_number(bits, 0)


def has_bit(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


#: Half of a right angle's slope, in degrees; and the directions of AVC modes for small blocks and whole macroblocks: fixed values.
HALF = 26.56505
AVC_SMALL = {0: 90.0, 1: 0.0, 3: 45.0, 4: 135.0, 5: 90.0 + HALF, 6: 180.0 - HALF, 7: 90.0 - HALF, 8: HALF}
AVC_LARGE = {1: 0.0, 2: 90.0}


def looked_up(value: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), value)


def intra_angle_avc(mode: Column, large: bool = False) -> Column:
    """Degrees of a directional mode; null for the others."""
    return looked_up(mode, AVC_LARGE if large else AVC_SMALL)


def intra_badge(name: Column, mode: Column) -> Column:
    """DC or P (planar, plane) for modes without direction, else empty."""
    small = name.isin("intra4x4_pred_mode", "intra8x8_pred_mode") & mode.isin(2, 9, 10, 11)
    large = name == "intra16x16_pred_mode"
    luma = name == "intra_luma_pred_mode"
    return F.when(small | (large & mode.isin(0, 4, 5, 6)) | (luma & (mode == 1)), "DC").when((large & (mode == 3)) | (luma & (mode == 0)), "P").otherwise("")


def level_at(levels: Column, scan: Column) -> Column:
    """Coefficient levels put where the scan says: an array indexed by position, zeros elsewhere."""
    last = F.greatest(F.lit(-1), F.array_max(scan))
    by = F.map_from_arrays(scan, levels)
    return F.when(F.size(levels) == 0, F.expr("cast(array() as array<int>)")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.try_element_at(by, i), F.lit(0))))


def coeff_columns(count: Column, group_w: Column, group_h: Column, width: Column) -> Column:
    """Columns of a coefficient grid: of its 4 x 4 groups if they fill it, else the transform's width if that divides it, else one row."""
    return F.when((group_w > 0) & (16 * group_w * group_h == count), 4 * group_w).when((width > 0) & (count % width == 0), width).otherwise(count)


def quality_colour(t: Column) -> Column:
    """Red over amber to green for 0 to 1."""
    mix = lambda low, high: F.floor(low * (1 - t) + high * t).cast("int")
    return F.array(mix(220.0, 30.0), mix(45.0, 210.0), mix(35.0, 70.0))


def metric_colour(kind: str, value: Column) -> Column:
    """The colour of a tile: signed differences green or red by size, qualities on their own scales."""
    if kind == "signed":
        size = F.floor(40 + 215.0 * F.least(F.abs(value), F.lit(64.0)) / 64).cast("int")
        return F.when(value >= 0, F.array(F.lit(20), size, F.lit(40))).otherwise(F.array(size, F.lit(35), F.lit(25)))
    low, span = {"psnr": (20.0, 30.0), "ssim": (0.85, 0.15), "vmaf": (0.0, 100.0)}[kind]
    return quality_colour(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.least(value, F.lit(1e6)) - low) / span)))


def is_transform_skip(mode: Column) -> Column:
    """Whether a transform's name says that it was skipped."""
    return F.coalesce(mode.contains("skip"), F.lit(False))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value evaluated once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def rounded_text(value: Column, places: int, plus: bool = False) -> Column:
    """A number with so many decimals, rounded by its exact binary value and a half to the even digit, as C's printf does.

    Java's formatter rounds the shortest decimal up instead (0.125 to 0.13, 0.15 to 0.2). The value is split in two
    parts of few bits, whose products with a power of ten are exact, so what lies beyond the last digit is compared exactly.
    Numbers beyond 2^52 units of the last digit are left to Java's formatter.
    """
    scale = 10**places

    def digits(size: Column) -> Column:
        # 2^27 + 1 parts a double's 53 bits in halves
        wide = size * 134217729.0
        high = wide - (wide - size)
        floor = F.floor(size * scale)
        beyond = (high * scale - floor - 0.5) + (size - high) * scale
        # below -0.5 the product was rounded up to a whole number, which is then the nearest
        up = lambda x: x["floor"] + ((x["beyond"] > 0) | ((x["beyond"] == 0) & (x["floor"] % 2 == 1))).cast("long")
        return once(F.struct(floor.alias("floor"), beyond.alias("beyond")), up)

    def written(n: Column) -> Column:
        last = F.pmod(n, F.lit(scale))
        whole = ((n - last) / scale).cast("long").cast("string")
        return F.concat(whole, F.lit("."), F.lpad(last.cast("string"), places, "0")) if places else whole

    def text(v: Column) -> Column:
        size = F.abs(v)
        sign = F.when(F.substring(v.cast("string"), 1, 1) == "-", "-").otherwise("+" if plus else "")
        number = F.when(size == float("inf"), "inf").when(size * scale < 2.0**52, once(digits(size), written)).otherwise(F.format_string(f"%.{places}f", size))
        return F.when(v.isNull(), None).when(F.isnan(v), "NaN").otherwise(F.concat(sign, number))

    return once(value.cast("double"), text)


def metric_text(kind: str, value: Column) -> Column:
    """A tile's value beside the picture: a signed difference, decibels (infinity as its sign), ms_ssim or vmaf."""
    if kind == "ms_psnr":
        return F.when(F.abs(value) == float("inf"), "\u221e dB").otherwise(F.concat(rounded_text(value, 1), F.lit(" dB")))
    places, plus = {"signed": (1, True), "ms_ssim": (4, False), "vmaf": (1, False)}[kind]
    return rounded_text(value, places, plus)


def quality_text(kind: str, value: Column) -> Column:
    """A block's quality: psnr with one decimal, `e` where it is exact; ssim with three."""
    if kind == "psnr":
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), "e").otherwise(rounded_text(value, 1))
    return rounded_text(value, 3)


#: Decimals that a block's value is told with, by what the block is filled by; other fills tell the QP.
FILL_PLACES = {"bpp": 2, "mv": 1, "coeff": 1, "nz": 2}


def fill_text(fill: str, value: Column, qp: Column) -> Column:
    """A block's value in words: mode by its name, numbers with their decimals, and the QP for fills that blocks have no value of."""
    if fill == "mode":
        return value
    return rounded_text(value.cast("double"), FILL_PLACES[fill]) if fill in FILL_PLACES else rounded_text(qp.cast("double"), 0)


#: What camera side data call their classes, by number: fixed values.
SIDE_CLASSES = {"iso": ["Low", "Med", "High"], "exposure": ["Stable", "Converging", "Hunting"], "histogram": ["Normal", "LowKey", "HighKey", "Bimodal"]}


def side_class(kind: str, value: Column) -> Column:
    """The name of a class of side data, or its number where it has none."""
    return F.coalesce(looked_up(value.cast("int"), dict(enumerate(SIDE_CLASSES[kind]))), value.cast("string"))


def dynamic_range_text(sixteenths: Column) -> Column:
    return F.concat(rounded_text(sixteenths / 16.0, 1), F.lit(" stops"))


def distortion_text(hundredths: Column) -> Column:
    return rounded_text(hundredths / 100.0, 2)


def listed(name: str, **parts: Column) -> Column:
    return F.concat(F.lit(f"{name}("), F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in parts.items())), F.lit(")"))


def side_frame_text(id: Column, scene: Column, noise: Column, motion: Column, qp_bias: Column, iso: Column, exposure: Column, units: Column) -> Column:
    """A frame of side data in a line."""
    return listed("Frame", id=id, scene=scene, noise=noise, motion=motion, qp_bias=qp_bias, iso=iso, ae=exposure, ctus=units)


def side_unit_text(activity: Column, flatness: Column, edges: Column, qp_delta: Column, lambda_q8: Column) -> Column:
    """A coding tree unit of side data in a line."""
    return listed("CTU", act=activity, flat=flatness, edge=edges, qp_delta=qp_delta, **{"lambda": rounded_text(lambda_scale(lambda_q8), 3)})


def guess_text(width: Column, height: Column, name: Column, frames: Column) -> Column:
    """A guess of a raw file's size in words."""
    return F.format_string("%dx%d %s (%d frames)", width, height, name, frames)
