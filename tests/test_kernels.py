"""Pixel kernels: neutral grey in every format, primaries there and back, demosaicing, resampling."""

import numpy as np
import pytest

from framelake.functions import formats, kernels

W, H = 16, 16


def grey_frame(fourcc):
    """All samples at half."""
    _, family, _, depth, h, v, _, _, _ = formats.BY_FOURCC[fourcc]
    n = formats.frame_bytes(fourcc, W, H)
    if fourcc in ("NV15", "NV20"):
        return (np.full(n // 5, 0x8020080200, np.uint64)[:, None] >> (np.arange(5, dtype=np.uint64) * np.uint64(8)) & np.uint64(255)).astype(np.uint8).tobytes()
    if fourcc == "Y10B":
        return bytes([0x80, 0x20, 0x08, 0x02, 0x00]) * (n // 5)
    if fourcc == "Y10P" or fourcc[0] == "p":
        return bytes([128] * 4 + [0]) * (n // 5)
    if depth > 8:
        high = family in (formats.SEMI, formats.PACKED)
        return np.full(n // 2, 0x8000 if high else 1 << (depth - 1), "<u2").tobytes()
    return bytes([128]) * n


@pytest.mark.parametrize("fourcc", [c for c in formats.BY_FOURCC if formats.viewable(c)])
def test_grey(fourcc):
    rgb = kernels.rgb_of(grey_frame(fourcc), fourcc, W, H)
    assert rgb.shape == (H, W, 3)
    assert np.abs(rgb.astype(int) - 128).max() <= 1


@pytest.mark.parametrize("fourcc", [*kernels.BYTE_ORDER, *kernels.BIT_FIELDS])
def test_rgb_there_and_back(fourcc):
    rgb = np.zeros((H, W, 3), np.uint8)
    rgb[:4, :, 0], rgb[4:8, :, 1], rgb[8:12, :, 2] = 255, 255, 255
    data = kernels.rgb_to(rgb, fourcc)
    assert len(data) == formats.frame_bytes(fourcc, W, H)
    back = kernels.rgb_of(data, fourcc, W, H)
    bits = [b for b, _ in kernels.BIT_FIELDS.get(fourcc, ((8, 0),) * 3)]
    for i, b in enumerate(bits):
        assert (back[:, :, i] == rgb[:, :, i] >> (8 - b) << (8 - b)).all()


@pytest.mark.parametrize("dst", ["YV12", "NV12", "NV21", "422P", "NV16", "NV61", "444P", "NV24", "NV42", "YUYV", "UYVY", "YVYU", "VYUY", "AYUV", "VUYA"])
def test_yuv_planes_survive(dst):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 256, (H, W), dtype=np.uint8)
    flat = y.tobytes() + bytes([90]) * (W * H // 4) + bytes([200]) * (W * H // 4)
    data = kernels.converted(flat, "YU12", dst, W, H)
    assert len(data) == formats.frame_bytes(dst, W, H)
    y2, u2, v2 = kernels.planes_of(data, dst, W, H)
    assert (y2 == y).all() and (u2 == 90).all() and (v2 == 200).all()
    assert kernels.converted(data, dst, "YU12", W, H) == flat


def test_mosaic_takes_neighbours():
    values = np.array([[10, 20, 30, 40], [50, 60, 70, 80], [90, 100, 110, 120], [130, 140, 150, 160]], np.uint8)
    out = kernels.mosaic(values, "RGGB")
    assert out[0, 0].tolist() == [10, (20 + 50) // 2, 60]
    assert out[1, 1].tolist() == [(10 + 30 + 90 + 110) // 4, (20 + 50 + 70 + 100) // 4, 60]
    assert out[0, 1].tolist() == [(10 + 30) // 2, 20, 60]


def test_bad_input():
    with pytest.raises(ValueError):
        kernels.rgb_of(b"123", "YU12", W, H)
    with pytest.raises(ValueError):
        kernels.rgb_of(b"", "none", W, H)


def test_upsampling():
    plane = np.array([[0, 100], [50, 200]], np.uint8)
    assert kernels.nearest(plane, 4, 4)[0].tolist() == [0, 0, 100, 100]
    assert kernels.bilinear(plane, 4, 2)[0].tolist() == [0, 50, 100, 100]


def test_frame_size_expression(spark):
    from pyspark.sql import functions as F

    rows = formats.registry(spark).select("fourcc", formats.frame_size(F.col("fourcc"), F.lit(52), F.lit(28)).alias("n")).collect()
    assert {r.fourcc: r.n for r in rows} == {c: formats.frame_bytes(c, 52, 28) for c in formats.BY_FOURCC}


def test_lookup_by_any_name(spark):
    keys = spark.createDataFrame([("NV12",), ("NV12 (4:2:0)",), ("Y10",), ("RGB24 (24-bit) [RGB3]",), ("no such",)], "key string")
    assert {(r.key, r.fourcc) for r in formats.look_up(keys, "key").collect()} == {("NV12", "NV12"), ("NV12 (4:2:0)", "NV12"), ("Y10", "Y10 "), ("RGB24 (24-bit) [RGB3]", "RGB3")}
