"""Array kernels on one frame's bytes: any listed format to planes or RGB, and back. Small helpers of Arrow batches.

A frame's samples are first brought to 8 bits in arrays (height, width); what differs between formats is only where
samples lie, which `planes_of` and `rgb_of` describe by strides, shifts and orders.
"""

from __future__ import annotations

import numpy as np

from . import formats
from .pixel import MATRICES

#: Where packed 4:2:2 samples lie in four: luma, luma, blue and red difference. Fixed values.
PACKED_ORDER = {"YUYV": (0, 2, 1, 3), "UYVY": (1, 3, 0, 2), "YVYU": (0, 2, 3, 1), "VYUY": (1, 3, 2, 0)}
#: Where red, green and blue lie in the bytes of a pixel. Fixed values.
BYTE_ORDER = {"RGB3": (0, 1, 2), "BGR3": (2, 1, 0), "RGB4": (0, 1, 2), "BGR4": (2, 1, 0), "BA24": (1, 2, 3), "XB24": (1, 2, 3), "AR24": (3, 2, 1), "XR24": (3, 2, 1), "AB24": (0, 1, 2), "BX24": (0, 1, 2), "RA24": (2, 1, 0), "RX24": (2, 1, 0)}
#: Bits of red, green and blue in a 16- or 8-bit pixel, and where each starts. Fixed values.
BIT_FIELDS = {"RGBP": ((5, 11), (6, 5), (5, 0)), "RGBO": ((5, 10), (5, 5), (5, 0)), "R444": ((4, 8), (4, 4), (4, 0)), "RGB1": ((3, 5), (3, 2), (2, 0)), "AR12": ((4, 8), (4, 4), (4, 0)), "XR12": ((4, 8), (4, 4), (4, 0)), "AR15": ((5, 10), (5, 5), (5, 0)), "XR15": ((5, 10), (5, 5), (5, 0)), "RGBR": ((5, 11), (6, 5), (5, 0)), "RGBQ": ((5, 10), (5, 5), (5, 0))}
BIG_ENDIAN = {"RGBR", "RGBQ"}
ALPHA_BITS = {"AR12": 0xF000, "AR15": 0x8000}
RED_FIRST = {"YV12", "YVU9", "NV21", "NV61", "NV42", "NM21"}
#: Rows and columns of red in the mosaic's 2 x 2 cell; blue is opposite. Fixed values.
RED_AT = {"RGGB": (0, 0), "BGGR": (1, 1), "GBRG": (1, 0), "GRBG": (0, 1)}


def unpack10_le(data: np.ndarray) -> np.ndarray:
    """Four 10-bit samples in each five bytes, lowest bits first."""
    b = data[: len(data) // 5 * 5].reshape(-1, 5).astype(np.uint64)
    word = sum(b[:, i] << np.uint64(8 * i) for i in range(5))
    return np.stack([(word >> np.uint64(10 * i)) & np.uint64(1023) for i in range(4)], 1).ravel().astype(np.uint16)


def unpack10_be(data: np.ndarray) -> np.ndarray:
    """Four 10-bit samples in each five bytes, highest bits first."""
    b = data[: len(data) // 5 * 5].reshape(-1, 5).astype(np.uint64)
    word = sum(b[:, i] << np.uint64(8 * (4 - i)) for i in range(5))
    return np.stack([(word >> np.uint64(10 * (3 - i))) & np.uint64(1023) for i in range(4)], 1).ravel().astype(np.uint16)


def untiled(samples: np.ndarray, width: int, height: int) -> np.ndarray:
    """4 x 4 tiles in raster order to rows; rows that fill no tile are zero."""
    whole = height // 4 * 4
    out = np.zeros((height, width), samples.dtype)
    out[:whole] = samples[: whole * width].reshape(whole // 4, width // 4, 4, 4).swapaxes(1, 2).reshape(whole, width)
    return out


def nearest(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = plane.shape
    return plane[(np.arange(height) * h // height)[:, None], np.arange(width) * w // width]


def bilinear(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    """Between samples at dst * src size / dst size, rounded half up."""
    h, w = plane.shape
    if (h, w) == (height, width):
        return plane

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(m) * n / m
        low = np.minimum(at.astype(int), n - 1)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = axis(h, height)
    x0, x1, fx = axis(w, width)
    p = plane.astype(float)
    rows = lambda y: p[y][:, x0] * (1 - fx) + p[y][:, x1] * fx
    return np.clip(np.floor(rows(y0) * (1 - fy[:, None]) + rows(y1) * fy[:, None] + 0.5), 0, 255).astype(np.uint8)


def planes_of(data: bytes, fourcc: str, width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Luma and both chroma planes at 8 bits, chroma at its own size."""
    _, family, _, depth, h_sub, v_sub, _, _, _ = formats.BY_FOURCC[fourcc]
    cw, ch = width // h_sub, height // v_sub
    raw = np.frombuffer(data, np.uint8)
    if family == formats.PACKED:
        if fourcc in PACKED_ORDER or fourcc.startswith("Y21"):
            quads = (raw if fourcc in PACKED_ORDER else (np.frombuffer(data, "<u2") >> 8).astype(np.uint8)).reshape(height, width // 2, 4)
            a, b, u, v = PACKED_ORDER.get(fourcc, (0, 2, 1, 3))
            return quads[:, :, (a, b)].reshape(height, width), quads[:, :, u], quads[:, :, v]
        if fourcc in ("AYUV", "VUYA"):
            four = raw.reshape(height, width, 4)
            y, u, v = (1, 2, 3) if fourcc == "AYUV" else (2, 1, 0)
            return four[:, :, y], four[:, :, u], four[:, :, v]
        eight = raw.reshape(height, width // 8, 12)  # Y41P: U Y V Y U Y V Y Y Y Y Y
        return eight[:, :, (1, 3, 5, 7, 8, 9, 10, 11)].reshape(height, width), eight[:, :, (0, 4)].reshape(height, cw), eight[:, :, (2, 6)].reshape(height, cw)
    n, c = width * height, cw * ch
    if family == formats.PLANAR:
        samples = raw if depth == 8 else ((np.frombuffer(data, "<u2") & ((1 << depth) - 1)) >> (depth - 8)).astype(np.uint8)
        y, u, v = samples[:n].reshape(height, width), samples[n : n + c].reshape(ch, cw), samples[n + c : n + 2 * c].reshape(ch, cw)
    else:
        if fourcc in ("NV15", "NV20"):
            y_bytes = (n * 10 + 7) // 8
            samples = np.concatenate((unpack10_le(raw[:y_bytes])[:n], unpack10_le(raw[y_bytes:])[: 2 * c]))
            samples = (samples >> 2).astype(np.uint8)
        elif depth > 8:
            samples = np.frombuffer(data, "<u2")
            if fourcc == "T010":
                samples = np.concatenate((untiled(samples[:n], width, height).ravel(), untiled(samples[n:], width, height // 2).ravel()))
            samples = (samples >> 8).astype(np.uint8)
        else:
            samples = raw
        uv = samples[n : n + 2 * c].reshape(ch, cw, 2)
        y, u, v = samples[:n].reshape(height, width), uv[:, :, 0], uv[:, :, 1]
    return (y, v, u) if fourcc in RED_FIRST else (y, u, v)


def mixed(y: np.ndarray, u: np.ndarray, v: np.ndarray, matrix: str) -> np.ndarray:
    """Full-size planes to RGB: single precision, clamped, truncated."""
    rv, gu, gv, bu = (np.float32(k) for k in MATRICES[matrix])
    luma, cb, cr = y.astype(np.float32), u.astype(np.float32) - 128, v.astype(np.float32) - 128
    return np.clip(np.stack((luma + rv * cr, luma - gu * cb - gv * cr, luma + bu * cb), -1), 0, 255).astype(np.uint8)


def mosaic(values: np.ndarray, pattern: str) -> np.ndarray:
    """Colours that a sample lacks are the whole-number mean of those around it that exist."""
    h, w = values.shape
    ry, rx = RED_AT[pattern]
    yy, xx = np.mgrid[0:h, 0:w]
    red, blue = (yy % 2 == ry) & (xx % 2 == rx), (yy % 2 != ry) & (xx % 2 != rx)
    out = np.zeros((h, w, 3), np.uint8)
    for i, mask in enumerate((red, ~red & ~blue, blue)):
        padded, there = np.pad(np.where(mask, values, 0).astype(np.int64), 1), np.pad(mask.astype(np.int64), 1)
        around = lambda a: sum(a[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1))
        out[:, :, i] = np.where(mask, values, around(padded) // np.maximum(1, around(there)))
    return out


def grey_of(data: bytes, fourcc: str, depth: int, width: int, height: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if fourcc == "Y10B":
        samples = unpack10_be(raw)[: width * height] >> 2
    elif fourcc == "Y10P" or fourcc[0] == "p":  # four high bytes, then their low bits
        samples = raw[: width * height * 5 // 4].reshape(-1, 5)[:, :4].ravel()
    else:
        samples = raw if depth == 8 else np.frombuffer(data, "<u2") >> (depth - 8)
    return samples[: width * height].reshape(height, width).astype(np.uint8)


def rgb_of(data: bytes, fourcc: str, width: int, height: int, matrix: str = "bt601") -> np.ndarray:
    """A frame as RGB (height, width, 3); ValueError for unlisted formats and short data."""
    if fourcc not in formats.BY_FOURCC or fourcc.startswith("HSV"):
        raise ValueError(f"format {fourcc} can't be decoded")
    if len(data) < formats.frame_bytes(fourcc, width, height):
        raise ValueError(f"{len(data)} bytes are no {width}x{height} frame of {fourcc}")
    name, family, _, depth, _, _, bpp, _, _ = formats.BY_FOURCC[fourcc]
    if family == formats.RGB:
        if fourcc in BYTE_ORDER:
            return np.frombuffer(data, np.uint8).reshape(height, width, bpp // 8)[:, :, BYTE_ORDER[fourcc]]
        v = np.frombuffer(data, np.uint8 if bpp == 8 else ">u2" if fourcc in BIG_ENDIAN else "<u2").reshape(height, width).astype(np.uint16)
        return np.stack([((v >> at) & ((1 << bits) - 1)) << (8 - bits) for bits, at in BIT_FIELDS[fourcc]], -1).astype(np.uint8)
    if family in (formats.GREY, formats.BAYER):
        values = grey_of(data, fourcc, depth, width, height)
        return np.repeat(values[:, :, None], 3, 2) if family == formats.GREY else mosaic(values, name.split(" ")[1])
    y, u, v = planes_of(data, fourcc, width, height)
    return mixed(y, nearest(u, width, height), nearest(v, width, height), matrix)


def channels_of(data: bytes, fourcc: str, width: int, height: int) -> dict[str, np.ndarray]:
    """Y, U and V with chroma at full size; of other families R, G and B."""
    if formats.BY_FOURCC[fourcc][1] in (formats.PACKED, formats.PLANAR, formats.SEMI):
        y, u, v = planes_of(data, fourcc, width, height)
        return {"Y": y, "U": nearest(u, width, height), "V": nearest(v, width, height)}
    rgb = rgb_of(data, fourcc, width, height)
    return {c: rgb[:, :, i] for i, c in enumerate("RGB")}


def yuv_of(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, g, b = (rgb[:, :, i].astype(np.float32) for i in range(3))
    f = np.float32
    three = (f(0.299) * r + f(0.587) * g + f(0.114) * b, 128 - f(0.168736) * r - f(0.331264) * g + f(0.5) * b, 128 + f(0.5) * r - f(0.418688) * g - f(0.081312) * b)
    return tuple(np.clip(p, 0, 255).astype(np.uint8) for p in three)


def packed(y: np.ndarray, u: np.ndarray, v: np.ndarray, fourcc: str) -> bytes:
    """8-bit planes, chroma at the format's size, to a frame."""
    family = formats.BY_FOURCC[fourcc][1]
    if fourcc in RED_FIRST:
        u, v = v, u
    if family == formats.PLANAR:
        return b"".join(p.tobytes() for p in (y, u, v))
    if family == formats.SEMI:
        return y.tobytes() + np.stack((u, v), -1).tobytes()
    if fourcc in ("AYUV", "VUYA"):
        full = np.full_like(y, 255)
        return np.stack((full, y, u, v) if fourcc == "AYUV" else (v, u, y, full), -1).tobytes()
    a, b, cu, cv = PACKED_ORDER.get(fourcc, PACKED_ORDER["YUYV"])
    h, w = y.shape
    out = np.empty((h, w // 2, 4), np.uint8)
    out[:, :, a], out[:, :, b], out[:, :, cu], out[:, :, cv] = y[:, ::2], y[:, 1::2], u, v
    return out.tobytes()


def rgb_to(rgb: np.ndarray, fourcc: str) -> bytes:
    """RGB to a frame of an RGB, grey or 8-bit YUV format."""
    _, family, _, depth, h_sub, v_sub, bpp, _, _ = formats.BY_FOURCC[fourcc]
    h, w, _ = rgb.shape
    if family == formats.RGB:
        if fourcc in BYTE_ORDER:
            out = np.full((h, w, bpp // 8), 255, np.uint8)
            out[:, :, BYTE_ORDER[fourcc]] = rgb
            return out.tobytes()
        v = np.full((h, w), ALPHA_BITS.get(fourcc, 0), np.uint16)
        for i, (bits, at) in enumerate(BIT_FIELDS[fourcc]):
            v |= (rgb[:, :, i].astype(np.uint16) >> (8 - bits)) << at
        return v.astype(np.uint8 if bpp == 8 else ">u2" if fourcc in BIG_ENDIAN else "<u2").tobytes()
    y, u, v = yuv_of(rgb)
    if family == formats.GREY:
        return y.tobytes() if depth == 8 else (y.astype("<u2") << (depth - 8)).tobytes()
    if family == formats.BAYER or depth > 8:
        raise ValueError(f"format {fourcc} can't be written")
    return packed(y, bilinear(u, w // h_sub, h // v_sub), bilinear(v, w // h_sub, h // v_sub), fourcc)


def converted(data: bytes, src: str, dst: str, width: int, height: int) -> bytes:
    """A frame in another format: as it is, by planes between 8-bit YUV formats, else by RGB."""
    if src == dst:
        return data
    yuv = (formats.PACKED, formats.PLANAR, formats.SEMI)
    _, family, _, depth, h_sub, v_sub, _, _, _ = formats.BY_FOURCC[dst]
    if formats.BY_FOURCC[src][1] in yuv and family in yuv and depth == 8:
        y, u, v = planes_of(data, src, width, height)
        return packed(np.ascontiguousarray(y), bilinear(u, width // h_sub, height // v_sub), bilinear(v, width // h_sub, height // v_sub), dst)
    return rgb_to(rgb_of(data, src, width, height), dst)
