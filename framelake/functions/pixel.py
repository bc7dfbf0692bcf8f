"""Column expressions on samples: colour conversion, luma, mixes, channel picks and views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (red from V, green from U, green from V, blue from U): fixed values of the two matrices.
MATRICES = {"bt601": (1.402, 0.344136, 0.714136, 1.772), "bt709": (1.5748, 0.1873, 0.4681, 1.8556)}


def clamped(x: Column) -> Column:
    """To 0..255, then truncated."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), x)).cast("int")


def yuv_to_rgb(y: Column, u: Column, v: Column, matrix: str = "bt601") -> tuple[Column, Column, Column]:
    """Full-range YUV samples (0..255) to red, green and blue."""
    rv, gu, gv, bu = MATRICES[matrix]
    cb, cr = u - 128.0, v - 128.0
    return clamped(y + rv * cr), clamped(y - gu * cb - gv * cr), clamped(y + bu * cb)


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return (
        clamped(0.299 * r + 0.587 * g + 0.114 * b),
        clamped(128.0 - 0.168736 * r - 0.331264 * g + 0.5 * b),
        clamped(128.0 + 0.5 * r - 0.418688 * g - 0.081312 * b),
    )


def luma709(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def luma601(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def mixed_signal(r: Column, g: Column, b: Column) -> Column:
    """Six parts luma and one of each chroma difference, which are centred on zero."""
    y = luma709(r, g, b)
    return (6.0 * y + (b - y) / 1.8556 + (r - y) / 1.5748) / 8.0


METRICS = {"luma": luma709, "ms": mixed_signal}


def metric(name: str) -> Column:
    """The sample value that block and motion statistics work on, from columns r, g and b."""
    return METRICS[name](F.col("r"), F.col("g"), F.col("b"))


def view_channel(view: int) -> tuple[Column, Column, Column]:
    """View 0: all channels; 1 to 3: one channel as grey."""
    channels = (F.col("r"), F.col("g"), F.col("b"))
    return channels if view == 0 else (channels[view - 1],) * 3


#: What a channel is painted in: grey, or one primary.
PAINT = {"Y": (1, 1, 1), "U": (0, 0, 1), "V": (1, 0, 0), "R": (1, 0, 0), "G": (0, 1, 0), "B": (0, 0, 1)}


def colorize(channel: str, value: Column) -> tuple[Column, ...]:
    return tuple(value * k for k in PAINT.get(channel, (1, 1, 1)))


def scale_sample(value: Column, most: Column) -> Column:
    """An integer sample of 0..most to 0..255, rounded."""
    return F.floor((value * 255 + F.floor(most / 2)) / most).cast("int")
