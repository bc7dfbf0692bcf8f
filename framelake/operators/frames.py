"""Operators on pixels of frames: histograms, scopes, block statistics and motion between their tiles.

Pixels are rows (keys..., x, y, r, g, b); `keys` name a frame. All statistics are partial aggregates on the pixels' own
partitions followed by one shuffle of cells, which are few. What compares pixels with each other is in `pairs`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixel

#: What names a video; `frame` numbers its frames.
VIDEO = ["video"]
FRAME = [*VIDEO, "frame"]
#: Scores from which motion is slight, much and full.
MOTION_STEPS = (2.0, 10.0, 30.0)


def long_channels(px: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """One row a sample: channel and value; mode rgb or luma (rounded)."""
    if mode == "luma":
        return px.select(*keys, F.lit("Y").alias("channel"), F.round(pixel.metric("luma")).cast("int").alias("value"))
    if mode != "rgb":
        raise ValueError(f"unknown histogram mode {mode}")
    samples = F.array(*(F.struct(F.lit(c.upper()).alias("channel"), F.col(c).cast("int").alias("value")) for c in "rgb"))
    return px.select(*keys, F.explode(samples).alias("s")).select(*keys, "s.channel", "s.value")


def histogram(px: DataFrame, mode: str = "luma", keys: list[str] = FRAME) -> DataFrame:
    """256 counts for each frame and channel, zeros included."""
    counts = long_channels(px, keys, mode).groupBy(*keys, "channel", "value").count()
    # one row a frame and channel with its counts, then all 256 values: nothing is joined
    bins = counts.groupBy(*keys, "channel").agg(F.map_from_entries(F.collect_list(F.struct("value", "count"))).alias("bins"))
    return bins.select(*keys, "channel", "bins", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("value")).select(*keys, "channel", "value", F.coalesce(F.try_element_at("bins", F.col("value")), F.lit(0)).cast("long").alias("n"))


def waveform(px: DataFrame, width: int, channel: Column | None = None, keys: list[str] = FRAME, columns: int = 720) -> DataFrame:
    """Counts by value and column, columns scaled down to at most 720, with sqrt intensity by the greatest count."""
    value = F.round(pixel.metric("luma")).cast("int") if channel is None else channel
    shown = min(width, columns)
    counts = px.groupBy(*keys, F.floor(F.col("x") * shown / width).cast("int").alias("col"), value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    most = F.max("n").over(Window.partitionBy(*keys))
    return counts.withColumn("intensity", F.sqrt(F.col("n") / most))


def vectorscope(px: DataFrame, width: int, height: int, keys: list[str] = FRAME, most: int = 307_200) -> DataFrame:
    """Chroma points (cb, cr), every n-th pixel where there are more than the scope draws."""
    step = max(1, width * height // most) if width * height > most else 1
    r, g, b = (F.col(c) for c in "rgb")
    at = F.col("y") * width + F.col("x")
    return px.where(at % step == 0).select(*keys, "x", "y", (-0.1146 * r - 0.3854 * g + 0.5 * b).alias("cb"), (0.5 * r - 0.4542 * g - 0.0458 * b).alias("cr"))


def moments(value: Column) -> list[Column]:
    return [F.avg(value).alias("mean"), F.greatest(F.lit(0.0), F.avg(value * value) - F.avg(value) * F.avg(value)).alias("var")]


def tile(cell: int) -> list[Column]:
    cell = max(1, cell)
    return [F.floor(F.col("x") / cell).cast("int").alias("bx"), F.floor(F.col("y") / cell).cast("int").alias("by")]


def block_stats(px: DataFrame, cell: int = 8, metric: str = "luma", keys: list[str] = FRAME) -> DataFrame:
    """Mean and population variance of each tile; partial tiles at the edges count."""
    return px.groupBy(*keys, *tile(cell)).agg(*moments(pixel.metric(metric)))


def block_and_frame_stats(px: DataFrame, cell: int = 8, metric: str = "luma", keys: list[str] = FRAME) -> DataFrame:
    """Tiles and, with null bx and by, whole frames in one pass, by grouping sets over per-tile sums."""
    v = pixel.metric(metric)
    tiles = px.groupBy(*keys, *tile(cell)).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.min(v).alias("least"), F.max(v).alias("most"))
    sets = tiles.groupingSets([[F.col(k) for k in (*keys, "bx", "by")], [F.col(k) for k in keys]], *keys, "bx", "by")
    mean = F.sum("s") / F.sum("n")
    return sets.agg(mean.alias("mean"), F.greatest(F.lit(0.0), F.sum("q") / F.sum("n") - mean * mean).alias("var"), F.min("least").alias("least"), F.max("most").alias("most"))


def grid_summary(grid: DataFrame, value: str, keys: list[str] = FRAME) -> DataFrame:
    return grid.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))


def motion_class(score: Column) -> Column:
    slight, much, full = MOTION_STEPS
    return F.when(score >= full, "full").when(score >= much, "much").when(score >= slight, "slight").otherwise("static")


def motion_by_stats(px: DataFrame, cell: int = 8, metric: str = "luma", video: list[str] = VIDEO) -> DataFrame:
    """Score and class of each tile against the frame before in its video: the difference of means and of deviations. Only
    tiles are shuffled; `pairs.motion` compares samples.
    """
    keys = [*video, "frame"]
    stats = block_stats(px, cell, metric, keys)
    before = stats.select(*video, (F.col("frame") + 1).alias("frame"), "bx", "by", F.col("mean").alias("p_mean"), F.col("var").alias("p_var"))
    change = F.abs(F.col("mean") - F.col("p_mean")) + F.abs(F.sqrt("var") - F.sqrt("p_var"))
    scores = stats.join(before, [*keys, "bx", "by"]).select(*keys, "bx", "by", change.alias("score"))
    return scores.withColumn("class", motion_class(F.col("score")))


def motion_summary(scores: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """Tiles of each class, the mean score and the greatest."""
    return scores.groupBy(*keys).agg(*(F.count_if(F.col("class") == c).alias(c) for c in ("static", "slight", "much", "full")), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"))


def field(px: DataFrame, odd: int) -> DataFrame:
    """One field of an interlaced frame, its rows doubled to full height."""
    return px.where(F.col("y") % 2 == odd).withColumn("y", F.explode(F.array(F.col("y") - odd, F.col("y") - odd + 1)))


def split_view(px: DataFrame, parts: list[tuple[Column, Column, Column]], width: int, height: int) -> DataFrame:
    """Four half-size pictures in one: parts are the (r, g, b) of the upper left, upper right, lower left and lower right one.

    Of each two columns and rows the first is taken; the last column or row of an odd size is black. A projection: each
    kept pixel is dealt to its four places. Other columns stay.
    """
    half_w, half_h = width // 2, height // 2
    x, y = F.floor(F.col("x") / 2).cast("int"), F.floor(F.col("y") / 2).cast("int")
    spot = lambda x, y, rgb: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), *(c.cast("int").alias(n) for n, c in zip("rgb", rgb, strict=True)))
    four = F.array(*(spot(x + (k % 2) * half_w, y + (k // 2) * half_h, rgb) for k, rgb in enumerate(parts)))
    edge = (F.col("x") >= 2 * half_w) | (F.col("y") >= 2 * half_h)
    taken = (F.col("x") % 2 == 0) & (F.col("y") % 2 == 0) & ~edge
    black = F.array(spot(F.col("x"), F.col("y"), (F.lit(0),) * 3))
    rest = [c for c in px.columns if c not in ("x", "y", "r", "g", "b")]
    return px.where(taken | edge).select(*rest, F.explode(F.when(edge, black).otherwise(four)).alias("p")).select(*rest, "p.*")


def upsampled(plane: DataFrame, src: tuple[int, int], dst: tuple[int, int], keys: list[str] = FRAME) -> DataFrame:
    """Nearest upsampling: each sample goes to the places whose index scales down to its own."""
    (sw, sh), (dw, dh) = src, dst
    span = lambda c, s, d: F.sequence(F.ceil(F.col(c) * d / s).cast("int"), F.ceil((F.col(c) + 1) * d / s).cast("int") - 1)
    return plane.withColumn("x", F.explode(span("x", sw, dw))).withColumn("y", F.explode(span("y", sh, dh)))


def neighbourhood(px: DataFrame, points: DataFrame, value: str, keys: list[str] = FRAME, before: int = 4, after: int = 3) -> DataFrame:
    """The samples around each point (cx, cy), from 4 before to 3 after; what lies outside gives no row.

    Points are spread over the places they see, so the join is by equality.
    """
    steps = F.sequence(F.lit(-before), F.lit(after))
    seen = points.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).withColumn("x", F.col("cx") + F.col("dx")).withColumn("y", F.col("cy") + F.col("dy"))
    return seen.join(px.select(*keys, "x", "y", value), [*keys, "x", "y"]).select(*keys, "cx", "cy", "dx", "dy", value)
