"""Grids: blocks to cells, cells to coarser cells, and differences of grids.

Rectangles are laid out over the cells they touch by exploding index ranges, so overlap joins are groupings by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels


def spread(rects: DataFrame, cell: int, width: int, height: int) -> DataFrame:
    """Rectangles (x, y, w, h) with each cell (c, r) they overlap inside the picture, and the overlap's area `a`."""
    right, bottom = F.least(F.col("x") + F.col("w"), F.lit(width)), F.least(F.col("y") + F.col("h"), F.lit(height))
    inside = rects.where((F.col("w") > 0) & (F.col("h") > 0) & (F.col("x") < width) & (F.col("y") < height))
    index = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor((hi - 1) / cell)))
    laid = inside.withColumn("c", index(F.col("x"), right)).withColumn("r", index(F.col("y"), bottom))
    ox = F.least(right, (F.col("c") + 1) * cell) - F.greatest(F.col("x"), F.col("c") * cell)
    oy = F.least(bottom, (F.col("r") + 1) * cell) - F.greatest(F.col("y"), F.col("r") * cell)
    return laid.withColumn("a", ox * oy)


#: Raster columns made of blocks' summed levels and coefficients, where these are known.
COEFFICIENTS = {"coeff_energy": "abs_sum", "nz_density": "nonzero"}


#: Blocks that one task lays out: what it holds of their cells is a small share of an executor's memory.
BLOCKS_A_TASK = 100_000


def parts_of(blocks: DataFrame, rows: int | None = None) -> int:
    """As many parts as the number of blocks (counted unless given) asks for."""
    return max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(blocks.count() if rows is None else rows) // BLOCKS_A_TASK))


def folded(blocks: DataFrame, n: int, cell: int, width: int, height: int, rows: int | None = None) -> DataFrame:
    """Rasterised frames (column frame) laid over each other, frame by remainder of n: means, and the greatest mode.

    Blocks are dealt by the frame they are folded on to, few such frames by several numbers each. A part so holds all cells of few
    folded frames, and what it sends on are at most about as many cells as the result and the parts have, not their product.
    """
    parts = parts_of(blocks, rows)
    salts = -(-4 * parts // n)
    dealt = blocks.withColumn("fold", F.col("frame") % n).withColumn("salt", F.floor(F.col("frame") / n) % salts)
    cells = rasterize(dealt, cell, width, height, ["fold", "salt", "frame"], parts=parts, deal=["fold", "salt"])
    return cells.groupBy(F.col("fold").alias("frame"), "c", "r").agg(*(F.avg(x).alias(x) for x in ("qp", "bpp", "mv", "coverage")), F.max("mode").alias("mode"))


def rasterize(blocks: DataFrame, cell: int, width: int, height: int, keys: list[str], rows: int | None = None, parts: int | None = None, deal: list[str] | None = None) -> DataFrame:
    """Per cell: QP, bits a pixel and vector length weighted by area, the mode of most area (the later of equals) and the covered
    share. With blocks' abs_sum and nonzero (see `telemetry.with_coefficients`) also coeff_energy and nz_density a pixel.

    Blocks are shuffled by frame (keys) before they are laid out, and cells never: grids made from these cells stay where their
    frame is. There are as many parts as `rows`, the number of blocks (counted unless given), asks for. `deal` are keys to deal by
    instead of all.
    """
    parts = parts or parts_of(blocks, rows)
    a, area = F.col("a"), F.col("w") * F.col("h")
    each = {"qp": F.col("qp"), "bpp": F.greatest(F.col("bits"), F.lit(0)) / area, "mv": labels.mv_pixels(F.col("mvx"), F.col("mvy"))}
    each |= {name: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)) / area for name, c in COEFFICIENTS.items() if c in blocks.columns}
    ranked = blocks.select(*keys, *"xywh", labels.mode_rank(F.col("mode")).cast("byte").alias("rank"), *(v.alias(name) for name, v in each.items()))
    laid = spread(ranked.repartition(parts, *(deal or keys)), cell, width, height)
    total = F.sum("a")
    areas = (F.struct(F.sum(F.when(F.col("rank") == k, a)).alias("a"), F.lit(k).alias("rank")) for k in labels.MODE_RANK.values())
    cells = laid.groupBy(*keys, "c", "r").agg(*((F.sum(F.col(name) * a) / total).alias(name) for name in each), F.greatest(*areas).alias("top"), (total / float(cell * cell)).alias("coverage"))
    return cells.select(*keys, F.col("c").cast("long").alias("c"), F.col("r").cast("long").alias("r"), *each, F.col("top.rank").cast("long").alias("mode"), "coverage")


def to_coarse(cells: DataFrame, cell: int, g: int) -> DataFrame:
    """Cells (c, r) of one size laid out over cells of size g: gc, gr and the overlap's area `a`."""
    rects = cells.withColumn("x", F.col("c") * cell).withColumn("y", F.col("r") * cell).withColumn("w", F.lit(cell)).withColumn("h", F.lit(cell)).withColumnsRenamed({"c": "c0", "r": "r0"})
    laid = spread(rects, g, 1 << 30, 1 << 30)
    return laid.withColumnsRenamed({"c": "gc", "r": "gr"})


def resample_mean(cells: DataFrame, value: str, cell: int, g: int, keys: list[str]) -> DataFrame:
    a = F.col("a")
    return to_coarse(cells, cell, g).groupBy(*keys, "gc", "gr").agg((F.sum(F.col(value) * a) / F.sum(a)).alias(value))


def resample_variance(cells: DataFrame, mean: str, var: str, cell: int, g: int, keys: list[str]) -> DataFrame:
    """The law of total variance: the mean of variances and the variance of means, by area."""
    a, m = F.col("a"), F.col(mean)
    avg = F.sum(m * a) / F.sum(a)
    return to_coarse(cells, cell, g).groupBy(*keys, "gc", "gr").agg((F.sum(F.col(var) * a) / F.sum(a) + F.greatest(F.lit(0.0), F.sum(m * m * a) / F.sum(a) - avg * avg)).alias("var"))


def resample_angle(cells: DataFrame, angle: str, purity: str, cell: int, g: int, keys: list[str]) -> DataFrame:
    """Mean of directions, which repeat at 180 degrees, on doubled angles, weighted by area and purity; no weight gives no row."""
    weight = F.col("a") * F.col(purity)
    twice = F.radians(F.col(angle) * 2)
    sums = to_coarse(cells, cell, g).groupBy(*keys, "gc", "gr").agg(F.sum(weight * F.sin(twice)).alias("s"), F.sum(weight * F.cos(twice)).alias("c"), F.sum(weight).alias("w"))
    return sums.where("w > 0").select(*keys, "gc", "gr", F.pmod(F.degrees(F.atan2("s", "c")) / 2 + 180.0, F.lit(180.0)).alias("angle"))


def resample_class(cells: DataFrame, rank: str, cell: int, g: int, keys: list[str]) -> DataFrame:
    """The class of most area; of equals the one that comes later."""
    votes = to_coarse(cells, cell, g).groupBy(*keys, "gc", "gr", rank).agg(F.sum("a").alias("a"))
    return votes.groupBy(*keys, "gc", "gr").agg(F.max(F.struct("a", rank)).alias("top")).select(*keys, "gc", "gr", F.col(f"top.{rank}").cast("long").alias(rank))


def inside(width: int, height: int, g: int) -> Column:
    """Whether a coarse cell lies wholly in the picture."""
    return ((F.col("gc") + 1) * g <= width) & ((F.col("gr") + 1) * g <= height)


def telemetry_to_coarse(cells: DataFrame, cell: int, g: int, width: int, height: int, keys: list[str], intra: int = labels.MODE_RANK["intra"]) -> DataFrame:
    """Rasterised cells to coarse ones: means over what is covered, the intra share, and valid: inside the picture and covered."""
    covered = F.col("coverage") * F.col("a")
    laid = to_coarse(cells, cell, g).withColumn("k", covered)
    mean = lambda c: (F.sum(F.col(c) * F.col("k")) / F.sum("k")).alias(c)
    share = F.sum(F.when(F.col("mode") == intra, F.col("k")).otherwise(0.0)) / F.sum("k")
    out = laid.where("k > 0").groupBy(*keys, "gc", "gr").agg(mean("qp"), mean("bpp"), mean("mv"), share.alias("intra"), F.sum("k").alias("covered"))
    return out.withColumn("valid", inside(width, height, g) & (F.col("covered") >= 0.999 * g * g)).drop("covered")


def align(x: DataFrame, y: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """Cells of both grids (columns a and b), valid where both are and values are finite. keep: further columns of y."""
    bad = lambda c: F.isnull(c) | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    both = x.select(*keys, "gc", "gr", "a", F.col("valid").alias("va")).join(y.select(*keys, "gc", "gr", "b", F.col("valid").alias("vb"), *(keep or [])), [*keys, "gc", "gr"])
    return both.withColumn("valid", F.col("va") & F.col("vb") & ~bad("a") & ~bad("b")).drop("va", "vb")


def beside(a: DataFrame, b: DataFrame, at: list[str]) -> DataFrame:
    """Grids with one row a cell brought together by cell: a_x and b_x of each further column x, has_a and has_b where the grid has
    the cell, else null. A grouping instead of a join: grids that are dealt by frame alike are neither shuffled nor sorted again.
    """
    fields = [(f"{side}_{c}", g.schema[c].dataType) for side, g in (("a", a), ("b", b)) for c in g.columns if c not in at] + [("has_a", "boolean"), ("has_b", "boolean")]

    def named(side: str, g: DataFrame) -> DataFrame:
        own = {f"{side}_{c}": F.col(c) for c in g.columns} | {f"has_{side}": F.lit(True)}
        return g.select(*at, *(own.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields))

    return named("a", a).union(named("b", b)).groupBy(*at).agg(*(F.max(n).alias(n) for n, _ in fields))


def subtract(a: DataFrame, b: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """a less b by cell; cells that b lacks are zero and invalid."""
    slim = lambda g: g.select(*keys, "gc", "gr", *values, "valid")
    both = beside(slim(a), slim(b), [*keys, "gc", "gr"]).where("has_a")
    has = F.col("b_valid").isNotNull()
    return both.select(*keys, "gc", "gr", *(F.when(has, F.col(f"a_{v}") - F.col(f"b_{v}")).otherwise(0.0).alias(v) for v in values), F.coalesce(F.col("a_valid") & F.col("b_valid"), F.lit(False)).alias("valid"))


def difference(a: DataFrame, b: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """b less a in cells that both cover."""
    covered = lambda g: g.where("coverage > 0").select(*keys, "c", "r", F.col(value).alias("v"))
    both = beside(covered(a), covered(b), [*keys, "c", "r"]).where("has_a and has_b")
    return both.select(*keys, "c", "r", (F.col("b_v") - F.col("a_v")).alias("delta"))
