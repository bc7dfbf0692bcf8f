"""Correlation of content and cost on aligned grids: Pearson, Spearman, opportunity, rankings, class tables.

Input rows are aligned cells (keys..., gc, gr, a, b, valid). Sums are used throughout, so a frame is one partial
aggregate; only ranks need a sort: within a frame by a window, over all frames by ranges of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stores import stored


def sums(a: str = "a", b: str = "b") -> list[Column]:
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return [F.count(F.lit(1)).alias("n"), F.sum(x).alias("sa"), F.sum(y).alias("sb"), F.sum(x * x).alias("saa"), F.sum(y * y).alias("sbb"), F.sum(x * y).alias("sab")]


def coefficient(tiny: float = 1e-9) -> Column:
    """Pearson's r from sums(); null for fewer than two cells or a constant side."""
    n = F.col("n")
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / n, F.col("sbb") - F.col("sb") * F.col("sb") / n
    return F.when((n >= 2) & (va > tiny) & (vb > tiny), (F.col("sab") - F.col("sa") * F.col("sb") / n) / (F.sqrt(va) * F.sqrt(vb)))


def pearson(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.where("valid").groupBy(*keys).agg(*sums()).select(*keys, "n", coefficient().alias("r"))


def average_rank(value: str, keys: list[str]) -> Column:
    """Ranks from 1, equal values sharing their mean."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2.0


def spearman(cells: DataFrame, keys: list[str]) -> DataFrame:
    ranked = cells.where("valid").select(*keys, average_rank("a", keys).alias("a"), average_rank("b", keys).alias("b"))
    return ranked.groupBy(*keys).agg(*sums()).select(*keys, "n", coefficient().alias("rho"))


def scan(cells: DataFrame, key: str = "frame") -> DataFrame:
    """r of each frame and, with a null frame, over all cells together: frames' sums are added up, cells aren't read twice."""
    per = cells.where("valid").groupBy(key).agg(*sums())
    total = per.agg(*(F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab"))).select(F.lit(None).cast("long").alias(key), "*")
    return per.withColumn(key, F.col(key).cast("long")).unionByName(total).select(key, "n", coefficient().alias("r"))


def pooled_ranks(values: DataFrame, value: str) -> DataFrame:
    """Each distinct value of a table of any size with its rank from 1, equal values sharing their mean.

    Values are counted first, then dealt into ranges: a range adds up its own counts, and one row a range gives what lies
    before it. The ranges are written once, as both steps have to see the same ones. So no window goes over all values.
    """
    counted = values.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")).repartitionByRange("v")
    ranges = stored(counted.withColumn("p", F.spark_partition_id()))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("p").agg(F.sum("n").alias("n")).select("p", F.coalesce(F.sum("n").over(before.orderBy("p")), F.lit(0)).alias("offset"))
    within = ranges.select("v", "n", "p", F.coalesce(F.sum("n").over(before.partitionBy("p").orderBy("v")), F.lit(0)).alias("own"))
    return within.join(offsets, "p").select("v", (F.col("offset") + F.col("own") + (F.col("n") + 1) / 2.0).alias("rank"))


def correlation_scan(cells: DataFrame, key: str = "frame") -> DataFrame:
    """n, r and rho of each frame and, with a null frame, over all cells together, ranked together. Cells are made once and read
    from a table; frames without valid cells are left out.
    """
    good = stored(cells.where("valid").select(F.col(key).cast("long").alias(key), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")))
    per = scan(good.withColumn("valid", F.lit(True)), key).join(spearman(good.withColumn("valid", F.lit(True)), [key]).select(key, "rho"), key, "left")
    ranked = good
    for side in ("a", "b"):
        ranks = pooled_ranks(good, side).select(F.col("v").alias(side), F.col("rank").alias(f"r{side}"))
        ranked = ranked.join(ranks, side)
    pooled = ranked.agg(*sums("ra", "rb")).select(coefficient().alias("pooled"))
    # one row beside the frames' rows
    return per.join(F.broadcast(pooled)).select(key, "n", "r", F.when(F.col(key).isNull(), F.col("pooled")).otherwise(F.col("rho")).alias("rho")).where("n > 0")


def opportunity(cells: DataFrame, keys: list[str]) -> DataFrame:
    """z of cost less z of content; sides without spread have z zero, invalid cells null."""
    good = cells.where("valid")
    stats = good.groupBy(*keys).agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.greatest(F.lit(0.0), F.avg(F.col("a") * F.col("a")) - F.avg("a") * F.avg("a")).alias("va"), F.greatest(F.lit(0.0), F.avg(F.col("b") * F.col("b")) - F.avg("b") * F.avg("b")).alias("vb"))
    z = lambda v, m, q: F.when(F.col(q) > 1e-9, (F.col(v) - F.col(m)) / F.sqrt(q)).otherwise(0.0)
    joined = cells.join(stats, keys, "left")
    return joined.select(*keys, "gc", "gr", F.when(F.col("valid"), z("b", "mb", "vb") - z("a", "ma", "va")).alias("z"))


def top_cells(grid: DataFrame, n: int, columns: int, keys: list[str]) -> DataFrame:
    """The n cells of greatest z in each frame, ties by place; nulls don't count. Partial top-n comes before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("z", 9)), F.col("gr") * columns + F.col("gc"))
    return grid.where("z is not null").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def class_table(cells: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Per class: cells, mean QP, bits a pixel and vector length, and the intra share; classes without cells are zeros."""
    good = cells.where("valid")
    per = good.groupBy(*keys, "class").agg(F.count(F.lit(1)).alias("cells"), *(F.avg(c).alias(c) for c in ("qp", "bpp", "mv", "intra")))
    # each key's classes as a map, then all names: the zeros need no join
    by = per.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("class", F.struct("cells", "qp", "bpp", "mv", "intra").alias("v")))).alias("m"))
    rows = by.select(*keys, "m", F.explode(F.array(*map(F.lit, names))).alias("class")).withColumn("v", F.try_element_at("m", F.col("class")))
    return rows.select(*keys, "class", F.coalesce("v.cells", F.lit(0)).cast("long").alias("cells"), *(F.coalesce(f"v.{c}", F.lit(0.0)).alias(c) for c in ("qp", "bpp", "mv", "intra")))


def valid_share(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.count_if("valid").alias("n_valid"), F.avg(F.col("valid").cast("double")).alias("share"))


def scale_of(grid: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest |z| of each frame, for a scale that is even on both sides; 0 without any."""
    return grid.groupBy(*keys).agg(F.coalesce(F.max(F.abs("z")), F.lit(0.0)).alias("most"))


def max_abs(grid: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The greatest absolute difference over valid cells; 0 without any."""
    return grid.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("valid"), F.abs(value))), F.lit(0.0)).alias("max_abs"))
