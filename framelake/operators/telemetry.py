"""Operators on decoder telemetry: frames, blocks and their child rows.

Frames are keyed by (video, decode_idx), blocks by (video, decode_idx, block). Windows are partitioned by video, so a
library of many videos spreads over the cluster; child rows carry their block's key, so joins are plain equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels


def display_order(frames: DataFrame) -> DataFrame:
    """Adds cvs_seg and display_idx (from 0, null for frames that aren't output): by POC within coded video sequences."""
    decode = Window.partitionBy("video").orderBy("decode_idx").rowsBetween(Window.unboundedPreceding, 0)
    seg = frames.withColumn("cvs_seg", F.sum(labels.opens_sequence(F.col("frame_type")).cast("long")).over(decode))
    shown = Window.partitionBy("video", "output").orderBy("cvs_seg", "poc", "decode_idx")
    return seg.withColumn("display_idx", F.when(F.col("output"), F.row_number().over(shown) - 1).cast("long"))


def frame_graph(frames: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per displayed frame: bits (of its slices, else summed over blocks) and QP weighted by area."""
    area = F.col("w") * F.col("h")
    per = blocks.groupBy("video", "decode_idx").agg(F.sum(F.greatest(F.col("bits"), F.lit(0))).alias("block_bits"), F.sum(F.col("qp") * area).alias("qa"), F.sum(area).alias("a"))
    joined = display_order(frames).where("display_idx is not null").join(per, ["video", "decode_idx"], "left")
    return joined.select("video", "display_idx", "decode_idx", "poc", F.coalesce("slice_bits", "block_bits", F.lit(0)).cast("long").alias("bits"), F.when(F.col("a") > 0, F.col("qa") / F.col("a")).alias("avg_qp"))


def range_join_blocks(frames: DataFrame, records: DataFrame) -> DataFrame:
    """Frames with their block records by range: block_off <= i < block_off + block_n, as an equi-join on the index."""
    owned = frames.where("block_n > 0").withColumn("i", F.explode(F.sequence(F.col("block_off"), F.col("block_off") + F.col("block_n") - 1)))
    return owned.join(records, ["video", "i"])


def with_children(blocks: DataFrame, children: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Blocks with the number and bits of their child rows; blocks without any are kept."""
    per = children.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), F.sum("bits").alias(f"{count}_bits"))
    return blocks.join(per, keys, "left").fillna(0, [count, f"{count}_bits"])


def syntax_stats(syntax: DataFrame, by: list[str]) -> DataFrame:
    """Per name: rows and bits, with their rank by bits, then name."""
    per = syntax.groupBy(*by, "name").agg(F.count(F.lit(1)).alias("n"), F.sum("bits").alias("bits"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("bits"), "name")).cast("long"))


def cabac_stats(bins: DataFrame, by: list[str]) -> DataFrame:
    """Per name: bins, bits, distinct contexts and bits of a bin."""
    per = bins.groupBy(*by, "name").agg(F.count(F.lit(1)).alias("bins"), F.sum("bits").alias("bits"), F.countDistinct("ctx").alias("contexts"))
    return per.withColumn("bits_per_bin", F.col("bits") / F.col("bins"))


def tx_totals(tx: DataFrame, keys: list[str]) -> DataFrame:
    """Summed levels and coefficients of blocks' transforms; rows without the presence bit count nothing, negative values zero."""
    present = lambda flag, c: F.sum(F.when(F.col(flag), F.greatest(F.col(c), F.lit(0))).otherwise(0)).cast("long")
    return tx.groupBy(*keys).agg(present("has_abs_sum", "abs_sum").alias("abs_sum"), present("has_nonzero", "nonzero").alias("nonzero"), F.count(F.lit(1)).alias("transforms"))


def mv_points(refs: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Motion vectors in pixels: of prediction units, and of a block only where no unit of it has one."""
    units = refs.where("mvx is not null and mvy is not null")
    own = blocks.where("mvx is not null and mvy is not null").join(units, keys, "left_anti")
    point = lambda df, level: df.select(*keys, (F.col("mvx") / 4.0).alias("dx"), (F.col("mvy") / 4.0).alias("dy"), (F.col("list") == "L1").alias("is_l1"), F.lit(level).alias("level"))
    return point(units, "unit").unionByName(point(own, "block"))


def with_coefficients(blocks: DataFrame, tx: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with the summed levels and coefficients of their transforms, 0 without any."""
    totals = tx_totals(tx, keys).select(*keys, "abs_sum", "nonzero")
    return blocks.join(totals.hint("merge"), keys, "left").fillna(0, ["abs_sum", "nonzero"])


def fill_stats(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Bounds that colour scales need: least and most QP, most bits a pixel and longest vector; with blocks' abs_sum and nonzero
    also the most of these a pixel.
    """
    area = F.greatest(F.col("w") * F.col("h"), F.lit(1))
    a_pixel = lambda c: F.max(F.greatest(F.col(c), F.lit(0)) / area)
    more = [a_pixel(c).alias(name) for name, c in (("max_coeff", "abs_sum"), ("max_nz", "nonzero")) if c in blocks.columns]
    return blocks.groupBy(*by).agg(F.min("qp").alias("min_qp"), F.max("qp").alias("max_qp"), a_pixel("bits").alias("max_bpp"), F.max(labels.mv_pixels(F.col("mvx"), F.col("mvy"))).alias("max_mv"), *more)


def frame_summary(frames: DataFrame, blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """For display numbers (video, display_idx): poc, frame_type, decode_idx, slice_bits and the number of blocks; none for a number that no frame has."""
    shown = display_order(frames).select("video", "display_idx", "decode_idx", "poc", "frame_type", "slice_bits").join(asked, ["video", "display_idx"])
    counts = blocks.join(shown.select("video", "decode_idx").distinct(), ["video", "decode_idx"], "left_semi").groupBy("video", "decode_idx").agg(F.count(F.lit(1)).alias("n_blocks"))
    return shown.join(counts, ["video", "decode_idx"], "left").fillna(0, ["n_blocks"])


def inspected(blocks: DataFrame, refs: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """The blocks that are asked for (keys), with bits a pixel, the vector in pixels and their references: how many, and the lists in
    use. Blocks that don't exist give no row.
    """
    found = blocks.join(asked.select(*keys).distinct(), keys, "left_semi")
    per = refs.join(asked.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_refs"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    area = F.greatest(F.col("w") * F.col("h"), F.lit(1))
    values = {"bpp": F.greatest(F.col("bits"), F.lit(0)) / area, "dx": F.col("mvx") / 4.0, "dy": F.col("mvy") / 4.0}
    own = found.drop("list") if "list" in found.columns else found
    return own.join(per, keys, "left").fillna(0, ["n_refs"]).fillna("", ["lists"]).withColumns(values)


def shifted_display(shown: DataFrame, offset: int) -> DataFrame:
    """Frames of a viewer (video, frame_idx) with the display number of telemetry that belongs to them, null below the first."""
    at = F.col("frame_idx") + offset
    return shown.withColumn("display_idx", F.when(at >= 0, at))


def reference_numbers(current: DataFrame, reference: DataFrame) -> DataFrame:
    """Each frame (video, frame_idx) with the number of its reference: the same, at most the last one the reference has. Videos
    without a reference go.
    """
    last = reference.groupBy("video").agg(F.max("frame_idx").alias("last"))
    return current.join(last, "video").withColumn("reference_idx", F.least("frame_idx", "last")).drop("last")


def unit_places(units: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """Coding tree units (ctu, counted along rows) with their column and row; those beyond the picture go."""
    columns, rows = -(-width // size), -(-height // size)
    kept = units.where((F.col("ctu") >= 0) & (F.col("ctu") < columns * rows))
    return kept.withColumns({"col": F.col("ctu") % columns, "row": F.floor(F.col("ctu") / columns)})


def same_size(a: DataFrame, b: DataFrame) -> DataFrame:
    """Videos of a (video, width, height) whose size is known and equals that in b."""
    other = b.select("video", F.col("width").alias("w"), F.col("height").alias("h"))
    return a.join(other, "video").where("width > 0 and height > 0 and width = w and height = h").drop("w", "h")


def frame_totals(frames: DataFrame, blocks: DataFrame, tx: DataFrame, syntax: DataFrame, bins: DataFrame) -> DataFrame:
    """Per frame the counts of its rows of each kind, and its bits (of the data if known, else summed over blocks)."""
    keys = ["video", "decode_idx"]
    n = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    per = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.greatest(F.col("bits"), F.lit(0))).alias("block_bits"))
    out = frames.select(*keys, "data_bits").join(per, keys, "left")
    for df, name in ((tx, "transforms"), (syntax, "syntax_rows"), (bins, "bins")):
        out = out.join(n(df, name), keys, "left")
    return out.fillna(0, ["blocks", "block_bits", "transforms", "syntax_rows", "bins"]).withColumn("total_bits", F.coalesce("data_bits", "block_bits")).drop("data_bits", "block_bits")


def extent(blocks: DataFrame, by: list[str]) -> DataFrame:
    """The picture size that blocks reach to."""
    return blocks.groupBy(*by).agg(F.max(F.col("x") + F.col("w")).alias("width"), F.max(F.col("y") + F.col("h")).alias("height"))


def nearest_earlier(refs: DataFrame, frames: DataFrame) -> DataFrame:
    """As-of join: refs (video, decode_idx, ref_poc) with to_idx, the latest earlier frame of that POC (null: none).

    Frames are laid out with the references by (video, POC) and the last frame before each is carried along a window,
    so the work is a sort of each POC's rows, not a join of all pairs.
    """
    events = frames.select("video", F.col("poc").alias("p"), "decode_idx", F.col("decode_idx").alias("known"))
    left = refs.select("video", F.col("ref_poc").alias("p"), "decode_idx", F.struct(*refs.columns).alias("row"))
    both = left.withColumn("known", F.lit(None).cast("long")).unionByName(events.withColumn("row", F.lit(None).cast(left.schema["row"].dataType)))
    before = Window.partitionBy("video", "p").orderBy("decode_idx").rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("to_idx", F.max("known").over(before)).where("row is not null").select("row.*", "to_idx")


def reference_edges(refs: DataFrame, frames: DataFrame) -> DataFrame:
    """Edges between displayed frames, distinct: src and dst by display index, with the list."""
    at = display_order(frames).where("display_idx is not null").select("video", "decode_idx", "display_idx")
    found = nearest_earlier(refs, frames).where("to_idx is not null")
    src = at.withColumnRenamed("display_idx", "src")
    dst = at.select("video", F.col("decode_idx").alias("to_idx"), F.col("display_idx").alias("dst"))
    return found.join(src, ["video", "decode_idx"]).join(dst, ["video", "to_idx"]).select("video", "src", "dst", "list").distinct()


def reference_counts(edges: DataFrame) -> DataFrame:
    """How often each frame is referred to, and its tier."""
    return edges.groupBy("video", "dst").agg(F.countDistinct("src").alias("refs")).withColumn("tier", labels.ref_tier(F.col("refs")).cast("long"))


def hit_test(points: DataFrame, blocks: DataFrame, keys: list[str], order: list[str], cell: int = 64) -> DataFrame:
    """For each point (px, py) the smallest block that holds it, the first in order of those as small; points outside give no row.

    Blocks are laid out on a coarse grid, so points meet only the blocks that touch their cell. Neither side is broadcast: points are
    often made of fewer rows than they are, so that their size is estimated too low.
    """
    spread = blocks.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x") / cell), F.floor((F.col("x") + F.col("w") - 1) / cell)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("y") / cell), F.floor((F.col("y") + F.col("h") - 1) / cell))))
    at = points.withColumn("cx", F.floor(F.col("px") / cell)).withColumn("cy", F.floor(F.col("py") / cell))
    value = F.struct((F.col("w") * F.col("h")).alias("area"), *(F.col(c) for c in order))
    return at.hint("merge").join(spread, [*keys, "cx", "cy"]).where(holds(F.col("px"), F.col("py"))).groupBy(*keys, "px", "py").agg(F.min(value).alias("hit")).select(*keys, "px", "py", "hit.*")


def holds(px: Column, py: Column) -> Column:
    """Whether a block (x, y, w, h) holds a point."""
    return (px >= F.col("x")) & (px < F.col("x") + F.col("w")) & (py >= F.col("y")) & (py < F.col("y") + F.col("h"))


def hit_test_each(frames: DataFrame, points: list[tuple[int, int]], blocks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """hit_test where the same points are asked of every frame (keys). Each block says which points it holds, so frames are never
    multiplied by points, and blocks that hold none stay where they are.
    """
    asked = F.array(*(F.struct(F.lit(x).cast("long").alias("px"), F.lit(y).cast("long").alias("py")) for x, y in points))
    held = blocks.withColumn("at", F.filter(asked, lambda p: holds(p["px"], p["py"]))).where(F.size("at") > 0)
    known = held.join(frames.select(*keys).hint("merge"), keys, "left_semi")
    value = F.struct((F.col("w") * F.col("h")).alias("area"), *(F.col(c) for c in order))
    return known.select(*keys, value.alias("value"), F.inline("at")).groupBy(*keys, "px", "py").agg(F.min("value").alias("hit")).select(*keys, "px", "py", "hit.*")


def colocated(a: DataFrame, b: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Blocks of a with the smallest block of b that holds their centre, and the differences of QP and bits (null without one)."""
    centres = a.withColumn("px", F.col("x") + F.floor(F.col("w") / 2)).withColumn("py", F.col("y") + F.floor(F.col("h") / 2))
    hits = hit_test(centres.select(*keys, "px", "py").distinct(), b, keys, order).select(*keys, "px", "py", *(F.col(c).alias(f"b_{c}") for c in ("area", *order)))
    out = centres.join(hits, [*keys, "px", "py"], "left")
    return out.withColumn("d_qp", F.col("qp") - F.col("b_qp")).withColumn("d_bits", F.col("bits") - F.col("b_bits")).withColumn("mode_differs", F.col("mode") != F.col("b_mode"))


def active_references(dpb: DataFrame, slices: DataFrame) -> DataFrame:
    """Pictures in the buffer that a slice of the frame refers to."""
    return dpb.join(slices, ["video", "decode_idx", "poc"], "left_semi")


def exactness(rows: DataFrame, by: list[str]) -> DataFrame:
    """How many rows miss exact values, how many were dropped, and the sorted distinct keys of what is missing."""
    keys = rows.where("missing <> ''").select(*by, F.explode(F.split("missing", ",")).alias("key")).where("trim(key) <> ''")
    names = keys.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_set(F.trim("key"))), ",").alias("keys"))
    totals = rows.groupBy(*by).agg(F.count_if(F.col("missing") != "").alias("n_missing"), F.sum("dropped").alias("n_dropped"))
    return totals.join(names, by, "left").fillna("", ["keys"])


def intra_modes(syntax: DataFrame, names: list[str]) -> DataFrame:
    """Syntax rows of intra prediction modes with their value as a number; others and unreadable ones are left out."""
    value = F.expr("try_cast(trim(value) as int)")
    return syntax.where(F.col("name").isin(names)).withColumn("mode", value).where("mode is not null").withColumn("angle", labels.intra_angle_hevc(F.col("mode")))


def children_lists(children: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """Child rows nested as a list in order."""
    return children.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *cols))).alias("children"))


def resolution(parameter_sets: Column, width: Column, height: Column) -> Column:
    """Of parameter sets (structs kind, width, height) the first usable size, else the extent, else zero."""
    usable = F.filter(parameter_sets, lambda p: p["kind"].isin("sps", "sequence") & p["width"].between(1, 16384) & p["height"].between(1, 16384))
    first = F.get(usable, 0)
    return F.struct(F.coalesce(first["width"], width, F.lit(0)).alias("width"), F.coalesce(first["height"], height, F.lit(0)).alias("height"))
