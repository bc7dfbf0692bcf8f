"""Steps that have to hold on large tables: what is broadcast, dealt, shuffled and written. Results against plain loops."""

import contextlib
import io
import random

from pyspark.sql import functions as F

from framelake.operators import files, grids, points, telemetry
from framelake.plans import adapters
from framelake.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


@contextlib.contextmanager
def setting(spark, name, value):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    yield
    spark.conf.set(name, before)


def test_points_are_not_broadcast(spark):
    points = spark.range(3).select(F.col("id").alias("decode_idx"), F.explode(F.array(F.lit(1), F.lit(9))).alias("px"), F.lit(2).alias("py"))
    for df in (QUERIES["hit_test"](spark, SF), telemetry.hit_test(points, adapters.blocks(spark, SF), ["decode_idx"], ["qp"])):
        assert "BroadcastExchange" not in plan(df)


def test_totals_of_transforms_are_not_broadcast(spark):
    assert "Broadcast" not in plan(QUERIES["rasterize_coefficients"](spark, SF))


def test_hits_of_each_frame(spark):
    r = random.Random(4)
    rows = [(f, 8 * r.randrange(9), 8 * r.randrange(9), r.choice([8, 16, 64]), r.choice([8, 16, 64]), r.randrange(3)) for f in range(99) for _ in range(r.randrange(9))]
    points, kept = [(3, 5), (41, 70), (63, 8), (500, 1)], [*range(3, 120), 4]
    blocks = spark.createDataFrame(rows, "f long, x long, y long, w long, h long, qp long")
    frames = spark.createDataFrame([(f,) for f in kept], "f long")
    want = {}
    for f, x, y, w, h, qp in rows:
        for px, py in points:
            if f in kept and x <= px < x + w and y <= py < y + h:
                want[f, px, py] = min(want.get((f, px, py), (1 << 30,)), (w * h, x, y, qp))
    each = telemetry.hit_test_each(frames, points, blocks, ["f"], ["x", "y", "qp"])
    listed = frames.crossJoin(spark.createDataFrame(points, "px long, py long"))
    for got in (each, telemetry.hit_test(listed, blocks, ["f"], ["x", "y", "qp"], 16)):
        found = [tuple(x) for x in got.collect()]
        assert len(found) == len(want) > 20 and {x[:3]: x[3:] for x in found} == want


def test_cells_are_never_shuffled(spark):
    shuffles = {"rasterize": 1, "resample_mean": 1, "resample_angle": 1, "resample_class": 1, "telemetry_to_coarse": 1, "diff_grid": 2, "subtract_grid": 2}
    for name, n in shuffles.items():
        text = plan(QUERIES[name](spark, SF))
        assert (text.count("Exchange"), text.count("Exchange hashpartitioning(frame#"), text.count("Join")) == (n, n, 0), name
    text = plan(QUERIES["valid_share"](spark, SF))
    assert "REPARTITION_BY_NUM" in text and "rank" not in "".join(x for x in text.splitlines() if "ENSURE_REQUIREMENTS" in x)


def test_parts_grow_with_blocks(spark):
    blocks = spark.createDataFrame([(f, 0, 0, 8, 8, f, 64, m, 1, 1) for f in range(9) for m in ("intra", "skip")], "frame long, x long, y long, w long, h long, qp long, bits long, mode string, mvx long, mvy long")
    text = plan(grids.rasterize(blocks, 8, 16, 16, ["frame"], 25 * grids.BLOCKS_A_TASK + 1))
    assert "hashpartitioning(frame#" in text and ", 26), REPARTITION_BY_NUM" in text
    assert sorted((r.frame, r.c, r.r, r.qp, r.mode, r.coverage) for r in grids.rasterize(blocks, 8, 16, 16, ["frame"]).collect()) == [(f, 0, 0, f, 2, 2.0) for f in range(9)]


def test_folded_frames_are_dealt_by_what_they_fold_on_to(spark):
    r = random.Random(6)
    rows = [(f, 8 * r.randrange(4), 8 * r.randrange(4), 8, 8, r.randrange(9), r.randrange(640), r.choice(["intra", "inter", "skip"]), 4, 4) for f in range(60) for _ in range(6)]
    blocks = spark.createDataFrame(rows, "frame long, x long, y long, w long, h long, qp long, bits long, mode string, mvx long, mvy long")
    for n, parts in ((4, 5), (25, 5)):
        got = grids.folded(blocks, n, 8, 32, 32, parts * grids.BLOCKS_A_TASK)
        text = plan(got)
        assert "hashpartitioning(fold#" in text and "salt#" in text and f", {parts}), REPARTITION_BY_NUM" in text and text.count("Exchange") == 2
        # what parts send on: a folded frame lies in a part for each of its salts at most
        by = grids.rasterize(blocks, 8, 32, 32, ["frame"]).withColumn("frame", F.col("frame") % n).groupBy("frame", "c", "r").agg(*(F.avg(x).alias(x) for x in ("qp", "bpp", "mv", "coverage")), F.max("mode").alias("mode"))
        flat = lambda df: {(x.frame, x.c, x.r): (*(round(x[k], 9) for k in ("qp", "bpp", "mv", "coverage")), x.mode) for x in df.collect()}  # noqa: E731, B023
        want = flat(by)
        assert flat(got) == want and len(want) > 50


def test_differences_where_a_grid_lacks_cells(spark):
    cells = lambda rows: spark.createDataFrame(rows, "f long, gc long, gr long, v double, valid boolean")
    a = cells([(0, 0, 0, 3.0, True), (0, 1, 0, None, True), (0, 2, 0, 4.0, False), (0, 3, 0, 5.0, True)])
    b = cells([(0, 0, 0, 1.0, True), (0, 1, 0, 1.0, True), (0, 2, 0, 1.0, True), (0, 4, 0, 1.0, True)])
    got = sorted(tuple(r) for r in grids.subtract(a, b, ["v"], ["f"]).collect())
    assert got == [(0, 0, 0, 2.0, True), (0, 1, 0, None, True), (0, 2, 0, 3.0, False), (0, 3, 0, 0.0, False)]
    fine = lambda g: g.withColumnsRenamed({"gc": "c", "gr": "r"}).withColumn("coverage", F.lit(1.0))
    assert sorted(tuple(r) for r in grids.difference(fine(a), fine(b), "v", ["f"]).collect()) == [(0, 0, 0, -2.0), (0, 1, 0, None), (0, 2, 0, -3.0)]


def test_nearest_is_one_join(spark):
    text = plan(QUERIES["nearest_point"](spark, SF))
    assert text.count("Join") == 1 and "Broadcast" not in text and "lineitem" in text and "orders" in text


def test_nearest_of_many_at_one_spot(spark):
    inf = float("inf")
    known = spark.range(2000).select(F.lit(0).alias("v"), (5000 - F.col("id")).alias("point"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    more = spark.createDataFrame([(0, 1, 1.15, 1.0), (0, 2, inf, 1.0), (0, 3, -inf, 1e300), (0, 4, 9.8, 9.9)], known.schema)
    asked = spark.createDataFrame([(0, 7, 1.01, 1.0), (0, 8, 1.1, 1.0), (0, 8, 9.9, 9.9), (0, 9, inf, 1.0), (0, 10, 1.3, 1.0), (0, 11, 9.8, 9.9)], "v int, place long, x double, y double")
    got = {(r.place, r.point): round(r.distance, 9) for r in points.nearest(known.union(more), asked, ["v"], 10.0, 10.0).collect()}
    assert got == {(7, 3001): 0.001, (8, 1): 0.005, (10, 1): 0.015, (11, 4): 0.0}


def test_documents_are_parsed_once(spark):
    for name in ("meta_reference_lists", "meta_parameter_fields", "meta_slice_headers"):
        text = plan(QUERIES[name](spark, SF))
        assert text.count("parseJson(") == 1 and "format_string" not in text and text.count("map_entries(") <= 1, name


def test_marks_of_one_video_are_dealt(spark):
    r = random.Random(5)
    marks, at = [r.randrange(900) for _ in range(150)], [r.randrange(900) for _ in range(300)]
    of = lambda values, name: spark.createDataFrame([("a", v) for v in values] + [(None, 7)], f"video string, {name} long")
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"), setting(spark, "spark.sql.shuffle.partitions", "7"):
        got = files.neighbours(of(marks, "frame"), of(at, "current"))
        parts = got.where("video = 'a'").select(F.spark_partition_id()).distinct().count()
        found = sorted(tuple(x) for x in got.where("video = 'a'").collect())
        assert [tuple(x) for x in got.where("video is null").collect()] == [(None, 7, None, None)]
    want = sorted((("a", c, max((m for m in marks if m < c), default=None), min((m for m in marks if m > c), default=None)) for c in at))
    key = lambda x: (x[1], str(x))
    assert sorted(found, key=key) == sorted(want, key=key) and parts > 1
