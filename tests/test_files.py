"""Small operators on files, marks and colours."""

import random

import numpy as np
from pyspark.sql import functions as F

from framelake.functions import labels
from framelake.operators import files, frames, telemetry


def test_kinds(spark):
    rows = [("a.yuv", b"CATB0001xx"), ("b.CATB", b""), ("c.265", b""), ("d", b"\x09\x00\x00\x01\x40"), ("e.bin", b"\x00\x00\x00\x01"), ("f.yuv", b"\x00\x00\x00\x01"), ("g", b"\x90\x00\x00\x10"), ("h.bin", b"x" * 40 + b"\x00\x00\x01")]
    df = spark.createDataFrame([(p, bytearray(h)) for p, h in rows], "path string, head binary")
    assert [r[0] for r in df.select(files.kind(F.col("path"), F.col("head"))).collect()] == ["telemetry", "telemetry", "bitstream", "bitstream", "bitstream", "other", "other", "other"]


def test_scenes_and_marks(spark, tmp_path):
    files.save_scenes(spark.createDataFrame([(30,), (4,)], "frame long").coalesce(1), str(tmp_path / "s"))
    marks = files.scene_list(spark, str(tmp_path / "s")).withColumn("video", F.lit("a"))
    assert sorted(r.frame for r in marks.collect()) == [4, 30]
    at = spark.createDataFrame([("a", 4), ("a", 10), ("a", 99), ("b", 1)], "video string, current long")
    assert {tuple(r) for r in files.neighbours(marks, at).collect()} == {("a", 4, None, 30), ("a", 10, 4, 30), ("a", 99, 30, None), ("b", 1, None, None)}


def test_newest_and_stage(spark):
    listed = spark.createDataFrame([("v", "/d/a", 1), ("v", "/d/c", 5), ("v", "/d/b", 5)], "run string, path string, mtime long")
    assert files.newest(listed, ["run"]).first().path == "/d/c"
    frames = spark.createDataFrame([(0, "a"), (1, "x/b"), (2, "none"), (3, "/d/c")], "decode_idx long, stage string")
    assert {(r.decode_idx, r.path) for r in files.with_stage(frames, listed, "/d").collect()} == {(0, "/d/a"), (1, "/d/b"), (2, None), (3, "/d/c")}


def test_chroma_layout(spark):
    w = h = 16
    ramp = np.add.outer(np.arange(8), np.arange(8)).astype(np.uint8)
    u, v = ramp + 20, 200 - ramp
    split = bytes(w * h) + u.tobytes() + v.tobytes()
    mixed = bytes(w * h) + np.stack((u, v), -1).tobytes()
    rows = [("a", 0, w, h, bytearray(split)), ("a", 1, w, h, bytearray(mixed)), ("a", 2, w, h, bytearray(w * h * 2)), ("a", 3, w, h, None)]
    df = spark.createDataFrame(rows, "video string, frame_idx long, width int, height int, data binary")
    assert [r.layout for r in files.chroma_layout(df).orderBy("frame_idx").collect()] == ["YU12", "NV12", None, None]


def test_more_labels(spark):
    r = spark.range(1).select(
        labels.intra_angle_avc(F.lit(5)).alias("a"), labels.intra_angle_avc(F.lit(2), True).alias("b"), labels.intra_badge(F.lit("intra16x16_pred_mode"), F.lit(3)).alias("c"),
        labels.level_at(F.array(F.lit(4), F.lit(-5)), F.array(F.lit(0), F.lit(3))).alias("d"), labels.coeff_columns(F.lit(64), F.lit(2), F.lit(2), F.lit(4)).alias("e"),
        labels.metric_colour("signed", F.lit(-64.0)).alias("f"), labels.metric_colour("psnr", F.lit(float("inf"))).alias("g"),
    ).first()
    assert tuple(r) == (90.0 + labels.HALF, 90.0, "P", [4, 0, 0, -5], 8, [255, 35, 25], [30, 210, 70])


def test_byte_stream_of_a_container(spark):
    from framelake.operators import files

    containers = spark.createDataFrame([("/d/clip.265.catb-run/out.catb",), ("/d/a.catb",), ("/d/b.x.catb",), ("/d/none.catb",), ("/d/gone.catb-run/a.catb",), ("top.catb",)], "path string")
    listed = spark.createDataFrame([("/d/clip.265",), ("/d/clip.265.catb-run/out.hevc",), ("/d/a.bin",), ("/d/a.h264",), ("/d/b.x.avc",), ("/d/gone.catb-run/a.265",), ("top.h265",)], "path string")
    got = {r.path: r.bitstream for r in files.bitstream_of(containers, listed).collect()}
    assert got == {"/d/clip.265.catb-run/out.catb": "/d/clip.265", "/d/a.catb": "/d/a.h264", "/d/b.x.catb": "/d/b.x.avc", "/d/none.catb": None, "/d/gone.catb-run/a.catb": "/d/gone.catb-run/a.265", "top.catb": "top.h265"}


def test_small_look_ups(spark):
    from pyspark.sql import functions as F

    from framelake.functions import labels
    from framelake.operators import telemetry

    shown = spark.createDataFrame([("a", 0), ("a", 3)], "video string, frame_idx long")
    assert [r.display_idx for r in telemetry.shifted_display(shown, -1).orderBy("frame_idx").collect()] == [None, 2]
    sizes = "video string, width int, height int"
    kept = telemetry.same_size(spark.createDataFrame([("a", 4, 4), ("b", 4, 4), ("c", 0, 0)], sizes), spark.createDataFrame([("a", 4, 4), ("b", 4, 2), ("c", 0, 0)], sizes))
    assert [tuple(r) for r in kept.collect()] == [("a", 4, 4)]
    words = spark.range(1).select(labels.is_transform_skip(F.lit("ts_skip")).alias("a"), labels.is_transform_skip(F.lit(None).cast("string")).alias("b"), labels.quality_text("psnr", F.lit(float("inf"))).alias("c"), labels.metric_text("ms_psnr", F.lit(31.456)).alias("d")).first()
    assert tuple(words) == (True, False, "e", "31.5 dB")
    tx = spark.createDataFrame([(0, 1, True, True, 9, 2), (0, 1, True, False, -4, 7)], "v int, b int, has_abs_sum boolean, has_nonzero boolean, abs_sum long, nonzero long")
    blocks = spark.createDataFrame([(0, 1), (0, 2)], "v int, b int")
    assert sorted(tuple(r) for r in telemetry.with_coefficients(blocks, tx, ["v", "b"]).collect()) == [(0, 1, 9, 2), (0, 2, 0, 0)]


def test_numbers_in_words(spark):
    """As C's printf rounds, halves and shortest decimals included."""
    values = [0.125, 0.375, 0.15, 0.25, 0.35, 2.5, -0.04, -0.0, 0.0, 123456.785, 0.005, 1.005, 99.995, 9.995, 0.95, 1234567890.05, 2.675, 1e-320]
    rng = random.Random(3)
    values += [rng.uniform(-1000, 1000) for _ in range(300)] + [rng.randint(-4000, 4000) / rng.choice([8, 16, 40, 200, 1000]) for _ in range(600)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    texts = [labels.rounded_text(F.col("v"), n, n == 1).alias(f"t{n}") for n in range(5)]
    for r in df.select("v", *texts).collect():
        assert (r.t0, r.t1, r.t2, r.t3, r.t4) == (f"{r.v:.0f}", f"{r.v:+.1f}", f"{r.v:.2f}", f"{r.v:.3f}", f"{r.v:.4f}")
    odd = spark.sql("SELECT double('NaN') AS a, double('-Infinity') AS b, double(null) AS c")
    assert tuple(odd.select(*(labels.rounded_text(F.col(c), 2) for c in "abc")).first()) == ("NaN", "-inf", None)
    fine = odd.select(labels.metric_text("ms_psnr", F.col("b")), labels.quality_text("psnr", F.col("a")), labels.quality_text("ssim", F.lit(0.98765)), labels.metric_text("signed", F.lit(3.0)), labels.fill_text("mv", F.lit(2.5), F.lit(30)), labels.fill_text("qp", F.lit(2.5), F.lit(30)))
    assert tuple(fine.first()) == ("∞ dB", "e", "0.988", "+3.0", "2.5", "30")
    side = odd.select(labels.side_class("iso", F.lit(2)), labels.side_class("exposure", F.lit(7)), labels.side_class("histogram", F.lit(3)), labels.dynamic_range_text(F.lit(200)), labels.distortion_text(F.lit(-5)), labels.side_frame_text(*map(F.lit, range(8))), labels.side_unit_text(*map(F.lit, (1, 2, 3, -4, 300))))
    assert tuple(side.first()) == ("High", "7", "Bimodal", "12.5 stops", "-0.05", "Frame(id=0, scene=1, noise=2, motion=3, qp_bias=4, iso=5, ae=6, ctus=7)", "CTU(act=1, flat=2, edge=3, qp_delta=-4, lambda=1.172)")


def test_split_view_and_inspected_blocks(spark):
    w, h = 5, 4
    px = spark.createDataFrame([(1, x, y, 10 * x + y, x, y) for x in range(w) for y in range(h)], "frame int, x int, y int, r int, g int, b int")
    grey = lambda c: (F.col(c),) * 3
    out = {(r.x, r.y): (r.r, r.g, r.b) for r in frames.split_view(px, [tuple(map(F.col, "rgb")), *map(grey, "rgb")], w, h).collect()}
    assert len(out) == w * h and all(out[4, y] == (0, 0, 0) for y in range(h))
    for x in range(2):
        for y in range(2):
            r, g, b = 20 * x + 2 * y, 2 * x, 2 * y
            assert [out[x, y], out[x + 2, y], out[x, y + 2], out[x + 2, y + 2]] == [(r, g, b), (r,) * 3, (g,) * 3, (b,) * 3]
    blocks = spark.createDataFrame([(1, 1, 8, 8, 128, 6, -2), (1, 2, 8, 4, -1, None, None), (2, 1, 8, 8, 9, 0, 0)], "f int, block int, w int, h int, bits int, mvx int, mvy int")
    refs = spark.createDataFrame([(1, 1, "L1"), (1, 1, "L0"), (1, 1, "L0"), (2, 1, "L0")], "f int, block int, list string")
    asked = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (7, 7)], "f int, block int")
    got = {(r.f, r.block): (r.bpp, r.dx, r.dy, r.n_refs, r.lists) for r in telemetry.inspected(blocks, refs, asked, ["f", "block"]).collect()}
    assert got == {(1, 1): (2.0, 1.5, -0.5, 3, "L0,L1"), (1, 2): (0.0, None, None, 0, "")}
