"""Two videos with the same frame numbers don't mix; bad frames don't fail the job."""

import pytest

from framelake.operators import decode, frames

SCHEMA = "video string, frame int, x int, y int, r int, g int, b int"
LEVELS = {("a", 0): 10, ("a", 1): 10, ("b", 0): 200, ("b", 1): 20}


@pytest.fixture(scope="module")
def px(spark):
    return spark.createDataFrame([(v, f, x, y, n, n, n) for (v, f), n in LEVELS.items() for x in range(8) for y in range(8)], SCHEMA)


def test_motion(px):
    got = {(r.video, r.frame): (round(r.score, 6), r["class"]) for r in frames.motion_by_stats(px).collect()}
    assert got == {("a", 1): (0.0, "static"), ("b", 1): (180.0, "full")}


def test_frames_of_two_videos_stay_apart(px):
    """By default a frame is named by its video and number."""
    assert frames.histogram(px).count() == 4 * 256 and frames.block_stats(px).count() == 4 and frames.waveform(px, 8).count() == 4 * 8
    assert frames.vectorscope(px, 8, 8).columns[:2] == ["video", "frame"] and frames.block_and_frame_stats(px, 4).count() == 4 * 5
    assert {(r.video, r.frame): r.mean for r in frames.grid_summary(frames.block_stats(px), "mean").collect()}.keys() == LEVELS.keys()
    assert frames.motion_summary(frames.motion_by_stats(px)).count() == 2


def test_bad_frames(spark):
    good = bytes(range(24))
    rows = [("v", 0, 4, 4, "YU12", bytearray(good)), ("v", 1, 4, 4, "YU12", None), ("v", 2, 4, 4, "YU12", bytearray(b"x")), ("v", 3, None, 4, "YU12", bytearray(good)), ("v", 4, 4, 4, "none", bytearray(good))]
    df = spark.createDataFrame(rows, "video string, frame_idx long, width int, height int, fourcc string, data binary")
    assert {r.frame_idx for r in decode.channels(df).collect()} == {0}
    points = spark.createDataFrame([("v", i, 1, 1) for i in range(5)], "video string, frame_idx long, x int, y int")
    got = {r.frame_idx: r.components for r in decode.pixel_info(df, points).collect()}
    assert got[0] == {"Y": 5, "U": 16, "V": 20} and all(got[i] == {} for i in range(1, 5))
