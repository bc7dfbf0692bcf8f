"""Queries run over whole tables: on a fixture that reaches past every bound that was once there."""

import duckdb
import pytest
from test_queries import normal

from framelake.functions import nal
from framelake.operators import frames
from framelake.plans.queries import ORACLES, QUERIES

RASTERS = ["rasterize", "resample_mean", "resample_angle", "resample_class", "telemetry_to_coarse", "diff_grid", "subtract_grid"]
ALIGNED = ["align", "pearson", "spearman", "correlation_scan", "opportunity", "top_cells", "class_table", "valid_share"]


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Telemetry frames on both sides of 2048, and ten pixel frames."""
    at, con = tmp_path_factory.mktemp("small"), duckdb.connect()
    source = {
        "lineitem": "'/root/testdata/sf0.01/lineitem.parquet' WHERE l_orderkey BETWEEN 1990 AND 2110 OR l_orderkey > 14900",
        "orders": "'/root/testdata/sf0.01/orders.parquet' WHERE o_orderkey % 25 = 3",
        "pages": "'/root/testdata/sf0.01/pages.parquet' WHERE page_id % 5 = 0",
        "embeddings": "'/root/testdata/sf0.1/embeddings.parquet' WHERE vec_id < 640",
    }
    for name, rows in source.items():
        con.execute(f"COPY (SELECT * FROM {rows}) TO '{at}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet'")
    return str(at), con


def same(spark, small, name):
    at, con = small
    found = con.execute(ORACLES[name])
    got = QUERIES[name](spark, at)
    rows = [tuple(r) for r in got.collect()]
    assert normal(rows, got.columns) == normal(found.fetchall(), [c[0] for c in found.description])
    return rows


@pytest.mark.parametrize("name", RASTERS)
def test_all_telemetry_frames(spark, small, name):
    frames = [r[0] for r in same(spark, small, name)]
    assert min(frames) < 2048 < 14900 < max(frames)


@pytest.mark.parametrize("name", ALIGNED)
def test_all_telemetry_frames_aligned(spark, small, name):
    rows = same(spark, small, name)
    assert {r[0] for r in rows} - {None} == set(range(10))


def test_all_records(spark, small):
    same(spark, small, "frame_block_join")


def test_all_points(spark, small):
    assert len(same(spark, small, "vectorscope")) == 10 * 64 * 64


def test_points_of_large_frames(spark):
    px = spark.createDataFrame([(0, x, y, x, y, 7) for x in range(6) for y in range(5)], "frame int, x int, y int, r int, g int, b int")
    drawn = lambda most: sorted(r.y * 6 + r.x for r in frames.vectorscope(px, 6, 5, ["frame"], most).collect())
    assert [drawn(n) for n in (30, 29, 10, 4)] == [list(range(30)), list(range(30)), list(range(0, 30, 3)), list(range(0, 30, 7))]


def test_all_bytes(spark, small):
    offsets = [r[1] for r in same(spark, small, "hex_dump")]
    assert max(offsets) >= 4096


def test_hex_pages(spark):
    data = bytes(range(256)) * 33 + b"end"
    df = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray()), ("c", None), ("d", bytearray(4096))], "k string, data binary")
    lines = sorted(nal.hex_lines(df, ["k"]).where("k <> 'd'").collect(), key=lambda r: r.offset)
    assert {r.k for r in lines} == {"a"} and bytes.fromhex("".join(r.hex for r in lines)) == data
    assert [(r.page, r.offset) for r in lines] == [(i // 4096, i) for i in range(0, len(data), 16)]
    assert (lines[-1].hex, lines[-1].ascii) == ("65 6E 64", "end")
    assert sorted(nal.hex_lines(df, ["k"], page=1).collect()) == [r for r in lines if r.page == 1]
    assert {(r.k, r.page) for r in nal.hex_lines(df, ["k"], page=0).collect()} == {("a", 0), ("d", 0)}
