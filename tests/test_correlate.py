"""Pooled ranks, scans and nearest points against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from framelake.operators import correlate, points


def plain_ranks(values):
    order = sorted(values)
    return {v: order.index(v) + (order.count(v) + 1) / 2 for v in set(values)}


def plain_r(a, b):
    n, ma, mb = len(a), sum(a) / len(a), sum(b) / len(b)
    va, vb = sum((x - ma) ** 2 for x in a), sum((y - mb) ** 2 for y in b)
    return sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / math.sqrt(va * vb) if n > 1 and va > 1e-9 and vb > 1e-9 else None


def test_ranks_over_ranges(spark):
    r = random.Random(1)
    values = [r.choice([r.randrange(20), r.random() * 20]) for _ in range(500)] + [7.0] * 300
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(7)
    got = {x.v: x["rank"] for x in correlate.pooled_ranks(df, "v").collect()}
    assert got == plain_ranks([float(v) for v in values])
    assert correlate.pooled_ranks(df.where("false"), "v").count() == 0


def test_scan(spark):
    r = random.Random(2)
    rows = [(f, float(r.randrange(6)), float(r.randrange(6)) if f else 1.0, r.random() < 0.8) for f in range(4) for _ in range(40)] + [(9, 1.0, 2.0, False)]
    got = {x.frame: (x.n, x.r, x.rho) for x in correlate.correlation_scan(spark.createDataFrame(rows, "frame int, a double, b double, valid boolean")).collect()}
    assert set(got) == {0, 1, 2, 3, None}
    for f, (n, pearson, rho) in got.items():
        a, b = zip(*((x, y) for g, x, y, ok in rows if ok and f in (g, None)), strict=True)
        ra, rb = plain_ranks(a), plain_ranks(b)
        assert n == len(a)
        for value, want in ((pearson, plain_r(a, b)), (rho, plain_r([ra[x] for x in a], [rb[y] for y in b]))):
            assert value is None if want is None else value == pytest.approx(want)


def test_nearest(spark):
    r = random.Random(3)
    spot = lambda: (r.choice([r.random() * 10, r.randrange(40) / 4]), r.choice([r.random() * 5, r.randrange(20) / 4]))
    known = [(k % 2, k, *spot()) for k in range(700)] + [(0, 900, None, 1.0)]
    asked = [(k % 2, k, *spot()) for k in range(200)] + [(0, 901, 1.0, None), (3, 902, 1.0, 1.0)]
    schema = "video int, {} long, x double, y double"
    got = points.nearest(spark.createDataFrame(known, schema.format("point")), spark.createDataFrame(asked, schema.format("place")), ["video"], 10.0, 5.0, 0.05)
    want = {}
    for v, place, x, y in asked:
        found = [(((p - x) / 10) ** 2 + ((q - y) / 5) ** 2, k) for w, k, p, q in known if w == v and None not in (p, x, y)]
        if found and math.sqrt(min(found)[0]) < 0.05:
            want[v, place] = min(found)[1]
    assert {(x.video, x.place): x.point for x in got.collect()} == want and 50 < len(want) < 200


def test_scales(spark):
    df = spark.createDataFrame([(0, -3.0, True), (0, 2.0, True), (0, 9.0, False), (1, None, True)], "frame int, z double, valid boolean")
    assert {r.frame: r.most for r in correlate.scale_of(df.withColumn("z", F.when(F.col("valid"), F.col("z"))), ["frame"]).collect()} == {0: 3.0, 1: 0.0}
    assert {r.frame: r.max_abs for r in correlate.max_abs(df, "z", ["frame"]).collect()} == {0: 3.0, 1: 0.0}
