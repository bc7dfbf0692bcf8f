"""Pairs of frames against plain loops; videos, gaps, sizes and stretches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import pictures
from framelake.operators import pairs

SCHEMA = "video string, frame_idx long, width int, height int, rgb binary"


def luma(rgb):
    return rgb[..., 0] * 0.2126 + rgb[..., 1] * 0.7152 + rgb[..., 2] * 0.0722


def plain_terms(a, b):
    ma, mb = a.mean(), b.mean()
    cs = (2 * ((a - ma) * (b - mb)).mean() + 58.5225) / (((a - ma) ** 2).mean() + ((b - mb) ** 2).mean() + 58.5225)
    return (2 * ma * mb + 6.5025) / (ma * ma + mb * mb + 6.5025) * cs, cs


def plain_components(a, b):
    h, w = a.shape
    if w < 11 or h < 11 or w * h <= 4096:
        found = [plain_terms(a, b)]
    else:
        found = [plain_terms(a[y : y + 11, x : x + 11], b[y : y + 11, x : x + 11]) for y in range(h - 10) for x in range(w - 10)]
    return [max(-1, min(1, v)) for v in np.mean(found, axis=0)]


def plain_scales(a, b, most):
    out = [(a, b)]
    while len(out) < most and min(a.shape) >= 2:
        a, b = (np.array([[p[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].mean() for x in range(p.shape[1] // 2)] for y in range(p.shape[0] // 2)]) for p in (a, b))
        out.append((a, b))
    return out


def plain_ms_psnr(a, b):
    db = [math.inf if (m := ((x - y) ** 2).mean()) <= 2.3e-16 else 10 * math.log10(65025 / m) for x, y in plain_scales(a, b, 4)]
    weights = [0.4, 0.3, 0.2, 0.1][: len(db)]
    return math.inf if all(d == math.inf for d in db) else sum((100 if d == math.inf else d) * w for d, w in zip(db, weights, strict=True)) / sum(weights)


def plain_ms_ssim(a, b):
    found = [plain_components(x, y) for x, y in plain_scales(a, b, 5)]
    weights = [0.0448, 0.2856, 0.3001, 0.2363, 0.1333][: len(found)]
    score = 1
    for k, (s, cs) in enumerate(found):
        score *= max(0, s if k == len(found) - 1 else cs) ** (weights[k] / sum(weights))
    return max(0, min(1, score))


def plain_edges(a):
    h, w = a.shape
    return np.mean([abs(a[y, x + 1] - a[y, x]) + abs(a[y + 1, x] - a[y, x]) for y in range(h - 1) for x in range(w - 1)]) if min(h, w) > 1 else 0.0


def plain_vmaf(ref, cur):
    p = plain_ms_psnr(ref, cur)
    norm = 1 if p == math.inf else max(0, min(1, (p - 20) / 30))
    e = plain_edges(ref)
    return max(0, min(100, 100 * (0.72 * plain_ms_ssim(ref, cur) + 0.28 * norm) - 20 * max(0, (plain_edges(cur) - e) / max(e, 1))))


def shots(seed, w, h, noise):
    r = np.random.default_rng(seed)
    a = (np.add.outer(np.arange(h) * 5, np.arange(w) * 3)[..., None] + [0, 40, 90]) % 256
    return a.astype(np.uint8), np.clip(a + r.normal(0, noise, a.shape), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("w,h,noise", [(70, 66, 9), (17, 33, 30), (7, 5, 3), (1, 9, 20), (64, 64, 0)])
def test_kernels_equal_loops(w, h, noise):
    a, b = shots(w * h, w, h, noise)
    x, y = luma(a.astype(float)), luma(b.astype(float))
    got = pairs.metrics("mse", "psnr", "diff", "ssim", "ms_psnr", "ms_ssim", "vmaf", "delta_mean", "delta_var", "block_ssim").run(a, b, None)
    d = a.astype(float) - b
    windows = [plain_terms(x[j : j + 11, i : i + 11], y[j : j + 11, i : i + 11])[0] for j in range(h - 10) for i in range(w - 10)] if min(w, h) >= 11 else [plain_terms(x, y)[0]]
    blocks = [plain_terms(x[j : j + 8, i : i + 8], y[j : j + 8, i : i + 8])[0] for j in range(0, h - 7, 8) for i in range(0, w - 7, 8)] or [1.0]
    want = [(d * d).mean(), math.inf if not d.any() else 10 * math.log10(65025 / (d * d).mean()), abs(d).mean(), np.mean(windows), plain_ms_psnr(x, y), plain_ms_ssim(x, y), plain_vmaf(x, y), (x - y).mean(), (x - y).var(), np.mean(blocks)]
    assert [v[0] for v in got] == pytest.approx(want, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("size", [16, 24, 0, 200])
def test_tiles_equal_loops(size):
    w, h = 75, 66
    a, b = shots(5, w, h, 12)
    x, y, side = luma(a.astype(float)), luma(b.astype(float)), size or 64
    got = {(bx, by): v for bx, by, *v in zip(*pairs.tile_map("signed", "ms_psnr", "ms_ssim", "vmaf", size=size).run(a, b, None), strict=True)}
    assert len(got) == -(-w // side) * -(-h // side)
    for (bx, by), v in got.items():
        p, q = (z[by * side : (by + 1) * side, bx * side : (bx + 1) * side] for z in (x, y))
        assert v == pytest.approx([(q - p).mean(), plain_ms_psnr(p, q), plain_ms_ssim(p, q), plain_vmaf(p, q)], rel=1e-9, abs=1e-9)


def test_regions_equal_loops():
    a, b = shots(8, 40, 30, 15)
    x, y = luma(a.astype(float)), luma(b.astype(float))
    wanted = [{"k": k, "x": r[0], "y": r[1], "w": r[2], "h": r[3]} for k, r in enumerate([(0, 0, 40, 30), (3, 4, 5, 6), (-4, 20, 10, 50), (39, 29, 1, 1), (50, 0, 3, 3), (5, 5, 0, 3)])]
    got = {k: (p, s) for k, p, s in zip(*pairs.regions().run(a, b, wanted), strict=True)}
    assert set(got) == {0, 1, 2, 3}
    for k, (p, s) in got.items():
        r = wanted[k]
        u, v = (z[max(0, r["y"]) : r["y"] + r["h"], max(0, r["x"]) : r["x"] + r["w"]] for z in (x, y))
        mse = ((u - v) ** 2).mean()
        assert (p, s) == pytest.approx((10 * math.log10(65025 / mse) if mse else math.inf, plain_terms(u, v)[0]), rel=1e-7)
    assert [len(c) for c in pairs.regions().run(a, b, None)] == [0, 0, 0]


def test_orientation_equals_loops():
    v = luma(shots(3, 21, 18, 40)[1].astype(float))
    v[:8, :8] = 50
    h, w, bins, cell = *v.shape, 16, 8
    weight = {}
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            n = lambda dy, dx: v[y + dy, x + dx]  # noqa: E731, B023
            gx = n(-1, 1) - n(-1, -1) + 2 * (n(0, 1) - n(0, -1)) + n(1, 1) - n(1, -1)
            gy = n(1, -1) - n(-1, -1) + 2 * (n(1, 0) - n(-1, 0)) + n(1, 1) - n(-1, 1)
            m, angle = math.hypot(gx, gy), (math.degrees(math.atan2(gy, gx)) + 90) % 180
            if m >= 1:
                s = weight.setdefault((x // cell, y // cell), {}).setdefault(min(bins - 1, int(angle / 180 * bins)), [0, 0])
                s[0] += m
                s[1] += m * angle
    got = {(bx, by): v for bx, by, *v in zip(*pictures.orientation(v, cell), strict=True)}
    assert len(got) == 9
    for at, (angle, purity) in got.items():
        top = max((s[0], k, s[1]) for k, s in weight[at].items()) if at in weight else (1, 0, 0)
        assert (angle, purity) == pytest.approx((top[2] / top[0], top[0] / sum(s[0] for s in weight[at].values())) if at in weight else (0, 0))
    assert [c.tolist() for c in pictures.orientation(np.full((8, 9), 7.0), 8)] == [[0, 1], [0, 0], [0.0, 0.0], [0.0, 0.0]]


def frame(video, number, level, w=8, h=8):
    return (video, number, w, h, None if level is None else bytearray([level] * (w * h * 3)))


def test_each_frame_meets_the_one_before(spark):
    rows = [frame(v, n, (n * (3 if v == "a" else 5)) % 250) for v in ("a", "b") for n in range(100) if n % 17 != 5]
    rows += [frame("c", 0, 1), frame("c", 1, None), frame("c", 2, 9), ("c", 3, 8, 8, bytearray(b"short")), frame("c", 4, 7, 4, 4), ("c", 5, None, 8, bytearray(b"x")), frame("d", 3, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    level = {(r[0], r[1]): r[4][0] for r in rows if r[4] and r[2]}
    for stretch in (1, 7, 32):
        for step in (1, 3):
            got = {(r.video, r.frame_idx): r["diff"] for r in pairs.previous(df.repartition(6), pairs.metrics("diff"), step, stretch).collect()}
            want = {(v, n): abs(level[v, n] - level[v, n - step]) for v, n in level if v in "ab" and (v, n - step) in level}
            assert got == want
    assert pairs.previous(df.where("false"), pairs.metrics("diff")).count() == 0
    plan = pairs.previous(df, pairs.metrics("ssim"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_two_streams_and_cuts(spark):
    a = spark.createDataFrame([frame("v", n, 10 * n) for n in range(4)] + [frame("w", 0, 5, 4, 4)], SCHEMA)
    b = spark.createDataFrame([frame("v", n, 10 * n + n) for n in range(1, 6)] + [frame("w", 0, 5)], SCHEMA)
    got = {(r.video, r.frame_idx): r["diff"] for r in pairs.matched(a, b, pairs.metrics("diff")).collect()}
    assert got == {("v", n): float(n) for n in (1, 2, 3)}
    tiles = pairs.matched(a, b, pairs.motion(4)).where("frame_idx = 3").collect()
    assert len(tiles) == 4 and all(t.score == pytest.approx(3) for t in tiles)
    films = spark.createDataFrame([frame(v, n, level) for v, levels in {"a": (10, 10), "b": (200, 20)}.items() for n, level in enumerate(levels)], SCHEMA)
    for algorithm, least in (("mad", 179.9), ("histogram", 0.9), ("ssim", 40.0)):
        rows = pairs.scene_cuts(films, algorithm).collect()
        assert [(r.video, r.frame_idx) for r in rows] == [("b", 1)] and rows[0]["diff"] > least
    assert pairs.edge_energy(films).agg(F.max("energy")).first()[0] == 0
    with pytest.raises(ValueError):
        pairs.metrics("vmaff")
