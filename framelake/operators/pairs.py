"""Quality, differences and motion of pairs of frames, a frame being one row of bytes.

Frames are rows (video, frame_idx, width, height, rgb). `previous` pairs each with the one before in its video: frames are
dealt out in stretches of STRETCH, the frame before a stretch goes along, and a task walks its stretches in order holding
two frames. So each frame is shuffled once, and no pixel is a row. `matched` pairs two streams by an equi-join.

What is computed of a pair is a `Work`: `metrics`, `tile_map`, `motion`, `regions`. Pairs whose sizes differ, or whose bytes
are missing or too few, give no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pictures as pic

#: Frames of a video that one task walks through.
STRETCH = 32
COLUMNS = ["video", "frame_idx", "width", "height", "rgb"]


@dataclass
class Work:
    """Columns that follow video and frame_idx, and what gives them: (reference, current, extra) to a list of arrays."""

    columns: str
    run: Callable[[np.ndarray, np.ndarray, object], list]

    def batch(self, head: list, reference: bytes, current: bytes, width: int, height: int, extra=None) -> pa.RecordBatch | None:
        need = (width or 0) * (height or 0) * 3
        if not need or reference is None or current is None or min(len(reference), len(current)) < need:
            return None
        found = self.run(pic.picture(reference, width, height), pic.picture(current, width, height), extra)
        same = np.zeros(len(found[0]), np.int64)
        names = [c.split()[0] for c in self.columns.split(", ")]
        return pa.RecordBatch.from_arrays([*(h.take(pa.array(same)) for h in head), *map(pa.array, found)], ["video", "frame_idx", *names])


def kinds(frames: DataFrame) -> str:
    return ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in ("video", "frame_idx"))


def previous(frames: DataFrame, work: Work, step: int = 1, stretch: int = STRETCH) -> DataFrame:
    """Each frame against the one `step` before it in its video; numbers may have gaps, then there is no pair."""
    at = lambda n: F.floor((F.col("frame_idx") + n) / stretch).cast("long")
    dealt = frames.select(*COLUMNS, F.explode(F.array_distinct(F.array(at(0), at(step)))).alias("stretch"))
    ordered = dealt.repartition("video", "stretch").sortWithinPartitions("video", "stretch", "frame_idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        group = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                video, number, width, height, rgb, stretch_ = (row.column(k)[0].as_py() for k in range(6))
                if group != (video, stretch_):
                    group, held = (video, stretch_), {}
                before = held.get(number - step)
                # the frame before a stretch is there for its successor only
                if before and number // stretch == stretch_ and before[:2] == (width, height):
                    done = work.batch([row.column(0), row.column(1)], before[2], rgb, width, height)
                    if done is not None:
                        yield done
                held = {n: v for n, v in held.items() if n > number - step} | {number: (width, height, rgb)}

    return ordered.mapInArrow(run, f"{kinds(frames)}, {work.columns}")


def matched(reference: DataFrame, current: DataFrame, work: Work, extra: Column | None = None) -> DataFrame:
    """Frames of `current` against those of the same video and number of `reference`, where their sizes are equal. `extra` is a
    column of `current` that the work gets.
    """
    theirs = reference.select("video", "frame_idx", F.col("width").alias("w"), F.col("height").alias("h"), F.col("rgb").alias("reference"))
    both = current.select(*COLUMNS, (F.lit(None) if extra is None else extra).alias("extra")).join(theirs, ["video", "frame_idx"]).where("width = w and height = h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a pair at a time: they are large
                row = batch.slice(i, 1)
                width, height, rgb, ref, more = (row.column(k)[0].as_py() for k in range(2, 7))
                done = work.batch([row.column(0), row.column(1)], ref, rgb, width, height, more)
                if done is not None:
                    yield done

    return both.select("video", "frame_idx", "width", "height", "rgb", "reference", "extra").mapInArrow(run, f"{kinds(current)}, {work.columns}")


def whole_block_ssim(a: np.ndarray, b: np.ndarray, cell: int = 8) -> float:
    """Mean SSIM of tiles that are complete; 1 without any."""
    found = [pic.one_window(x, y)[0] for _, _, (x, y) in pic.tiles(cell, a, b) if x.shape[-2:] == (cell, cell)]
    return float(np.concatenate(found).mean()) if found else 1.0


def squares(a: np.ndarray, b: np.ndarray) -> float:
    d = a.astype(np.int64) - b
    return float((d * d).mean())


#: Figures of a pair, from RGB (reference, current) or from stacks of one luma picture.
OF_RGB: dict[str, Callable] = {"mse": squares, "psnr": lambda a, b: float(pic.decibels(np.array(squares(a, b)))), "diff": lambda a, b: float(np.abs(a.astype(np.int64) - b).mean())}
OF_LUMA: dict[str, Callable] = {
    "ssim": pic.ssim, "ms_psnr": pic.ms_psnr, "ms_ssim": pic.ms_ssim, "vmaf": pic.vmaf_proxy, "delta_mean": lambda a, b: pic.mean(a - b), "delta_var": lambda a, b: pic.mean((a - b - pic.mean(a - b)[:, None, None]) ** 2),
    "histogram_correlation": lambda a, b: [pic.histogram_correlation(a, b)], "block_ssim": lambda a, b: [whole_block_ssim(a[0], b[0])],
}


def metrics(*names: str) -> Work:
    """A row a pair with these of: mse, psnr, diff (mean absolute difference) over RGB; ssim, ms_psnr, ms_ssim, vmaf, delta_mean and
    delta_var (of reference less current), histogram_correlation and block_ssim over luma.
    """
    if unknown := set(names) - set(OF_RGB) - set(OF_LUMA):
        raise ValueError(f"unknown metrics {sorted(unknown)}")

    def run(reference: np.ndarray, current: np.ndarray, _: object) -> list:
        a, b = (pic.luma(x)[None] for x in (reference, current)) if set(names) & set(OF_LUMA) else (None, None)
        return [[OF_RGB[n](reference, current)] if n in OF_RGB else [float(OF_LUMA[n](a, b)[0])] for n in names]

    return Work(", ".join(f"{n} double" for n in names), run)


#: Metrics of tiles, from stacks of luma tiles (reference, current).
OF_TILES: dict[str, Callable] = {"signed": pic.signed_difference, "psnr": pic.tile_psnr, "ms_psnr": pic.ms_psnr, "ms_ssim": pic.ms_ssim, "vmaf": pic.vmaf_proxy, "ssim": lambda a, b: pic.one_window(a, b)[0]}


def tile_map(*names: str, size: int = 64, channel: str = "luma") -> Work:
    """A row a tile, cut ones at the edges included: bx, by and these of signed (mean of current less reference), psnr (at most
    99), ms_psnr, ms_ssim, vmaf and ssim (one window). Size 0 is 64. Over luma or r, g or b.
    """
    if unknown := set(names) - set(OF_TILES):
        raise ValueError(f"unknown tile metrics {sorted(unknown)}")
    value = pic.luma if channel == "luma" else lambda x: x[..., "rgb".index(channel)].astype(np.float64)

    def run(reference: np.ndarray, current: np.ndarray, _: object) -> list:
        parts = [[bx, by, *(OF_TILES[n](a, b) for n in names)] for bx, by, (a, b) in pic.tiles(size or 64, value(reference), value(current))]
        return [np.concatenate(c) for c in zip(*parts, strict=True)]

    return Work(", ".join(["bx long", "by long", *(f"{n} double" for n in names)]), run)


def motion(cell: int = 8) -> Work:
    """A row a tile: the mean absolute difference of luma."""

    def run(reference: np.ndarray, current: np.ndarray, _: object) -> list:
        far = np.abs(pic.luma(current) - pic.luma(reference))
        parts = [(bx, by, pic.mean(t)) for bx, by, (t,) in pic.tiles(max(1, cell), far)]
        return [np.concatenate(c) for c in zip(*parts, strict=True)]

    return Work("bx long, by long, score double", run)


def regions() -> Work:
    """A row for each rectangle of the extra column, an array of (k, x, y, w, h): k, psnr and ssim of its luma, from summed-area
    tables. Rectangles are cut at the picture's edges; those outside it give no row.
    """

    def run(reference: np.ndarray, current: np.ndarray, wanted: object) -> list:
        a, b = pic.luma(reference), pic.luma(current)
        height, width = a.shape
        k, x, y, w, h = np.array([(r["k"], r["x"], r["y"], r["w"], r["h"]) for r in wanted or ()], np.int64).reshape(-1, 5).T
        x1, y1 = np.clip(x + w, 0, width), np.clip(y + h, 0, height)
        x, y = np.clip(x, 0, width), np.clip(y, 0, height)
        some = (x1 > x) & (y1 > y)
        k, x, y, w, h = k[some], x[some], y[some], (x1 - x)[some], (y1 - y)[some]
        level = (a.mean() + b.mean()) / 2
        u, v = a - level, b - level
        of = lambda p: pic.rectangles(pic.table(p), x, y, w, h) / (w * h)
        ma, mb = of(u), of(v)
        ssim, _ = pic.terms(ma + level, mb + level, np.maximum(0, of(u * u) - ma * ma), np.maximum(0, of(v * v) - mb * mb), of(u * v) - ma * mb)
        mse = of((a - b) ** 2)
        return [k, pic.decibels(np.where(np.abs(mse) < 1e-9, 0, mse)), ssim]

    return Work("k long, psnr double, ssim double", run)


def each(frames: DataFrame, columns: str, run: Callable[[np.ndarray], list]) -> DataFrame:
    """What `run` makes of each frame's luma, without a shuffle."""
    work = Work(columns, lambda a, b, _: run(pic.luma(b)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                width, height, rgb = (row.column(k)[0].as_py() for k in (2, 3, 4))
                done = work.batch([row.column(0), row.column(1)], rgb, rgb, width, height)
                if done is not None:
                    yield done

    return frames.select(*COLUMNS).mapInArrow(walk, f"{kinds(frames)}, {columns}")


def orientation(frames: DataFrame, cell: int = 8, bins: int = 16) -> DataFrame:
    """Dominant edge direction and purity of each tile; flat tiles have 0 and 0."""
    return each(frames, "bx long, by long, angle double, purity double", lambda v: list(pic.orientation(v, max(1, cell), bins)))


def edge_energy(frames: DataFrame) -> DataFrame:
    return each(frames, "energy double", lambda v: [pic.edge_energy(v[None])])


#: Differences above these are cuts.
CUTS = {"mad": 45.0, "histogram": 0.3, "ssim": 40.0}


def scene_differences(frames: DataFrame, algorithm: str = "mad") -> DataFrame:
    """How far each frame is from the one before in its video: mean absolute difference of samples, 1 - histogram correlation, or
    100 - 100 times the mean SSIM of tiles.
    """
    name = {"mad": "diff", "histogram": "histogram_correlation", "ssim": "block_ssim"}[algorithm]
    found = previous(frames, metrics(name))
    value = {"mad": F.col(name), "histogram": 1 - F.col(name), "ssim": (1 - F.col(name)) * 100}[algorithm]
    return found.select("video", "frame_idx", value.alias("diff"))


def scene_cuts(frames: DataFrame, algorithm: str = "mad", threshold: float | None = None) -> DataFrame:
    return scene_differences(frames, algorithm).where(F.col("diff") > (CUTS[algorithm] if threshold is None else threshold))
