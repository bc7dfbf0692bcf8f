"""Kernels on pairs of pictures, for stacks of pictures of one size (n, height, width) at a time: a frame is a stack of one,
the tiles of a frame are a stack. Windows are read from summed-area tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

C1, C2 = 6.5025, 58.5225
#: Weights of the scales, finest first: fixed values.
PSNR_WEIGHTS = (0.4, 0.3, 0.2, 0.1)
SSIM_WEIGHTS = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)
#: Side of the sliding window, and the size up to which a picture is one window.
WINDOW, SMALL = 11, 4096


def picture(rgb: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(rgb, np.uint8, width * height * 3).reshape(height, width, 3)


def luma(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., k].astype(np.float64) for k in range(3))
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def decibels(mse: np.ndarray, least: float = 0.0) -> np.ndarray:
    """PSNR; what is no more than `least` apart is infinitely good."""
    with np.errstate(divide="ignore"):
        return np.where(mse <= least, np.inf, 10 * np.log10(65025.0 / np.where(mse > least, mse, 1)))


def mean(x: np.ndarray) -> np.ndarray:
    return x.mean(axis=(-2, -1))


def table(x: np.ndarray) -> np.ndarray:
    """Sums over all rectangles from the first corner; a row and a column of zeros come first."""
    return np.pad(x, [(0, 0)] * (x.ndim - 2) + [(1, 0), (1, 0)]).cumsum(axis=-2).cumsum(axis=-1)


def rectangles(sums: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums over rectangles, by four look-ups each."""
    return sums[..., y + h, x + w] - sums[..., y, x + w] - sums[..., y + h, x] + sums[..., y, x]


def boxes(x: np.ndarray, size: int) -> np.ndarray:
    """Means over all windows of a size inside a picture."""
    s = table(x)
    return (s[..., size:, size:] - s[..., :-size, size:] - s[..., size:, :-size] + s[..., :-size, :-size]) / (size * size)


def terms(ma, mb, va, vb, cov) -> tuple[np.ndarray, np.ndarray]:
    """SSIM and its contrast term."""
    cs = (2 * cov + C2) / (va + vb + C2)
    return (2 * ma * mb + C1) / (ma * ma + mb * mb + C1) * cs, cs


def one_window(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ma, mb = mean(a), mean(b)
    da, db = a - ma[..., None, None], b - mb[..., None, None]
    return terms(ma, mb, mean(da * da), mean(db * db), mean(da * db))


def all_windows(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of SSIM and contrast over windows."""
    # shifted to around zero, so that differences of large sums keep their digits
    level = (mean(a) + mean(b)) / 2
    x, y = a - level[..., None, None], b - level[..., None, None]
    mx, my = boxes(x, WINDOW), boxes(y, WINDOW)
    ssim, cs = terms(mx + level[..., None, None], my + level[..., None, None], boxes(x * x, WINDOW) - mx * mx, boxes(y * y, WINDOW) - my * my, boxes(x * y, WINDOW) - mx * my)
    return mean(ssim), mean(cs)


def ssim(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean SSIM over windows; pictures that hold none are one window."""
    return (one_window if min(a.shape[-2:]) < WINDOW else all_windows)(a, b)[0]


def components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SSIM and contrast of a scale, from -1 to 1; small pictures are one window."""
    h, w = a.shape[-2:]
    found = one_window(a, b) if min(h, w) < WINDOW or h * w <= SMALL else all_windows(a, b)
    return tuple(np.clip(v, -1, 1) for v in found)


def halved(x: np.ndarray) -> np.ndarray:
    """Means of 2 x 2 samples; an odd last row or column is left out."""
    h, w = (n // 2 * 2 for n in x.shape[-2:])
    return (x[..., 0:h:2, 0:w:2] + x[..., 0:h:2, 1:w:2] + x[..., 1:h:2, 0:w:2] + x[..., 1:h:2, 1:w:2]) / 4


def scales(a: np.ndarray, b: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for k in range(most):
        yield a, b
        if min(a.shape[-2:]) < 2 or k + 1 == most:
            return
        a, b = halved(a), halved(b)


def ms_psnr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted PSNR over halved scales, infinite ones as 100 dB, unless all are: then infinity."""
    db = np.array([decibels(mean((x - y) ** 2), np.finfo(np.float64).eps) for x, y in scales(a, b, len(PSNR_WEIGHTS))])
    weights = np.array(PSNR_WEIGHTS[: len(db)])[:, None]
    return np.where(np.isinf(db).all(axis=0), np.inf, (np.where(np.isinf(db), 100.0, db) * weights).sum(axis=0) / weights.sum())


def ms_ssim(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product over halved scales of the contrast terms, of SSIM at the last, to weights that sum to one; from 0 to 1."""
    found = [components(x, y) for x, y in scales(a, b, len(SSIM_WEIGHTS))]
    total, score = sum(SSIM_WEIGHTS[: len(found)]), 1.0
    for k, (whole, contrast) in enumerate(found):
        score = score * np.maximum(whole if k + 1 == len(found) else contrast, 0) ** (SSIM_WEIGHTS[k] / total)
    return np.clip(score, 0, 1)


def edge_energy(x: np.ndarray) -> np.ndarray:
    """Mean of |dx| + |dy| by forward differences, the last row and column left out."""
    if min(x.shape[-2:]) < 2:
        return np.zeros(x.shape[:-2])
    return mean(np.abs(x[..., :-1, 1:] - x[..., :-1, :-1]) + np.abs(x[..., 1:, :-1] - x[..., :-1, :-1]))


def vmaf_proxy(reference: np.ndarray, current: np.ndarray) -> np.ndarray:
    """A score of 0 to 100 from MS-SSIM and MS-PSNR, less for edges that the reference doesn't have."""
    good = np.clip((np.minimum(ms_psnr(reference, current), 1000) - 20) / 30, 0, 1)
    edges = edge_energy(reference)
    excess = np.maximum(0, (edge_energy(current) - edges) / np.maximum(edges, 1))
    return np.clip(100 * (0.72 * ms_ssim(reference, current) + 0.28 * good) - 20 * excess, 0, 100)


def signed_difference(reference: np.ndarray, current: np.ndarray) -> np.ndarray:
    return mean(current - reference)


def tile_psnr(reference: np.ndarray, current: np.ndarray, cap: float = 99.0) -> np.ndarray:
    return np.minimum(cap, decibels(mean((reference - current) ** 2)))


def tiles(size: int, *pictures: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """The tiles of pictures as stacks: columns, rows and, of each picture, the tiles. Whole tiles come together, then those
    that the right edge cuts, the lower, and both.
    """
    h, w = pictures[0].shape
    for y0, y1, th in ((0, h // size, size), (h // size, -(-h // size), h % size)):
        for x0, x1, tw in ((0, w // size, size), (w // size, -(-w // size), w % size)):
            if y1 > y0 and x1 > x0:
                by, bx = np.mgrid[y0:y1, x0:x1]
                cut = [p[y0 * size : y0 * size + (y1 - y0) * th, x0 * size : x0 * size + (x1 - x0) * tw] for p in pictures]
                yield bx.ravel(), by.ravel(), [p.reshape(y1 - y0, th, x1 - x0, tw).swapaxes(1, 2).reshape(-1, th, tw) for p in cut]


def orientation(v: np.ndarray, cell: int, bins: int = 16) -> tuple[np.ndarray, ...]:
    """bx, by, angle and purity of each tile: the heaviest bin of edge directions (0 to 180 degrees, weighted by Sobel
    magnitude; of equals the last) gives its mean angle and its share. Flat tiles have 0 and 0.
    """
    h, w = v.shape
    across, down = -(-w // cell), -(-h // cell)
    weight, angles = np.zeros(across * down * bins), np.zeros(across * down * bins)
    if min(h, w) > 2:
        gx = (v[:-2, 2:] - v[:-2, :-2]) + 2 * (v[1:-1, 2:] - v[1:-1, :-2]) + (v[2:, 2:] - v[2:, :-2])
        gy = (v[2:, :-2] - v[:-2, :-2]) + 2 * (v[2:, 1:-1] - v[:-2, 1:-1]) + (v[2:, 2:] - v[:-2, 2:])
        m = np.sqrt(gx * gx + gy * gy)
        y, x = np.nonzero(m >= 1)
        m, angle = m[y, x], (np.degrees(np.arctan2(gy[y, x], gx[y, x])) + 90) % 180
        slot = (((y + 1) // cell) * across + (x + 1) // cell) * bins + np.minimum(bins - 1, (angle / 180 * bins).astype(np.int64))
        weight, angles = np.bincount(slot, m, len(weight)), np.bincount(slot, m * angle, len(weight))
    weight, angles = weight.reshape(-1, bins), angles.reshape(-1, bins)
    top = bins - 1 - weight[:, ::-1].argmax(axis=1)
    at, total = np.arange(len(weight)), weight.sum(axis=1)
    some = total > 0
    safe = np.where(some, weight[at, top], 1)
    return at % across, at // across, np.where(some, angles[at, top] / safe, 0.0), np.where(some, weight[at, top] / np.where(some, total, 1), 0.0)


def histogram_correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Pearson correlation of the histograms of rounded luma; a constant one gives 1."""
    # half away from zero
    p, q = (np.bincount(np.floor(v.ravel() + 0.5).astype(np.int64), minlength=256)[:256].astype(np.float64) for v in (a, b))
    p, q = p - p.mean(), q - q.mean()
    size = np.sqrt((p * p).sum() * (q * q).sum())
    return float((p * q).sum() / size) if size else 1.0
