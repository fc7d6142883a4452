"""Metrics of pixel arrays with numpy, as Arrow-batched UDFs (no image library is needed).

Borders are mirrored without repeating the edge; area resizing averages the covered source pixels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def resize_area(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mean over the source area of each target pixel."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * (n / m)
        lo, hi = edge[:-1, None], edge[1:, None]
        cell = np.arange(n)[None, :]
        w = np.clip(np.minimum(hi, cell + 1) - np.maximum(lo, cell), 0, None)
        return w / w.sum(1, keepdims=True)

    out = np.tensordot(weights(a.shape[0], height), a.astype(np.float64), (1, 0))
    return np.moveaxis(np.tensordot(weights(a.shape[1], width), out, (1, 1)), 0, 1)


def to_gray(bgr: np.ndarray) -> np.ndarray:
    return bgr[..., 0] * 0.114 + bgr[..., 1] * 0.587 + bgr[..., 2] * 0.299


def _filtered(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    p = np.pad(a.astype(np.float64), 1, mode="reflect")
    h, w = a.shape
    return sum(kernel[i, j] * p[i : i + h, j : j + w] for i in range(3) for j in range(3))


_LAPLACE = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float)
_SCHARR = np.array([[-3, 0, 3], [-10, 0, 10], [-3, 0, 3]], float)


def sharpness(gray: np.ndarray) -> float:
    """Variance of the Laplacian; 0 if a side is below 3."""
    return 0.0 if min(gray.shape) < 3 else float(_filtered(gray, _LAPLACE).var())


def motion_blur(gray: np.ndarray) -> float:
    """How much the gradient energy lies in one direction, and how much detail is missing, within [0, 1]."""
    if min(gray.shape) < 8:
        return 0.0
    g = gray / 255.0
    gx, gy = _filtered(g, _SCHARR), _filtered(g, _SCHARR.T)
    ex, ey = np.abs(gx).mean(), np.abs(gy).mean()
    imbalance = abs(ex - ey) / (ex + ey + 1e-6)
    spread = np.sqrt(_filtered(g, _LAPLACE).var())
    detail = spread / (spread + np.sqrt(gx * gx + gy * gy).mean() + 1e-6)
    return float(np.clip(0.62 * imbalance + 0.38 * (1 - min(1.0, 3 * detail)), 0, 1))


def difference_hash(gray: np.ndarray) -> int:
    """64 bits of a 9 by 8 thumbnail, first bit highest, as a signed number."""
    small = np.rint(resize_area(gray, 9, 8))  # whole grey levels, so that rounding noise sets no bits
    bits = np.packbits((small[:, 1:] > small[:, :-1]).reshape(-1))
    return int(np.frombuffer(bits.tobytes(), ">i8")[0])


def hue_saturation_histogram(bgr: np.ndarray) -> np.ndarray:
    """16 by 8 bins of hue and saturation, scaled to length 1."""
    x = bgr.astype(np.float64)
    top, low = x.max(-1), x.min(-1)
    span = np.where(top > low, top - low, 1.0)
    b, g, r = x[..., 0], x[..., 1], x[..., 2]
    hue = np.where(top == r, (g - b) / span, np.where(top == g, 2 + (b - r) / span, 4 + (r - g) / span)) * 30 % 180
    hue = np.where(top > low, hue, 0.0)
    sat = np.where(top > 0, (top - low) / np.where(top > 0, top, 1) * 255, 0.0)
    h, _, _ = np.histogram2d(hue.ravel(), sat.ravel(), bins=(16, 8), range=((0, 180), (0, 256)))
    norm = np.sqrt((h * h).sum())
    return (h / norm if norm else h).ravel().astype(np.float32)


METRICS = ("sharpness", "motion_blur", "brightness", "hash", "histogram")
_TYPES = {"sharpness": "double", "motion_blur": "double", "brightness": "double", "hash": "bigint", "histogram": "array<float>"}


def frame_metrics(pixels: Column, width: Column, height: Column, analysis_width: int = 640, metrics: tuple[str, ...] = METRICS) -> Column:
    """A struct of the metrics asked for, and no others, of raw BGR bytes; null for null or cut-off pixels."""
    schema = ", ".join(f"{m} {_TYPES[m]}" for m in metrics)

    @F.pandas_udf(schema)
    def compute(raw: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        rows = []
        for data, cols, lines in zip(raw, w, h):
            if data is None or len(data) != int(cols) * int(lines) * 3:
                rows.append(dict.fromkeys(metrics))
                continue
            image = np.frombuffer(data, np.uint8).reshape(int(lines), int(cols), 3)
            if cols > analysis_width:
                image = resize_area(image, analysis_width, max(1, round(int(lines) * analysis_width / int(cols))))
            gray = to_gray(image)
            made = {
                "sharpness": lambda: sharpness(gray) * (640 / gray.shape[1]) ** 2,
                "motion_blur": lambda: motion_blur(gray),
                "brightness": lambda: float(gray.mean() / 255),
                "hash": lambda: difference_hash(gray),
                "histogram": lambda: hue_saturation_histogram(image).tolist(),
            }
            rows.append({m: made[m]() for m in metrics})
        return pd.DataFrame(rows, columns=list(metrics))

    return compute(pixels, width, height)
