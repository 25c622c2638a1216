"""Image preparation on raw pixels, as Arrow batches over a binary column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def prepare(pixels: np.ndarray, side: int = 224, angle: float = 20.0) -> np.ndarray:
    """Crop to side x side, flip upside down, rotate about the middle (nearest pixel), scale to 0..1."""
    a = pixels[:side, :side].astype(np.float32)[::-1]
    h, w = a.shape[:2]
    t = np.deg2rad(angle)
    y, x = np.mgrid[0:h, 0:w]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sy = np.rint(np.cos(t) * (y - cy) + np.sin(t) * (x - cx) + cy).astype(int)
    sx = np.rint(-np.sin(t) * (y - cy) + np.cos(t) * (x - cx) + cx).astype(int)
    inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
    out = np.zeros_like(a)
    out[inside] = a[sy[inside], sx[inside]]
    low, high = out.min(initial=0), out.max(initial=0)
    return (out - low) / (high - low) if high > low else np.zeros_like(out)


def prepare_images(df: DataFrame) -> DataFrame:
    """Rows (id, height, width, content) of 8-bit RGB pixels become (id, height, width, pixels array<float>)."""

    def run(batches):
        for b in batches:
            rows = []
            for i, h, w, c in zip(b["id"], b["height"], b["width"], b["content"], strict=True):
                p = prepare(np.frombuffer(c, np.uint8).reshape(h, w, 3))
                rows.append((i, p.shape[0], p.shape[1], p.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["id", "height", "width", "pixels"])

    return df.select("id", "height", "width", "content").mapInPandas(run, "id long, height int, width int, pixels array<float>")
