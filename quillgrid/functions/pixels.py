"""Measures and transforms of pictures: columns width, height and rgba (four bytes a pixel, rows from the top), in Arrow batches."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VISIBLE = 16
WHITE, DARK = 240, 40
LOOK = "spread double, visible_spread double, visible_mean double, white_share double, dark_share double, opaque_share double"


def _pixels(width: int, height: int, rgba: bytes) -> np.ndarray:
    return np.frombuffer(rgba, np.uint8).reshape(height, width, 4)


def look(width: Column, height: Column, rgba: Column, white: int = WHITE, dark: int = DARK) -> Column:
    """Struct LOOK: spread (standard deviation) of the luminance of all pixels and of the visible ones, their mean, and the shares of these that are white
    and dark in every channel; opaque_share: of all pixels, those seen. A picture without (visible) pixels: zeros."""

    def one(w: int, h: int, data: bytes) -> tuple:
        p = _pixels(w, h, data).reshape(-1, 4).astype(np.float64)
        if not len(p):
            return (0.0,) * 6
        lum = p[:, :3] @ (0.3, 0.59, 0.11)
        seen = p[:, 3] > VISIBLE
        if not seen.any():
            return (float(lum.std()), 0.0, 0.0, 0.0, 0.0, 0.0)
        rgb = p[seen, :3]
        return (float(lum.std()), float(lum[seen].std()), float(lum[seen].mean()), float((rgb >= white).all(1).mean()), float((rgb <= dark).all(1).mean()), float(seen.mean()))

    def work(w: pd.Series, h: pd.Series, d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*x) for x in zip(w, h, d, strict=True)], columns=[c.split()[0] for c in LOOK.split(", ")])

    return F.pandas_udf(work, LOOK)(width, height, rgba)


def fingerprint(width: Column, height: Column, rgba: Column, grid: int = 8, samples: int = 4) -> Column:
    """Mean luminance over white of grid by grid cells, each by samples by samples pixels; null for a picture without pixels."""

    def places(n: int) -> np.ndarray:
        at = (np.arange(grid)[:, None] + (np.arange(samples) + 0.5) / samples) * n / grid
        return np.minimum(n - 1, np.floor(at).astype(int)).ravel()

    def one(w: int, h: int, data: bytes) -> list[int] | None:
        if w <= 0 or h <= 0:
            return None
        p = _pixels(w, h, data)[places(h)][:, places(w)].astype(np.float64)
        lum = (p[..., :3] @ (0.299, 0.587, 0.114) * p[..., 3] + 255 * (255 - p[..., 3])) / 255
        cells = lum.reshape(grid, samples, grid, samples).mean((1, 3))
        return np.floor(cells + 0.5).astype(int).ravel().tolist()

    return F.pandas_udf(lambda w, h, d: pd.Series([one(*x) for x in zip(w, h, d, strict=True)]), "array<int>")(width, height, rgba)


def visible_box(width: Column, height: Column, rgba: Column, alpha: int = 128) -> Column:
    """struct(x0, y0, x1, y1): the smallest rectangle, ends excluded, of all pixels of at least this alpha; null if none."""

    def one(w: int, h: int, data: bytes) -> tuple | None:
        on = _pixels(w, h, data)[..., 3] >= alpha
        if not on.any():
            return (None,) * 4
        ys, xs = np.flatnonzero(on.any(1)), np.flatnonzero(on.any(0))
        return int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1

    def work(w: pd.Series, h: pd.Series, d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*x) for x in zip(w, h, d, strict=True)], columns=["x0", "y0", "x1", "y1"]).astype("Int32")

    return F.pandas_udf(work, "x0 int, y0 int, x1 int, y1 int")(width, height, rgba)


def quarter_turns(width: Column, height: Column, rgba: Column, turns: Column) -> Column:
    """The picture turned clockwise by so many quarter turns."""

    def change(p: np.ndarray, n: int) -> np.ndarray:
        return np.rot90(p, -int(n))

    return _typed(change, width, height, rgba, turns)


def mirror(width: Column, height: Column, rgba: Column, x: Column, y: Column) -> Column:
    """The picture with left and right, or top and bottom, exchanged."""

    def change(p: np.ndarray, flip_x: bool, flip_y: bool) -> np.ndarray:
        return p[:: -1 if flip_y else 1, :: -1 if flip_x else 1]

    return _typed(change, width, height, rgba, x, y)


def crop(width: Column, height: Column, rgba: Column, box: Column) -> Column:
    """The part of the picture in box (x0, y0, x1, y1); all of it for null."""

    def change(p: np.ndarray, x0, y0, x1, y1) -> np.ndarray:
        return p if pd.isna(x0) else p[int(y0) : int(y1), int(x0) : int(x1)]

    return _typed(change, width, height, rgba, *(box[c] for c in ("x0", "y0", "x1", "y1")))


def flatten_on_white(width: Column, height: Column, rgba: Column) -> Column:
    """The picture painted on white: no pixel is translucent."""

    def change(p: np.ndarray) -> np.ndarray:
        a = p[..., 3:].astype(np.float64) / 255
        out = np.full_like(p, 255)
        out[..., :3] = np.floor(p[..., :3] * a + 255 * (1 - a) + 0.5)
        return out

    return _typed(change, width, height, rgba)


def _typed(change, width: Column, height: Column, rgba: Column, *more: Column) -> Column:
    """A transform as a pandas UDF; its further arguments go in one struct."""

    def work(w: pd.Series, h: pd.Series, d: pd.Series, extra: pd.DataFrame) -> pd.DataFrame:
        return _rows(change, (w, h, d, *(extra[c] for c in extra.columns[1:])))

    extra = F.struct(F.lit(0).alias("none"), *[c.alias(f"c{k}") for k, c in enumerate(more)])
    return F.pandas_udf(work, "width int, height int, rgba binary")(width, height, rgba, extra)


def _rows(change, series) -> pd.DataFrame:
    rows = []
    for w, h, d, *more in zip(*series, strict=True):
        p = change(_pixels(w, h, d), *more)
        rows.append((p.shape[1], p.shape[0], np.ascontiguousarray(p).tobytes()))
    return pd.DataFrame(rows, columns=["width", "height", "rgba"])
