"""Points and rectangles of a page and of its picture on a screen."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G


def _sizes(box: Column, rotation: Column) -> tuple[Column, Column, Column, Column]:
    """The page's width and height, and those of its picture before scaling."""
    w, h = box["maxX"] - box["minX"], box["maxY"] - box["minY"]
    turned = rotation.isin(90, 270)
    return w, h, F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)


def to_screen(x: Column, y: Column, box: Column, rotation: Column, px_w: Column, px_h: Column) -> tuple[Column, Column]:
    """Where a page's point (y upwards) lies in its picture of px_w by px_h (y downwards); (0, 0) for a page without area."""
    w, h, out_w, out_h = _sizes(box, rotation)
    left, down = x - box["minX"], box["maxY"] - y
    rx = F.when(rotation == 0, left).when(rotation == 90, h - down).when(rotation == 180, w - left).otherwise(down)
    ry = F.when(rotation == 0, down).when(rotation == 90, left).when(rotation == 180, h - down).otherwise(w - left)
    real = (w > 0) & (h > 0)
    return F.when(real, rx * px_w / out_w).otherwise(0.0), F.when(real, ry * px_h / out_h).otherwise(0.0)


def to_page(x: Column, y: Column, box: Column, rotation: Column, px_w: Column, px_h: Column) -> tuple[Column, Column]:
    """The page's point at a place of its picture; the page's corner for one without area."""
    w, h, out_w, out_h = _sizes(box, rotation)
    rx, ry = F.when(px_w > 0, x * out_w / px_w).otherwise(0.0), F.when(px_h > 0, y * out_h / px_h).otherwise(0.0)
    left = F.when(rotation == 0, rx).when(rotation == 90, ry).when(rotation == 180, w - rx).otherwise(w - ry)
    down = F.when(rotation == 0, ry).when(rotation == 90, h - rx).when(rotation == 180, h - ry).otherwise(rx)
    real = (w > 0) & (h > 0)
    return F.when(real, left + box["minX"]).otherwise(box["minX"]), F.when(real, box["maxY"] - down).otherwise(box["minY"])


def rect_through(move, a: Column, *page: Column) -> Column:
    """The rectangle around a's corners, moved by to_screen or to_page."""
    return G.around([move(a[x], a[y], *page) for x in ("minX", "maxX") for y in ("minY", "maxY")])


def turned_bounds(cx: Column, cy: Column, width: Column, height: Column, angle: Column) -> Column:
    """The rectangle around one turned about its centre."""
    rx = (F.abs(width * F.cos(angle)) + F.abs(height * F.sin(angle))) / 2
    ry = (F.abs(width * F.sin(angle)) + F.abs(height * F.cos(angle))) / 2
    return G.rect(cx - rx, cy - ry, cx + rx, cy + ry)
