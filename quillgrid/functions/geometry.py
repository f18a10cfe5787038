"""Column builders over rectangles: structs of minX, minY, maxX, maxY."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("minX"), y0.cast("double").alias("minY"), x1.cast("double").alias("maxX"), y1.cast("double").alias("maxY"))


def union(a: Column, b: Column) -> Column:
    return rect(F.least(a["minX"], b["minX"]), F.least(a["minY"], b["minY"]), F.greatest(a["maxX"], b["maxX"]), F.greatest(a["maxY"], b["maxY"]))


def area(a: Column) -> Column:
    return F.greatest(F.lit(0.0), a["maxX"] - a["minX"]) * F.greatest(F.lit(0.0), a["maxY"] - a["minY"])


def overlaps(a: Column, b: Column) -> Column:
    """Strict: touching edges don't overlap."""
    return (a["minX"] < b["maxX"]) & (b["minX"] < a["maxX"]) & (a["minY"] < b["maxY"]) & (b["minY"] < a["maxY"])


def intersection(a: Column, b: Column) -> Column:
    """Null where empty."""
    both = rect(F.greatest(a["minX"], b["minX"]), F.greatest(a["minY"], b["minY"]), F.least(a["maxX"], b["maxX"]), F.least(a["maxY"], b["maxY"]))
    return F.when(overlaps(a, b), both)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; 0 where that is none."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, F.coalesce(area(intersection(a, b)), F.lit(0.0)) / least).otherwise(0.0)


def gap_distance(a: Column, b: Column) -> Column:
    """Between edges; 0 for rectangles that touch or overlap."""
    zero = F.lit(0.0)
    return F.hypot(F.greatest(zero, a["minX"] - b["maxX"], b["minX"] - a["maxX"]), F.greatest(zero, a["minY"] - b["maxY"], b["minY"] - a["maxY"]))


def shrink_to_center(a: Column) -> Column:
    """Half the area around the same center."""
    k = (1 - 0.5**0.5) / 2
    w, h = (a["maxX"] - a["minX"]) * k, (a["maxY"] - a["minY"]) * k
    return rect(a["minX"] + w, a["minY"] + h, a["maxX"] - w, a["maxY"] - h)


def multiply(a: list[Column], b: list[Column]) -> list[Column]:
    """Product of two 6-number matrices."""
    return [a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3], a[1] * b[2] + a[3] * b[3], a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5]]


def hue_distance(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360 - d)


def around(points: list[tuple[Column, Column]]) -> Column:
    """The rectangle around some points; null where a coordinate is."""
    xs, ys = [x for x, _ in points], [y for _, y in points]
    known = xs[0].isNotNull()
    for v in [*xs[1:], *ys]:
        known = known & v.isNotNull()
    return F.when(known, rect(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)))


def parallelogram(x: Column, y: Column, hx: Column, hy: Column, vx: Column, vy: Column) -> Column:
    """The rectangle around a corner and two sides; null where a number is."""
    low = lambda a, b: F.least(F.lit(0.0), a) + F.least(F.lit(0.0), b)
    high = lambda a, b: F.greatest(F.lit(0.0), a) + F.greatest(F.lit(0.0), b)
    return F.when((x + y + hx + hy + vx + vy).isNotNull(), rect(x + low(hx, vx), y + low(hy, vy), x + high(hx, vx), y + high(hy, vy)))


def unit_square_box(m: list[Column]) -> Column:
    """Where the matrix m puts the unit square."""
    return parallelogram(m[4], m[5], m[0], m[1], m[2], m[3])


def _axes(m: list[Column]) -> tuple[Column, Column, Column, Column]:
    """Unit vectors along and across; a vector of no length stays as it is."""
    along, across = (F.coalesce(F.nullif(F.hypot(x, y), F.lit(0.0)), F.lit(1.0)) for x, y in ((m[0], m[1]), (m[2], m[3])))
    return m[0] / along, m[1] / along, m[2] / across, m[3] / across


def run_box(m: list[Column], width: Column, height: Column) -> Column:
    """The rectangle around a run of text whose width and height are final: the matrix gives its place and directions only."""
    ux, uy, vx, vy = _axes(m)
    return parallelogram(m[4], m[5], ux * width, uy * width, vx * height, vy * height)


def item_box(m: list[Column], width: Column, height: Column) -> Column:
    """As run_box, but a quarter of the height lies below the baseline; null for a run without size or direction."""
    ux, uy, vx, vy = _axes(m)
    down = height * K.ITEM_DESCENT
    box = parallelogram(m[4] - vx * down, m[5] - vy * down, ux * width, uy * width, vx * height, vy * height)
    return F.when((width > 0) & (height > 0) & (F.hypot(m[0], m[1]) > 0) & (F.hypot(m[2], m[3]) > 0), box)


def relative_area(a: Column, page: Column) -> Column:
    """Share of the page's area, above 1 for what is larger; 0 for a page without area."""
    return F.when(area(page) > 0, area(a) / area(page)).otherwise(0.0)


def inscribed_scale(width: Column, height: Column, angle: Column) -> Column:
    """The largest scale, 1 at most, at which the rectangle turned by `angle` (radians) about its centre fits into itself.

    Each corner of the turned one must stay inside: half the width and height bound what the corners' projections need.
    """
    turned = F.pmod(angle, F.lit(math.pi))
    turned = F.when(turned > math.pi / 2, math.pi - turned).otherwise(turned)
    a, b, cos, sin = width / 2, height / 2, F.cos(turned), F.sin(turned)
    needs = [(a, a * cos + b * sin), (b, F.abs(b * cos - a * sin)), (a, F.abs(a * cos - b * sin)), (b, a * sin + b * cos)]
    return F.when((width <= 0) | (height <= 0), 1.0).otherwise(F.least(F.lit(1.0), *[F.when(need != 0, have / need) for have, need in needs]))


def angle_of(m: list[Column]) -> Column:
    """Direction of the text in degrees, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(m[1], m[0])), F.lit(360.0))


def stream_angle(m: list[Column]) -> Column:
    """The nearest of 0, 90, 180 and 270."""
    return F.pmod(F.floor(angle_of(m) / 90 + 0.5) * 90, F.lit(360)).cast("int")


def off_axis(m: list[Column]) -> Column:
    """Degrees between the direction and its stream's."""
    d = F.abs(angle_of(m) - stream_angle(m))
    return F.least(d, 360 - d)


def along_cross(m: list[Column]) -> tuple[Column, Column]:
    """Position in reading direction and across it."""
    angle = stream_angle(m)
    along = F.when(angle == 0, m[4]).when(angle == 180, -m[4]).when(angle == 90, m[5]).otherwise(-m[5])
    return along, F.when(angle.isin(0, 180), m[5]).otherwise(m[4])


def font_size(m: list[Column]) -> Column:
    return F.coalesce(F.nullif(F.hypot(m[0], m[1]), F.lit(0.0)), F.lit(1.0))


def placement(m: list[Column]) -> Column:
    """flip_x, flip_y, rotated, quarter_turns (clockwise, to be upright; null: none) of a picture painted with m."""
    a, b, c, d = m[:4]
    slack = 0.01 * F.greatest(F.abs(a), F.abs(d))
    straight = (F.abs(b) <= slack) & (F.abs(c) <= slack)
    mirrored = a * d - b * c <= 0
    angle = F.degrees(F.atan2(b, a))
    quarters = F.floor(angle / 90 + 0.5).cast("int")
    turned = ~straight & ~mirrored & (quarters != 0) & (F.abs(angle - quarters * 90) <= K.QUARTER_TURN_TOLERANCE)
    return F.struct(
        F.when(straight, a < 0).otherwise(mirrored & (F.abs(angle) >= 180 - K.MIRRORED_TILT_MAX)).alias("flip_x"),
        F.when(straight, d < 0).otherwise(mirrored & (F.abs(angle) <= K.MIRRORED_TILT_MAX)).alias("flip_y"),
        (~straight).alias("rotated"),
        F.when(turned, F.pmod(-quarters, F.lit(4))).alias("quarter_turns"),
    )


def inside_polygon(x: Column, y: Column, points: Column) -> Column:
    """Even-odd rule; points: array of structs x, y, closed by itself. Fewer than three points: outside."""
    n = F.size(points)
    crossed = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda k, i: k + F.transform(F.array(F.struct(F.element_at(points, i).alias("p"), F.element_at(points, F.when(i == 1, n).otherwise(i - 1)).alias("q"))), lambda e: _crosses(x, y, e["p"], e["q"]).cast("int"))[0],
    )
    return F.when(n < 3, False).otherwise(crossed % 2 == 1)


def _crosses(x: Column, y: Column, p: Column, q: Column) -> Column:
    """Whether the edge from q to p crosses the ray from (x, y) to the right."""
    spans = (p["y"] > y) != (q["y"] > y)
    return F.coalesce(spans & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]), F.lit(False))


def center_inside(a: Column, region: Column) -> Column:
    """Whether a's centre lies in the region, its edges included."""
    x, y = (a["minX"] + a["maxX"]) / 2, (a["minY"] + a["maxY"]) / 2
    return (x >= region["minX"]) & (x <= region["maxX"]) & (y >= region["minY"]) & (y <= region["maxY"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where there is none."""
    common = F.coalesce(area(intersection(a, b)), F.lit(0.0))
    whole = area(a) + area(b) - common
    return F.when(whole > 0, common / whole).otherwise(0.0)
