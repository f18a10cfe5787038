"""Queries over matrices, rectangles, fonts and pages' coordinates, from order lines."""

from pyspark.sql import functions as F

from ..functions import fonts, pages
from ..functions import geometry as G
from ..sources.tables import table
from .queries import query, rounded

M = "mx AS (SELECT l_orderkey, l_linenumber, l_quantity AS w, l_linenumber * 3.0 AS h, l_quantity - 25 AS a, l_discount * 200 - 10 AS b, l_tax * 250 - 10 AS c, l_linenumber * 8 - 28.0 AS d, l_partkey % 500 AS e, l_suppkey % 700 AS f FROM lineitem)"


def matrices(spark, sf_dir):
    """Order lines with a matrix m of six numbers, w and h."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    m = [q - 25, F.col("l_discount") * 200 - 10, F.col("l_tax") * 250 - 10, n * 8 - 28.0, (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") % 700).cast("double")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q.alias("w"), (n * 3.0).alias("h"), *[v.alias(c) for v, c in zip(m, "abcdef", strict=True)])


def matrix():
    return [F.col(c) for c in "abcdef"]


KEYS = ["l_orderkey", "l_linenumber"]


def flat(r, *names):
    return [F.round(r[c], 6).alias(n) for c, n in zip(("minX", "minY", "maxX", "maxY"), names or ("x0", "y0", "x1", "y1"), strict=True)]


@query(
    f"""WITH {M}, p AS (SELECT *, a * 2 + c * 0.5 AS p0, b * 2 + d * 0.5 AS p1, c - a * 0.5 AS p2, d - b * 0.5 AS p3, a * 3 + c * 4 + e AS p4, b * 3 + d * 4 + f AS p5 FROM mx)
SELECT l_orderkey, l_linenumber, round(p0, 6) AS p0, round(p3, 6) AS p3, round(least(p4, p4 + p0, p4 + p2, p4 + p0 + p2), 6) AS x0, round(least(p5, p5 + p1, p5 + p3, p5 + p1 + p3), 6) AS y0,
  round(greatest(p4, p4 + p0, p4 + p2, p4 + p0 + p2), 6) AS x1, round(greatest(p5, p5 + p1, p5 + p3, p5 + p1 + p3), 6) AS y1 FROM p"""
)
def matrix_boxes(spark, sf_dir):
    p = G.multiply(matrix(), [F.lit(float(v)) for v in (2, 0.5, -0.5, 1, 3, 4)])
    return matrices(spark, sf_dir).select(*KEYS, F.round(p[0], 6).alias("p0"), F.round(p[3], 6).alias("p3"), *flat(G.unit_square_box(p)))


def run_sql(low: str, high: str, where: str, prefix: str = "") -> str:
    xs = ", ".join(f"e + {s} * ux + {t} * vx" for s in ("0", "w") for t in (low, high))
    ys = ", ".join(f"f + {s} * uy + {t} * vy" for s in ("0", "w") for t in (low, high))
    return ", ".join(f"round(CASE WHEN {where} THEN {g}({v}) END, 6) AS {prefix}{n}" for g, v, n in (("least", xs, "x0"), ("least", ys, "y0"), ("greatest", xs, "x1"), ("greatest", ys, "y1")))


RUN = f"""{M}, n AS (SELECT *, sqrt(a * a + b * b) AS al, sqrt(c * c + d * d) AS cl FROM mx), u AS (SELECT *, a / coalesce(nullif(al, 0), 1) AS ux, b / coalesce(nullif(al, 0), 1) AS uy, c / coalesce(nullif(cl, 0), 1) AS vx, d / coalesce(nullif(cl, 0), 1) AS vy FROM n)"""


@query(f"WITH {RUN} SELECT l_orderkey, l_linenumber, {run_sql('0', 'h', 'true')}, {run_sql('(h * -0.25)', '(h * 0.75)', 'w > 0 AND h > 0 AND al > 0 AND cl > 0', 'i')} FROM u")
def run_boxes(spark, sf_dir):
    w, h = F.col("w"), F.col("h")
    return matrices(spark, sf_dir).select(*KEYS, *flat(G.run_box(matrix(), w, h)), *flat(G.item_box(matrix(), w, h), "ix0", "iy0", "ix1", "iy1"))


R = "rx AS (SELECT l_orderkey, l_linenumber, l_discount * 30 - 1.5 AS t, l_quantity * 10 - 11 AS x0, l_discount * 1000 - 2 AS y0, l_quantity * 10 - 11 + l_extendedprice / 200 AS x1, l_discount * 1000 - 2 + l_tax * 5000 AS y1 FROM lineitem)"


def rects(spark, sf_dir):
    x, y = F.col("l_quantity") * 10 - 11, F.col("l_discount") * 1000 - 2
    return table(spark, sf_dir, "lineitem").select(*KEYS, (F.col("l_discount") * 30 - 1.5).alias("t"), G.rect(x, y, x + F.col("l_extendedprice") / 200, y + F.col("l_tax") * 5000).alias("r"))


@query(
    f"""WITH {R}, s AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, [0 - x0, 0 - y0, x1 - 612, y1 - 792] AS over FROM rx),
k AS (SELECT *, CASE WHEN ((t % pi()) + pi()) % pi() > pi() / 2 THEN pi() - ((t % pi()) + pi()) % pi() ELSE ((t % pi()) + pi()) % pi() END AS g FROM s),
q AS (SELECT *, w / 2 AS aa, h / 2 AS bb, cos(g) AS co, sin(g) AS si FROM k)
SELECT l_orderkey, l_linenumber, round(greatest(0, w) * greatest(0, h) / (612 * 792), 9) AS rel_area,
  round(CASE WHEN w <= 0 OR h <= 0 THEN 1 ELSE least(1, aa / (aa * co + bb * si), bb / nullif(abs(bb * co - aa * si), 0), aa / nullif(abs(aa * co - bb * si), 0), bb / (aa * si + bb * co)) END, 6) AS scale,
  len(list_filter(over, lambda o: o > 1)) > 0 AS bleeds, greatest(0, w) * greatest(0, h) / (612 * 792) < 0.7 AND len(list_filter(over, lambda o: o > 1)) <= 2 AND len(list_filter(over, lambda o: o > 2)) = 0 AS flush_,
  w > 0 AND h > 0 AND greatest(w, h) / least(w, h) >= 6 AS extreme, greatest(w, h) >= 300 AS large_, round(CASE WHEN w * h > 0 THEN (w * sqrt(0.5)) * (h * sqrt(0.5)) / (w * h) END, 6) AS center_share FROM q"""
)
def rect_shares(spark, sf_dir):
    from ..operators import images

    page, r = G.rect(*[F.lit(float(v)) for v in (0, 0, 612, 792)]), F.col("r")
    w, h = r["maxX"] - r["minX"], r["maxY"] - r["minY"]
    return rects(spark, sf_dir).select(
        *KEYS, F.round(G.relative_area(r, page), 9).alias("rel_area"), F.round(G.inscribed_scale(w, h, F.col("t")), 6).alias("scale"), images.bleeds(r, page).alias("bleeds"), images.flush(r, page).alias("flush_"),
        images.extreme_aspect(r).alias("extreme"), images.large(r).alias("large_"), F.round(F.when(w * h > 0, G.area(G.shrink_to_center(r)) / (w * h)), 6).alias("center_share"),
    )


ANGLE = "((degrees(atan2(b, a)) % 360) + 360) % 360"


@query(
    f"""WITH {M}, s AS (SELECT *, abs(b) <= 0.01 * greatest(abs(a), abs(d)) AND abs(c) <= 0.01 * greatest(abs(a), abs(d)) AS straight, a * d - b * c <= 0 AS mirrored, degrees(atan2(b, a)) AS angle FROM mx),
q AS (SELECT *, floor(angle / 90 + 0.5)::INT AS quarters FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN straight THEN a < 0 ELSE mirrored AND abs(angle) >= 135 END AS flip_x, CASE WHEN straight THEN d < 0 ELSE mirrored AND abs(angle) <= 45 END AS flip_y, NOT straight AS rotated,
  CASE WHEN NOT straight AND NOT mirrored AND quarters <> 0 AND abs(angle - quarters * 90) <= 25 THEN ((-quarters % 4) + 4) % 4 END AS quarter_turns FROM q"""
)
def placements(spark, sf_dir):
    return matrices(spark, sf_dir).select(*KEYS, G.placement(matrix()).alias("p")).select(*KEYS, "p.*")


@query(
    f"""WITH {M}, s AS (SELECT *, {ANGLE} AS raw, (floor(({ANGLE}) / 90 + 0.5) * 90)::INT % 360 AS stream FROM mx),
x AS (SELECT *, least(abs(raw - stream), 360 - abs(raw - stream)) AS off, CASE stream WHEN 0 THEN e WHEN 180 THEN -e WHEN 90 THEN f ELSE -f END AS along, CASE WHEN stream IN (0, 180) THEN f ELSE e END AS crossp,
  coalesce(nullif(sqrt(a * a + b * b), 0), 1) AS size FROM s)
SELECT l_orderkey % 20 AS page, stream, count(*) AS items, count(DISTINCT CASE WHEN off > 15 THEN floor(raw + 0.5) END) AS unusual, round(sum(along), 3)::DOUBLE AS along, round(sum(crossp), 3)::DOUBLE AS crossing,
  round(sum(greatest(1, size * 0.3)), 3) AS tolerance, stream = 0 AS is_primary FROM x GROUP BY ALL"""
)
def angle_streams(spark, sf_dir):
    from ..operators.words import baseline_tolerance

    along, cross = G.along_cross(matrix())
    x = matrices(spark, sf_dir).select((F.col("l_orderkey") % 20).alias("page"), G.stream_angle(matrix()).alias("stream"), G.off_axis(matrix()).alias("off"), F.floor(G.angle_of(matrix()) + 0.5).alias("raw"), along.alias("along"), cross.alias("cross"), G.font_size(matrix()).alias("size"))
    return x.groupBy("page", "stream").agg(
        F.count("*").alias("items"), F.countDistinct(F.when(F.col("off") > 15, F.col("raw"))).alias("unusual"), F.round(F.sum("along"), 3).alias("along"), F.round(F.sum("cross"), 3).alias("crossing"),
        F.round(F.sum(baseline_tolerance(F.col("size"))), 3).alias("tolerance"),
    ).withColumn("is_primary", F.col("stream") == 0)


@query(
    """WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'ABCDEF+' WHEN p_partkey % 3 = 1 THEN 'ABCDE+' ELSE '' END || replace(p_name, ' ', '-') || CASE p_partkey % 5 WHEN 0 THEN '-BoldItalic' WHEN 1 THEN '-HEAVY' WHEN 2 THEN '-Oblique' ELSE '' END AS font, p_retailprice / 97 AS size FROM part),
k AS (SELECT p_partkey, regexp_replace(font, '^[A-Z]{6}[+]', '') || '@' || CASE WHEN floor(size * 2 + 0.5) % 2 = 0 THEN (floor(size * 2 + 0.5) / 2)::BIGINT::VARCHAR ELSE floor(floor(size * 2 + 0.5) / 2)::BIGINT::VARCHAR || '.5' END AS font_key FROM n)
SELECT p_partkey, font_key, regexp_matches(lower(split_part(font_key, '@', 1)), 'bold|black|heavy') AS bold, regexp_matches(lower(split_part(font_key, '@', 1)), 'italic|oblique') AS italic FROM k"""
)
def font_names(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 3 == 0, "ABCDEF+").when(k % 3 == 1, "ABCDE+").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("-")), F.when(k % 5 == 0, "-BoldItalic").when(k % 5 == 1, "-HEAVY").when(k % 5 == 2, "-Oblique").otherwise(""))
    return table(spark, sf_dir, "part").select(k, fonts.font_key(name, F.col("p_retailprice") / 97).alias("font_key")).select("*", fonts.style(F.col("font_key")).alias("s")).select(k, "font_key", "s.*")


@query(
    f"""WITH {M}, p AS (SELECT l_orderkey, l_linenumber, e - 10 AS lx, 780 - f AS dn, l_linenumber % 4 * 90 AS rot FROM mx),
s AS (SELECT *, CASE rot WHEN 0 THEN lx WHEN 90 THEN 760 - dn WHEN 180 THEN 600 - lx ELSE dn END / CASE WHEN rot IN (90, 270) THEN 760 ELSE 600 END * 1200 AS sx,
  CASE rot WHEN 0 THEN dn WHEN 90 THEN lx WHEN 180 THEN 760 - dn ELSE 600 - lx END / CASE WHEN rot IN (90, 270) THEN 600 ELSE 760 END * 1600 AS sy FROM p)
SELECT l_orderkey, l_linenumber, round(sx, 6) AS sx, round(sy, 6) AS sy, round(lx + 10, 6)::DOUBLE AS px, round(780 - dn, 6)::DOUBLE AS py FROM s"""
)
def screen_points(spark, sf_dir):
    box, rot = G.rect(*[F.lit(float(v)) for v in (10, 20, 610, 780)]), F.col("l_linenumber") % 4 * 90
    page = (box, rot, F.lit(1200.0), F.lit(1600.0))
    sx, sy = pages.to_screen(F.col("e"), F.col("f"), *page)
    px, py = pages.to_page(F.col("sx"), F.col("sy"), *page)
    return rounded(matrices(spark, sf_dir).withColumn("sx", sx).withColumn("sy", sy).select(*KEYS, "sx", "sy", px.alias("px"), py.alias("py")), sx=6, sy=6, px=6, py=6)


STAR = [(250, 690), (100, 200), (480, 520), (20, 520), (400, 200)]


@query(
    f"""WITH {M}, g(i, x, y) AS (VALUES {", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(STAR))}), ed AS (SELECT p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM g p JOIN g q ON q.i = (p.i + 4) % 5)
SELECT l_orderkey, l_linenumber, (SELECT count(*) FROM ed WHERE (py > f) <> (qy > f) AND e < (qx - px) * (f - py) / nullif(qy - py, 0)::DOUBLE + px) % 2 = 1 AS inside FROM mx"""
)
def star_hits(spark, sf_dir):
    star = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in STAR])
    return matrices(spark, sf_dir).select(*KEYS, G.inside_polygon(F.col("e"), F.col("f"), star).alias("inside"))
