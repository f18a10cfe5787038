"""Queries over pictures: order lines are paintings, orders pages of the books l_orderkey % 40, parts objects."""

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import images
from ..sources.tables import table
from .queries import query, rounded

OCC = """occ AS (SELECT l_orderkey % 40 AS book, l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx, CASE WHEN l_partkey % 9 <> 0 THEN l_partkey % 60 END AS obj_id,
  floor(l_quantity / 12) * 100 AS x0, floor(l_discount * 50) * 60 AS y0, floor(l_quantity / 12) * 100 + 40 + l_suppkey % 4 * 150 AS x1, floor(l_discount * 50) * 60 + 30 + l_suppkey % 5 * 150 AS y1,
  l_returnflag = 'R' AND l_linestatus = 'F' AS luminosity, l_partkey % 7 = 0 AS mask_painting, CASE WHEN l_suppkey % 3 > 0 THEN 1 - l_tax END AS opacity, CASE WHEN l_suppkey % 2 = 0 THEN l_partkey % 5 * 100 + 50 END AS width FROM lineitem)"""
RATIO = "greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)) / least(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0), ({b}.x1 - {b}.x0) * ({b}.y1 - {b}.y0))"


def occurrences(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x, y = F.floor(F.col("l_quantity") / 12) * 100, F.floor(F.col("l_discount") * 50) * 60
    s, k = F.col("l_suppkey"), F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 40).alias("book"), F.col("l_orderkey").alias("page"), F.row_number().over(w).alias("idx"), F.when(k % 9 != 0, k % 60).alias("obj_id"), G.rect(x, y, x + 40 + s % 4 * 150, y + 30 + s % 5 * 150).alias("bbox"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("luminosity"), (k % 7 == 0).alias("mask_painting"), F.when(s % 3 > 0, 1 - F.col("l_tax")).alias("opacity"), F.when(s % 2 == 0, k % 5 * 100 + 50).alias("width"),
    )


EVIDENCE = f"""{OCC}, ahead AS (SELECT a.page, a.idx, arg_min(b.obj_id, b.idx) AS obj FROM occ a JOIN occ b ON a.page = b.page AND b.idx BETWEEN a.idx + 1 AND a.idx + 5 AND b.obj_id IS DISTINCT FROM a.obj_id AND b.obj_id IS NOT NULL AND {RATIO.format(a='a', b='b')} >= 0.95
    AND NOT EXISTS (FROM occ c WHERE c.page = a.page AND c.idx BETWEEN a.idx + 1 AND b.idx - 1 AND c.obj_id IS NULL AND a.obj_id IS NOT NULL AND {RATIO.format(a='a', b='c')} >= 0.95) GROUP BY a.page, a.idx),
back AS (SELECT a.page, a.idx, max(b.idx) AS at_ FROM occ a JOIN occ b ON a.page = b.page AND b.idx BETWEEN a.idx - 3 AND a.idx - 1 AND {RATIO.format(a='a', b='b')} >= 0.95 GROUP BY a.page, a.idx),
ev AS (SELECT o.*, CASE WHEN o.luminosity THEN 'group' WHEN o.mask_painting THEN 'opcode' WHEN k.at_ IS NOT NULL THEN 'geometry' END AS evidence, CASE WHEN o.luminosity OR o.mask_painting THEN h.obj ELSE p.obj_id END AS masks
  FROM occ o LEFT JOIN ahead h ON o.page = h.page AND o.idx = h.idx LEFT JOIN back k ON o.page = k.page AND o.idx = k.idx LEFT JOIN occ p ON p.page = k.page AND p.idx = k.at_)"""


@query(f"WITH {EVIDENCE} SELECT page, idx, obj_id, evidence, masks FROM ev")
def mask_evidence(spark, sf_dir):
    return images.mask_evidence(occurrences(spark, sf_dir), ["page"]).select("page", F.col("idx").cast("long").alias("idx"), "obj_id", "evidence", "masks")


ENTRIES = f"""{EVIDENCE}, sq AS (SELECT *, page * 100 + idx AS seq, CASE WHEN obj_id IS NULL THEN page * 100 + idx END AS inline, (x1 - x0) * (y1 - y0) / (612 * 792) AS share, CASE evidence WHEN 'group' THEN 3 WHEN 'opcode' THEN 2 WHEN 'geometry' THEN 1 END AS st FROM ev),
en AS (SELECT book, obj_id, inline, count(*) AS occurrences, list_sort(list_distinct(list(page))) AS pages, max(share) AS max_area, arg_max(struct_pack(e := evidence, m := masks), (st, -seq)) FILTER (WHERE st IS NOT NULL) AS best,
  arg_min(width, seq) FILTER (WHERE width IS NOT NULL) AS width, CASE WHEN count(opacity) = count(*) THEN max(opacity) END AS max_opacity, arg_min(struct_pack(x0, y0, x1, y1), seq) AS box FROM sq GROUP BY ALL)"""


def entries(spark, sf_dir):
    occ = images.mask_evidence(occurrences(spark, sf_dir), ["page"]).withColumn("seq", F.col("page") * 100 + F.col("idx")).withColumn("height", F.col("width"))
    pages = occ.select("book", "page").distinct().withColumn("box", G.rect(*[F.lit(float(v)) for v in (0, 0, 612, 792)]))
    return images.entries(occ, pages, ["book"]), occ, pages


@query(f"WITH {ENTRIES} SELECT book, obj_id, inline, occurrences, len(pages) AS n_pages, pages[1] AS first_page, round(max_area, 9) AS max_area, best.e AS evidence, best.m AS masks, width, max_opacity, coalesce(best.e IN ('group', 'opcode'), false) AS is_mask FROM en")
def image_entries(spark, sf_dir):
    e, _, _ = entries(spark, sf_dir)
    return rounded(e.select("book", "obj_id", "inline", "occurrences", F.size("pages").cast("long").alias("n_pages"), F.get("pages", F.lit(0)).alias("first_page"), "max_area", "evidence", "masks", "width", "max_opacity", "is_mask"), max_area=9)


@query(
    f"""WITH {ENTRIES}, hard AS (SELECT DISTINCT book, best.m AS m FROM en WHERE best.e IN ('group', 'opcode') AND best.m IS NOT NULL),
u AS (SELECT en.*, hard.m IS NOT NULL AS is_masked, count(*) OVER (PARTITION BY occurrences) AS members, coalesce(obj_id, 0) % 4 = 1 AS crosses, max_area * 2 AS co_share, coalesce(obj_id, 1) % 3 > 0 AS fits, occurrences % 2 = 0 AS visible FROM en LEFT JOIN hard ON en.book = hard.book AND en.obj_id = hard.m),
r AS (SELECT *, obj_id IS NOT NULL AND fits AND (is_masked OR members > 1) AS raw FROM u)
SELECT book, obj_id, inline, is_masked, members, CASE WHEN coalesce(obj_id, 1) % 20 = 7 THEN 'Z2-vector-only-no-image' WHEN coalesce(obj_id, 1) % 20 = 9 THEN 'Z2-text-over-picture-is-content' WHEN raw AND co_share >= 0.05 AND (crosses OR (is_masked AND visible)) THEN 'Z2-cluster-has-significant-members'
  WHEN crosses AND raw THEN 'Z2-text-crosses-region-prefer-raw-resource' WHEN is_masked AND visible AND raw THEN 'Z2-masked-raw-resource-fits-placement' WHEN is_masked THEN 'Z2-masked-direct-would-omit-mask'
  WHEN members > 1 THEN 'Z2-cluster-composition-is-content' ELSE 'Z2-single-clean-image' END AS reason,
  least(4096, CASE WHEN width IS NULL THEN greatest(900, CASE WHEN max_area >= 0.4 THEN 2048 WHEN max_area >= 0.1 THEN 1024 ELSE 512 END) ELSE greatest(width * 1.15, CASE WHEN max_area >= 0.4 THEN 2048 WHEN max_area >= 0.1 THEN 1024 ELSE 512 END) END)::DOUBLE AS edge,
  CASE WHEN is_masked THEN 'unknown' WHEN crosses AND greatest(coalesce(width, 900), 300 + members % 7 * 300) <= 400 AND coalesce(width, 900) / (300 + members % 7 * 300) BETWEEN 0.6 AND 1.1 THEN 'portrait'
    WHEN greatest(coalesce(width, 900), 300 + members % 7 * 300) >= 1200 AND coalesce(width, 900) / (300 + members % 7 * 300) BETWEEN 0.5 AND 2.2 THEN 'scene' WHEN greatest(coalesce(width, 900), 300 + members % 7 * 300) >= 400 THEN 'handout' ELSE 'unknown' END AS kind FROM r"""
)
def strategies(spark, sf_dir):
    e, _, _ = entries(spark, sf_dir)
    o = F.coalesce("obj_id", F.lit(1))
    x = images.member_counts(images.masked_objects(e, ["book"]), "occurrences")
    x = x.withColumn("vector_only", o % 20 == 7).withColumn("text_over", o % 20 == 9).withColumn("co_share", F.col("max_area") * 2).withColumn("inline_", F.col("obj_id").isNull()).withColumn("fits", o % 3 > 0)
    x = x.withColumn("crosses", F.coalesce("obj_id", F.lit(0)) % 4 == 1).withColumn("mostly_visible", F.col("occurrences") % 2 == 0)
    edge = images.target_edge(F.array_compact(F.array("width")), F.col("max_area"), F.lit(900), F.lit(4096))
    w, h = F.coalesce("width", F.lit(900)), 300 + F.col("members") % 7 * 300
    keys = x.withColumn("_inline", F.col("inline")).withColumn("inline", F.col("inline_"))
    return keys.select("book", "obj_id", F.col("_inline").alias("inline"), "is_masked", "members", images.strategy()["reason"].alias("reason"), edge.cast("double").alias("edge"), images.target_kind(~F.col("is_masked"), w, h, F.col("crosses")).alias("kind"))


@query(
    f"""WITH {ENTRIES}, q AS (SELECT *, floor(box.x0 / 0.5 + 0.5) AS a, floor(box.y0 / 0.5 + 0.5) AS b, floor(box.x1 / 0.5 + 0.5) AS c, floor(box.y1 / 0.5 + 0.5) AS d FROM en),
g AS (SELECT book, a, b, c, d, width, arg_max(obj_id, (occurrences, -obj_id)) AS canonical FROM q WHERE obj_id IS NOT NULL GROUP BY ALL),
k AS (SELECT q.*, CASE WHEN q.obj_id IS NOT NULL THEN g.canonical END AS canonical FROM q LEFT JOIN g ON q.book = g.book AND q.a = g.a AND q.b = g.b AND q.c = g.c AND q.d = g.d AND q.width IS NOT DISTINCT FROM g.width),
s AS (SELECT book, canonical, count(DISTINCT p) AS n FROM (SELECT book, canonical, unnest(pages) AS p FROM k WHERE canonical IS NOT NULL) GROUP BY ALL)
SELECT k.book, obj_id, inline, k.canonical, coalesce(s.n, len(pages)) AS shared_pages FROM k LEFT JOIN s ON k.book = s.book AND k.canonical = s.canonical"""
)
def correlated_images(spark, sf_dir):
    e, occ, _ = entries(spark, sf_dir)
    first = occ.groupBy("book", "obj_id", F.when(F.col("obj_id").isNull(), F.col("seq")).alias("inline")).agg(F.min_by("bbox", "seq").alias("bbox"))
    e = e.alias("e").join(first.alias("f"), F.expr("e.book = f.book AND e.obj_id <=> f.obj_id AND e.inline <=> f.inline")).select("e.*", "f.bbox")
    return images.correlated_pages(images.correlate(e, ["book"]), ["book"]).select("book", "obj_id", "inline", "canonical", "shared_pages")


@query(f"""WITH {OCC}, c AS (SELECT DISTINCT a.page, a.idx FROM occ a JOIN occ b ON a.page = b.page AND b.idx > a.idx WHERE greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= 0.75 * (a.x1 - a.x0) * (a.y1 - a.y0))
SELECT o.page, o.idx, c.idx IS NOT NULL AS covered, o.idx = max(o.idx) OVER (PARTITION BY o.page) AS top FROM occ o LEFT JOIN c ON o.page = c.page AND o.idx = c.idx""")
def covered_images(spark, sf_dir):
    occ = occurrences(spark, sf_dir)
    top = images.top_painting(occ, ["page"]).select("page", F.col("idx").alias("t"))
    return images.painted_over(occ, ["page"]).join(top, "page").select("page", F.col("idx").cast("long").alias("idx"), "covered", (F.col("idx") == F.col("t")).alias("top"))


@query(
    f"""WITH {OCC}, n AS (SELECT book, obj_id, count(DISTINCT page) AS n FROM occ WHERE obj_id IS NOT NULL GROUP BY ALL), pg AS (SELECT book, count(DISTINCT page) AS total FROM occ GROUP BY book),
f AS (SELECT o.book, count(DISTINCT page) AS full_ FROM occ o JOIN n ON o.book = n.book AND o.obj_id = n.obj_id WHERE n >= 5 AND greatest(0, least(x1, 300) - greatest(x0, 0)) * greatest(0, least(y1, 300) - greatest(y0, 0)) / 90000 >= 0.9 GROUP BY o.book)
SELECT pg.book, coalesce(full_, 0) >= 0.5 * total AS common FROM pg LEFT JOIN f ON pg.book = f.book"""
)
def page_backgrounds(spark, sf_dir):
    occ = occurrences(spark, sf_dir)
    shared = occ.where("obj_id IS NOT NULL").groupBy("book", "obj_id").agg(F.countDistinct("page").alias("shared_pages"))
    pages = occ.select("book", "page").distinct().withColumn("box", G.rect(*[F.lit(float(v)) for v in (0, 0, 300, 300)]))
    return images.common_background(occ.join(shared, ["book", "obj_id"]), pages, ["book"])


@query(
    """WITH p AS (SELECT c_nationkey AS book, c_custkey AS id, floor(abs(c_acctbal)) % 360 AS hue FROM customer)
SELECT a.book, a.id, count(*) AS near, count(*) >= 6 AS ornament FROM p a JOIN p b ON a.book = b.book AND least(abs(a.hue - b.hue), 360 - abs(a.hue - b.hue)) <= 15 GROUP BY a.book, a.id"""
)
def hue_ornaments(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("book"), F.col("c_custkey").alias("id"), (F.floor(F.abs("c_acctbal")) % 360).alias("hue"))
    return images.hue_neighbours(p, ["book"]).select("book", "id", "near", "ornament")


def reach_sql(rows: str, link: str, where: str = "true") -> str:
    """cl: page, idx and the least idx that links lead to."""
    return f"""lk AS (SELECT a.page, a.idx AS x, b.idx AS y FROM {rows} a JOIN {rows} b ON a.page = b.page AND a.idx <> b.idx AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 AND {link}),
reach AS (SELECT page, idx, idx AS seen FROM {rows} UNION SELECT reach.page, reach.idx, lk.y FROM reach JOIN lk ON reach.page = lk.page AND reach.seen = lk.x), cl AS (SELECT page, idx, min(seen) AS head FROM reach GROUP BY page, idx)"""


@query(f"WITH RECURSIVE {OCC}, {reach_sql('occ', 'true')} SELECT page, idx, dense_rank() OVER (PARTITION BY page ORDER BY head) - 1 AS cluster FROM cl")
def picture_clusters(spark, sf_dir):
    return images.overlap_clusters(occurrences(spark, sf_dir).select("page", F.col("idx").cast("long").alias("idx"), "bbox"), ["page"]).select("page", "idx", "cluster")


GROUPS = f"""{OCC}, it AS (SELECT page, idx, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) / (612 * 792) AS area, CASE (page + idx) % 5 WHEN 0 THEN 'alone' WHEN 1 THEN 'anchor' WHEN 2 THEN 'anchor' ELSE 'rest' END AS kind, idx % 3 = 0 AS translucent, idx % 2 = 0 AS is_masked,
  CASE idx % 4 WHEN 0 THEN 'undecided' ELSE 'content' END AS class FROM occ), an AS (SELECT * FROM it WHERE kind = 'anchor'), {reach_sql('an', RATIO.format(a='a', b='b') + ' >= 0.2')},
bj AS (SELECT r.page, r.idx, a.idx AS anchor, {RATIO.format(a='r', b='a')} AS ratio FROM it r JOIN an a ON r.page = a.page AND r.x0 < a.x1 AND a.x0 < r.x1 AND r.y0 < a.y1 AND a.y0 < r.y1 WHERE r.kind = 'rest'
  QUALIFY row_number() OVER (PARTITION BY r.page, r.idx ORDER BY (least(r.x1, a.x1) - greatest(r.x0, a.x0)) * (least(r.y1, a.y1) - greatest(r.y0, a.y0)) DESC, a.idx) = 1),
lo AS (SELECT it.* FROM it LEFT JOIN bj ON it.page = bj.page AND it.idx = bj.idx AND ratio >= 0.2 WHERE kind = 'rest' AND bj.idx IS NULL),
lk2 AS (SELECT a.page, a.idx AS x, b.idx AS y FROM lo a JOIN lo b ON a.page = b.page AND a.idx <> b.idx AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
reach2 AS (SELECT page, idx, idx AS seen FROM lo UNION SELECT reach2.page, reach2.idx, lk2.y FROM reach2 JOIN lk2 ON reach2.page = lk2.page AND reach2.seen = lk2.x),
gr AS (SELECT page, idx, 'a' || head AS g FROM cl UNION ALL SELECT bj.page, bj.idx, 'a' || cl.head FROM bj JOIN cl ON bj.page = cl.page AND bj.anchor = cl.idx WHERE ratio >= 0.2 UNION ALL SELECT page, idx, 's' || idx FROM it WHERE kind = 'alone' UNION ALL SELECT page, idx, 'r' || min(seen) FROM reach2 GROUP BY page, idx),
nm AS (SELECT page, g, min(idx) AS first_ FROM gr GROUP BY page, g), gp AS (SELECT it.*, dense_rank() OVER (PARTITION BY it.page ORDER BY first_) - 1 AS grp FROM it JOIN gr ON it.page = gr.page AND it.idx = gr.idx JOIN nm ON nm.page = gr.page AND nm.g = gr.g)"""


def grouped(spark, sf_dir):
    i = F.col("idx")
    occ = occurrences(spark, sf_dir).select("page", i.cast("long").alias("idx"), "bbox")
    kind = F.when((F.col("page") + i) % 5 == 0, "alone").when(((F.col("page") + i) % 5).isin(1, 2), "anchor").otherwise("rest")
    return images.candidate_groups(occ.withColumn("kind", kind), ["page"])


@query(f"WITH RECURSIVE {GROUPS} SELECT page, idx, grp FROM gp")
def picture_groups(spark, sf_dir):
    return grouped(spark, sf_dir).select("page", "idx", F.col("group").alias("grp"))


@query(
    f"""WITH RECURSIVE {GROUPS}, u AS (SELECT page, grp, count(*) AS members, arg_max(struct_pack(idx, class, translucent), (area, -idx)) AS most, arg_max(struct_pack(idx, class, translucent), (area, -idx)) FILTER (WHERE NOT translucent AND is_masked AND area >= 0.05) AS photo,
  min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, max(x1)::DOUBLE AS x1, max(y1)::DOUBLE AS y1 FROM gp GROUP BY page, grp), b AS (SELECT *, CASE WHEN most.translucent AND most.class = 'undecided' AND photo IS NOT NULL THEN photo ELSE most END AS best FROM u)
SELECT page, grp, members, best.idx AS representative, x0, y0, x1, y1, CASE WHEN members > 1 AND (x1 - x0) * (y1 - y0) / (612 * 792) > 0.85 THEN 'undecided' ELSE best.class END AS kind FROM b"""
)
def picture_units(spark, sf_dir):
    i, box = F.col("idx"), G.rect(*[F.lit(float(v)) for v in (0, 0, 612, 792)])
    g = grouped(spark, sf_dir).drop("kind").withColumns({"area": G.relative_area(F.col("bbox"), box), "class": F.when(i % 4 == 0, "undecided").otherwise("content"), "reason": F.lit("r"), "translucent": i % 3 == 0, "is_masked": i % 2 == 0, "box": box})
    return images.units(g, ["page"]).select("page", F.col("group").alias("grp"), "members", "representative", *[F.col(f"bbox.{a}").alias(n) for a, n in (("minX", "x0"), ("minY", "y0"), ("maxX", "x1"), ("maxY", "y1"))], "kind")


@query(
    f"""WITH {OCC}, pc AS (SELECT page // 400 AS book, page % 400 // 8 + 1 AS page, page * 10 + idx AS idx, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) AS size, CASE WHEN page % 50 = 1 THEN 0.96 ELSE (x1 - x0) * (y1 - y0) / 700000 * CASE WHEN idx % 4 = 0 THEN 0.02 ELSE 1 END END AS area, CASE idx % 4 WHEN 1 THEN 'content' WHEN 3 THEN 'mask' ELSE 'undecided' END AS kind,
  CASE WHEN page % 3 > 0 THEN 'Z1-no-strong-signal' ELSE 'Z9-text-over-small-picture' END AS reason, CASE WHEN idx % 3 = 0 THEN opacity - 0.4 END AS opacity, luminosity AS blended, mask_painting OR idx % 2 = 0 AS is_masked, idx % 6 = 2 AS backdrop, page % 90 AS width, 30 AS height FROM occ),
w AS (SELECT *, kind IN ('content', 'undecided') AND area >= 0.03 AS shown, count(*) FILTER (WHERE kind = 'undecided' AND area < 0.005) OVER p AS tiny, count(*) FILTER (WHERE area < 0.06 AND kind <> 'mask') OVER p AS small, count(*) FILTER (WHERE area < 0.06) OVER p AS every, count(*) FILTER (WHERE reason = 'Z1-no-strong-signal') OVER p AS plain FROM pc WINDOW p AS (PARTITION BY book, page)),
pr AS (SELECT a.book, a.page, a.idx, b.idx > a.idx AS later, b.area AS oa, b.kind AS ok, b.opacity AS oo, b.backdrop AS ob, b.size AS os, a.size, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS sh FROM w a JOIN w b ON a.book = b.book AND a.page = b.page AND a.idx <> b.idx AND b.shown AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
fl AS (SELECT book, page, idx, bool_or(NOT later AND oa >= 0.9 AND page = 1 AND sh / size >= 0.9) AS cover, bool_or(NOT later AND ok = 'content' AND size <= 0.125 * os AND sh / size BETWEEN 0.2 AND 0.95) AS edge, bool_or(later AND NOT ob AND oo IS NULL AND sh >= 0.8 * os AND sh / size >= 0.25) AS over_,
  bool_or(later AND ok = 'content' AND oa >= 0.05) AS content, bool_or(NOT later AND sh / size >= 0.9 AND sh >= 0.6 * os) AS copy_ FROM pr GROUP BY ALL),
j AS (SELECT w.*, coalesce(cover, false) AS cover, coalesce(over_, false) AS over_, coalesce(content, false) AS content, coalesce(copy_, false) AS copy_, coalesce(edge, false) AND NOT blended AND reason = 'Z1-no-strong-signal' AND area <= 0.02 AS f FROM w LEFT JOIN fl ON w.book = fl.book AND w.page = fl.page AND w.idx = fl.idx),
n AS (SELECT *, count(*) FILTER (WHERE f) OVER (PARTITION BY book, page) AS fn FROM j), s AS (SELECT book, count(DISTINCT page) AS spots FROM n WHERE f AND fn <= 2 GROUP BY book),
r AS (SELECT n.*, CASE WHEN kind IN ('content', 'undecided') AND ((cover AND area < 0.9 AND width >= 1.5 * height) OR (page <= 3 AND reason = 'Z1-no-strong-signal' AND width >= 1.6 * height AND plain <= 2)) THEN 'Z33-lettering-over-cover' WHEN f AND fn <= 2 AND coalesce(spots, 0) >= 3 THEN 'Z31-fastener-over-picture-edge'
  WHEN kind IN ('content', 'undecided') AND is_masked AND backdrop AND area <= 0.15 AND over_ THEN 'Z34-translucent-ground-under-picture' WHEN (tiny >= 15 OR every >= 20) AND kind = 'undecided' AND reason <> 'Z9-text-over-small-picture' AND area >= 0.005 AND area < 0.06 THEN 'Z18-form-page-element'
  WHEN kind = 'undecided' AND area >= 0.95 AND small >= 15 THEN 'Z18-form-page-background' WHEN kind = 'undecided' AND area < 0.005 THEN 'Z16-tiny-undecided' WHEN shown AND page > 1 AND kind = 'undecided' AND area >= 0.95 AND content THEN 'Z22-page-background-under-content' WHEN shown AND opacity <= 0.65 AND copy_ THEN 'Z19-translucent-copy-of-picture' END AS why FROM n LEFT JOIN s ON n.book = s.book)
SELECT book, page, idx, CASE WHEN why IS NOT NULL THEN 'decoration' ELSE kind END AS kind, coalesce(why, reason) AS reason FROM r"""
)
def second_classes(spark, sf_dir):
    p, i = F.col("page"), F.col("idx")
    x = occurrences(spark, sf_dir)
    size = G.area(F.col("bbox"))
    x = x.select(
        F.floor(p / 400).alias("book"), (F.floor(p % 400 / 8) + 1).alias("page"), (p * 10 + i).alias("idx"), "bbox", F.when(p % 50 == 1, 0.96).otherwise(size / 700000 * F.when(i % 4 == 0, 0.02).otherwise(1.0)).alias("area"), F.when(i % 4 == 1, "content").when(i % 4 == 3, "mask").otherwise("undecided").alias("kind"),
        F.when(p % 3 > 0, "Z1-no-strong-signal").otherwise("Z9-text-over-small-picture").alias("reason"), F.when(i % 3 == 0, F.col("opacity") - 0.4).alias("opacity"), F.col("luminosity").alias("blended"), (F.col("mask_painting") | (i % 2 == 0)).alias("is_masked"), (i % 6 == 2).alias("backdrop"), (p % 90).alias("width"), F.lit(30).alias("height"),
    )
    return images.second_class(x, ["book"]).select("book", "page", "idx", "kind", "reason")
