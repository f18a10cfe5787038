"""Queries over pictures' classes and pixels, split lines, gutters, and small reports."""

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import pixels
from ..functions import text as T
from ..operators import images, lines
from ..sources.tables import table
from .queries import ITEMS, query, rounded

FEATURES = """f AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 10 > 0 THEN l_partkey END AS obj_id, CASE l_suppkey % 9 WHEN 0 THEN 'group' WHEN 1 THEN 'opcode' WHEN 2 THEN 'geometry' WHEN 3 THEN 'geometry' END AS evidence, l_quantity * l_quantity / 2500 AS area,
  CASE WHEN l_partkey % 3 > 0 THEN 1 - l_discount * 9 END AS alpha, l_partkey % 7 * 90 AS w, l_partkey % 4 * 60 + 20 AS h, l_linenumber AS shared, l_partkey % 2 = 0 AS masked, l_returnflag = 'A' AS blended, l_partkey % 6 = 0 AS mirrored, l_linestatus = 'F' AS bleeds, l_suppkey % 2 = 0 AS flush_,
  l_suppkey % 5 = 0 AS extreme, l_suppkey % 4 = 0 AS large_, l_tax * 4 AS txt, l_discount * 3 AS ctr, CASE WHEN l_partkey % 5 > 1 THEN l_tax * 5 END AS words, CASE WHEN l_partkey % 5 > 1 THEN l_discount END AS cwords, l_orderkey % 2 = 0 AS common, l_orderkey % 3 = 0 AS painted FROM lineitem)"""


@query(
    f"""WITH {FEATURES}, g AS (SELECT *, coalesce(alpha >= 0.95, true) AS op, coalesce(alpha <= 0.65, false) AS clear_, coalesce(alpha <= CASE WHEN area >= 0.1 AND blended THEN 0.35 ELSE 0.25 END, false) AS back, CASE WHEN w > 0 THEN greatest(w, h) END AS edge, CASE WHEN w > 0 THEN greatest(w, h) / least(w, h) END AS asp, obj_id IS NOT NULL AND masked AS mk FROM f),
k AS (SELECT *, CASE WHEN evidence = 'group' THEN 'Z1-mask-evidence-group' WHEN evidence = 'opcode' THEN 'Z1-mask-evidence-opcode' WHEN area < 0.05 AND mirrored THEN 'Z25-repeated-on-page'
 WHEN shared >= 5 THEN CASE WHEN bleeds THEN 'Z1-multi-page-correlated' WHEN extreme THEN 'Z14-repeated-extreme-aspect-ratio' ELSE 'Z11-repeated-no-bleed-evidence' END
 WHEN bleeds THEN CASE WHEN common AND shared = 1 AND area >= 0.9 AND op AND NOT blended AND CASE WHEN words IS NOT NULL THEN words >= 0.15 ELSE ctr >= 0.15 END AND NOT painted THEN 'Z1-full-page-document' WHEN ctr >= CASE WHEN flush_ THEN 0.4 ELSE 0.15 END THEN 'Z1-full-bleed-background'
   WHEN mk THEN CASE WHEN area >= 0.3 AND area < 0.75 AND NOT clear_ AND NOT (NOT op AND blended) THEN 'Z12-bleeding-masked-large-picture' ELSE 'Z12-bleeding-masked-cutout' END WHEN clear_ THEN CASE WHEN area >= 0.3 AND NOT back THEN 'Z12-bleeding-translucent-panel' ELSE 'Z12-bleeding-translucent-overlay' END
   WHEN asp >= 3 AND area < 0.1 THEN 'Z24-small-bleeding-strip' WHEN flush_ THEN 'Z12-flush-no-center-text-evidence' ELSE 'Z12-bleeding-no-center-text-evidence' END
 WHEN evidence = 'geometry' THEN CASE WHEN area >= 0.4 AND large_ THEN 'Z2-strong-content-overrides-weak-geometry-evidence' WHEN area >= 0.4 THEN 'Z1-conflicting-geometry-mask-vs-large-area' ELSE 'Z1-weak-geometry-mask-evidence' END
 WHEN txt >= 0.15 AND NOT large_ THEN CASE WHEN area >= 0.03 AND op AND blended THEN 'Z9-text-beside-blended-picture' WHEN area BETWEEN 0.02 AND 0.1 AND op THEN 'Z9-text-over-small-picture' WHEN area >= 0.02 AND op AND cwords <= 0.03 THEN 'Z9-text-wraps-around-picture' ELSE 'Z9-high-body-text-coverage' END
 WHEN ctr >= 0.15 THEN 'Z10-high-center-text-coverage' WHEN area >= 0.4 THEN 'Z1-large-relative-area' WHEN evidence IS NULL AND area >= 0.09 THEN 'Z2-moderate-area-no-mask-evidence' WHEN mk AND back AND edge <= 300 AND area < 0.06 THEN 'Z20-small-translucent-masked-raster'
 WHEN mk AND alpha <= 0.5 AND asp >= 3 AND area < 0.06 THEN 'Z25-translucent-masked-strip' WHEN mk AND asp >= 5 AND area < 0.15 THEN 'Z23-masked-strip' WHEN mk AND edge <= 300 AND asp >= 2 AND area < 0.03 THEN 'Z15-small-masked-raster' WHEN extreme THEN 'Z13-extreme-aspect-ratio-undecided' ELSE 'Z1-no-strong-signal' END AS reason FROM g)
SELECT l_orderkey, l_linenumber, l_partkey, reason, CASE WHEN reason LIKE 'Z1-mask%' THEN 'mask' WHEN reason IN ('Z2-strong-content-overrides-weak-geometry-evidence', 'Z1-large-relative-area', 'Z2-moderate-area-no-mask-evidence') THEN 'content'
  WHEN reason IN ('Z25-repeated-on-page', 'Z1-multi-page-correlated', 'Z14-repeated-extreme-aspect-ratio', 'Z1-full-bleed-background', 'Z12-bleeding-masked-cutout', 'Z12-bleeding-translucent-overlay', 'Z24-small-bleeding-strip', 'Z9-high-body-text-coverage', 'Z20-small-translucent-masked-raster', 'Z25-translucent-masked-strip', 'Z23-masked-strip', 'Z15-small-masked-raster') THEN 'decoration' ELSE 'undecided' END AS kind FROM k"""
)
def picture_classes(spark, sf_dir):
    p, s, o = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    x = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(p % 10 > 0, p).alias("obj_id"), F.when(s % 9 == 0, "group").when(s % 9 == 1, "opcode").when((s % 9).isin(2, 3), "geometry").alias("evidence"), (F.col("l_quantity") * F.col("l_quantity") / 2500).alias("max_area"),
        F.when(p % 3 > 0, 1 - F.col("l_discount") * 9).alias("max_opacity"), (p % 7 * 90).alias("width"), (p % 4 * 60 + 20).alias("height"), F.col("l_linenumber").alias("shared_pages"), (p % 2 == 0).alias("is_masked"), (F.col("l_returnflag") == "A").alias("blended"), (p % 6 == 0).alias("mirrored"),
        (F.col("l_linestatus") == "F").alias("bleeds"), (s % 2 == 0).alias("is_flush"), (s % 5 == 0).alias("extreme"), (s % 4 == 0).alias("is_large"), (F.col("l_tax") * 4).alias("text"), (F.col("l_discount") * 3).alias("center_text"), F.when(p % 5 > 1, F.col("l_tax") * 5).alias("word_text"),
        F.when(p % 5 > 1, F.col("l_discount")).alias("center_words"), (o % 2 == 0).alias("common_background"), (o % 3 == 0).alias("painted_over"),
    )
    return x.select("l_orderkey", "l_linenumber", "l_partkey", images.first_class().alias("c")).select("l_orderkey", "l_linenumber", "l_partkey", "c.reason", "c.kind")


BYTES = "v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 100000)::BIGINT % 256) AS d FROM embeddings), px AS (SELECT vec_id, unnest(range(len(d) // 4)) AS k, d FROM v), p AS (SELECT vec_id, k, d[4 * k + 1] AS r, d[4 * k + 2] AS g, d[4 * k + 3] AS b, d[4 * k + 4] AS a FROM px), q AS (SELECT *, 0.3 * r + 0.59 * g + 0.11 * b AS lum FROM p)"


def pictures(spark, sf_dir):
    """Vectors as pictures four pixels wide; a byte a number."""
    one = lambda x: F.lpad(F.hex(F.floor(F.abs(x.cast("double")) * 100000) % 256), 2, "0")
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.lit(4).alias("width"), (F.size("embedding") / 16).cast("int").alias("height"), F.unhex(F.array_join(F.transform("embedding", one), "")).alias("rgba"))


@query(
    f"""WITH {BYTES} SELECT vec_id, round(stddev_pop(lum), 6) AS spread, round(coalesce(stddev_pop(lum) FILTER (WHERE a > 16), 0), 6) AS visible_spread, round(coalesce(avg(lum) FILTER (WHERE a > 16), 0), 6) AS visible_mean, round(coalesce(avg((least(r, g, b) >= 100)::INT) FILTER (WHERE a > 16), 0), 6) AS white_share,
  round(coalesce(avg((greatest(r, g, b) <= 150)::INT) FILTER (WHERE a > 16), 0), 6) AS dark_share, round(avg((a > 16)::INT), 6) AS opaque_share FROM q GROUP BY vec_id"""
)
def picture_looks(spark, sf_dir):
    x = pictures(spark, sf_dir)
    look = x.select("vec_id", pixels.look(F.col("width"), F.col("height"), F.col("rgba"), 100, 150).alias("l")).select("vec_id", "l.*")
    return rounded(look, spread=6, visible_spread=6, visible_mean=6, white_share=6, dark_share=6, opaque_share=6)


@query(f"WITH {BYTES} SELECT vec_id, min(k % 4) FILTER (WHERE a >= 200)::INT AS x0, min(k // 4) FILTER (WHERE a >= 200)::INT AS y0, (max(k % 4) FILTER (WHERE a >= 200) + 1)::INT AS x1, (max(k // 4) FILTER (WHERE a >= 200) + 1)::INT AS y1 FROM q GROUP BY vec_id")
def visible_boxes(spark, sf_dir):
    x = pictures(spark, sf_dir)
    return x.select("vec_id", pixels.visible_box(F.col("width"), F.col("height"), F.col("rgba"), 200).alias("b")).select("vec_id", "b.*")


@query(
    f"""WITH {BYTES}, t AS (SELECT vec_id, k, floor(r * a / 255.0 + 255 * (1 - a / 255.0) + 0.5)::INT AS r, floor(g * a / 255.0 + 255 * (1 - a / 255.0) + 0.5)::INT AS g, floor(b * a / 255.0 + 255 * (1 - a / 255.0) + 0.5)::INT AS b, max(k // 4) OVER (PARTITION BY vec_id) AS last FROM p)
SELECT vec_id, (last + 1)::INT AS width, 4 AS height, sum(r * ((last - k // 4) + (last + 1) * (k % 4)))::BIGINT AS red, sum(g * (k % 4))::BIGINT AS green, sum(b * (k // 4))::BIGINT AS blue FROM t GROUP BY vec_id, last"""
)
def turned_pictures(spark, sf_dir):
    x = pictures(spark, sf_dir)
    flat = x.select("vec_id", pixels.flatten_on_white(F.col("width"), F.col("height"), F.col("rgba")).alias("p"))
    turned = flat.select("vec_id", pixels.quarter_turns(F.col("p.width"), F.col("p.height"), F.col("p.rgba"), F.lit(1)).alias("p")).select("vec_id", "p.*")
    at = F.posexplode(F.split(F.regexp_replace(F.hex("rgba"), "(.{8})(?!$)", "$1,"), ",")).alias("k", "v")
    px = turned.select("vec_id", "width", "height", at)
    part = lambda n: F.conv(F.substring("v", n, 2), 16, 10).cast("long")
    y, col = F.floor(F.col("k") / F.col("width")), F.col("k") % F.col("width")
    return px.groupBy("vec_id", "width", "height").agg(F.sum(part(1) * F.col("k")).alias("red"), F.sum(part(3) * y).alias("green"), F.sum(part(5) * (F.col("width") - 1 - col)).alias("blue"))


@query("""WITH n AS (SELECT p_partkey, p_brand AS book, p_name AS hash, p_size AS occurrences, p_size / 400 AS area, p_type AS pixels FROM part), k AS (SELECT *, CASE WHEN area >= 0.05 THEN hash || '|' || pixels ELSE hash END AS key FROM n)
SELECT p_partkey, first_value(p_partkey) OVER (PARTITION BY book, key ORDER BY occurrences DESC, p_partkey) AS canonical, count(*) OVER (PARTITION BY book, key) AS copies FROM k""")
def equal_pictures(spark, sf_dir):
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("book"), F.col("p_name").alias("hash"), F.col("p_size").alias("occurrences"), (F.col("p_size") / 400).alias("area"), F.col("p_type").alias("pixels"))
    return images.keep_one_of_equal(x, ["book"]).select(F.col("id").alias("p_partkey"), "canonical", "copies")


RUNS = "r AS (SELECT conv_id AS line, turn AS run, CASE length(text) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE role END AS font_key, substr(text, 1, length(text) % 23 + 1) AS text FROM conversations)"


@query(
    f"""WITH {RUNS}, s AS (SELECT line, font_key, sum(length(text)) AS n, min(run) AS at_ FROM r GROUP BY ALL), b AS (SELECT line, font_key AS best FROM s QUALIFY row_number() OVER (PARTITION BY line ORDER BY n DESC, at_) = 1),
m AS (SELECT r.line, min(run) FILTER (WHERE font_key = best) AS a, max(run) FILTER (WHERE font_key = best) AS z, sum(length(text)) AS total FROM r JOIN b ON r.line = b.line GROUP BY r.line),
h AS (SELECT r.line, coalesce(sum(length(text)) FILTER (WHERE run < a), 0) AS head, coalesce(sum(length(text)) FILTER (WHERE run > z), 0) AS tail FROM r JOIN m ON r.line = m.line GROUP BY r.line),
w AS (SELECT r.*, (run < a AND head < total - head) OR (run > z AND tail < total - tail) AS alone FROM r JOIN m ON r.line = m.line JOIN h ON r.line = h.line),
g AS (SELECT *, sum(new::INT) OVER (PARTITION BY line ORDER BY run) - 1 AS part FROM (SELECT *, alone OR coalesce(lag(alone) OVER (PARTITION BY line ORDER BY run), true) AS new FROM w))
SELECT line, part::BIGINT AS part, md5(string_agg(text, '' ORDER BY run)) AS text, count(*) AS runs FROM g GROUP BY line, part"""
)
def edge_runs(spark, sf_dir):
    n = F.length("text")
    runs = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("line"), F.col("turn").alias("run"), F.when(n % 3 == 0, "A").when(n % 3 == 1, "B").otherwise(F.col("role")).alias("font_key"), F.expr("substr(text, 1, length(text) % 23 + 1)").alias("text"))
    return lines.split_edges(runs, ["line"]).select("line", "part", F.md5("text").alias("text"), "runs")


TOKENS = "tk AS (SELECT l_orderkey AS line, l_orderkey % 3 AS page, l_linenumber AS no, l_partkey::VARCHAR AS text, l_quantity * 12 AS a, l_quantity * 12 + 25 AS z FROM lineitem), ln AS (SELECT line, page, min(a) AS lo, max(z) AS hi FROM tk GROUP BY ALL), gt(page, g1, g2) AS (VALUES (0, 200.0, 215.0), (0, 400.0, 420.0), (1, 300.0, 310.0))"


@query(
    f"""WITH {TOKENS}, c AS (SELECT line, page, g1, g2 FROM ln JOIN gt USING (page) WHERE lo < g1 AND hi > g2), n AS (SELECT line, count(*) AS n FROM c GROUP BY line),
bad AS (SELECT DISTINCT c.line FROM c JOIN tk ON c.line = tk.line WHERE z > g1 AND a < g2), pl AS (SELECT tk.line, tk.page, tk.no, tk.text, tk.a, tk.z, (SELECT count(*) FROM c WHERE c.line = tk.line AND g2 <= tk.a) AS part FROM tk),
ok AS (SELECT pl.line FROM pl JOIN n ON pl.line = n.line WHERE pl.line NOT IN (FROM bad) GROUP BY pl.line, n.n HAVING count(DISTINCT part) = n.n + 1)
SELECT page, line, CASE WHEN line IN (FROM ok) THEN part END::INT AS fragment, min(a) AS min_x, max(z) AS max_x, count(*) AS words FROM pl GROUP BY page, line, CASE WHEN line IN (FROM ok) THEN part END"""
)
def gutter_repair(spark, sf_dir):
    tokens = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), (F.col("l_orderkey") % 3).alias("page"), F.struct(F.col("l_linenumber").alias("no"), F.col("l_partkey").cast("string").alias("text"), (F.col("l_quantity") * 12).alias("min_x"), (F.col("l_quantity") * 12 + 25).alias("max_x")).alias("t"))
    x = tokens.groupBy("page", "line").agg(F.array_sort(F.collect_list("t")).alias("tokens"), F.min("t.min_x").alias("min_x"), F.max("t.max_x").alias("max_x"))
    gutters = spark.createDataFrame([(0, 0.9, [(200.0, 215.0), (400.0, 420.0)]), (1, 0.85, [(300.0, 310.0)]), (2, 0.8, [(300.0, 310.0)])], "page long, confidence double, all array<struct<min_x:double,max_x:double>>")
    out = lines.repair_gutters(x, gutters, ["page"])
    return out.select("page", "line", "fragment", "min_x", "max_x", F.size(F.split("text", " ")).cast("long").alias("words"))


@query(f"WITH {ITEMS} SELECT doc_id, page::BIGINT AS page, min(x)::DOUBLE AS x0, min(y)::DOUBLE AS y0, max(x + width)::DOUBLE AS x1, (max(y) + 10)::DOUBLE AS y1, count(DISTINCT line_no) FILTER (WHERE font_key = 'Body@10') AS body_lines FROM items GROUP BY doc_id, page")
def text_bounds(spark, sf_dir):
    from ..sources.tables import text_items

    x = text_items(table(spark, sf_dir, "documents"))
    return x.groupBy("doc_id", "page").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), (F.max("y") + 10).alias("y1"), F.countDistinct(F.when(F.col("font_key") == "Body@10", F.col("line_no"))).alias("body_lines"))


@query(
    r"""SELECT doc_id, line_no, regexp_matches(line, '[.·](?:\s*[.·]){4}') AS leader, line LIKE '%-' AS hyphen, regexp_matches(line, '^\p{Ll}') AS lower_start, NOT regexp_matches(line, '\S') AND length(line) > 0 AS blank
FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"""
)
def line_marks(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    line = F.col("line")
    return x.select("doc_id", F.col("line_no").cast("long").alias("line_no"), line.rlike(r"[.·](?:\s*[.·]){4}").alias("leader"), line.endswith("-").alias("hyphen"), line.rlike(r"^\p{Ll}").alias("lower_start"), T.whitespace_only(line).alias("blank"))


@query("SELECT source, lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars, count(*) FILTER (WHERE n_chars = 0) AS empty_ones, max(doc_id) AS newest FROM documents GROUP BY ALL")
def document_facts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") == 0).alias("empty_ones"), F.max("doc_id").alias("newest"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2, length(text) DESC, turn) AS place FROM conversations")
def review_order(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy(F.floor(F.col("turn") / 2), F.desc(F.length("text")), "turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w).cast("long").alias("place"))


OPS = "op AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, l_partkey, l_quantity AS dx, l_tax * 100 AS dy, l_discount FROM lineitem)"


@query(
    f"""WITH {OPS}, s AS (SELECT *, coalesce(sum(CASE WHEN k % 2 = 1 THEN dx END) OVER w, 0) AS sx, coalesce(sum(CASE WHEN k % 2 = 1 THEN dy END) OVER w, 0) AS sy FROM op WINDOW w AS (PARTITION BY page ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT page, k * 10 + 3 AS idx, l_partkey::VARCHAR AS obj_id, round(2 * (sx + dx), 6) AS x, round(2 * (sy + dy), 6) AS y, CASE WHEN l_discount > 0 THEN round(1 - l_discount, 6) END AS opacity, k % 3 = 0 AS blended FROM s"""
)
def painted_images(spark, sf_dir):
    from pyspark.sql import Window

    from ..operators import painting

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    k, zero, one = F.col("k"), F.lit(0.0), F.lit(1.0)
    x = table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w).cast("long"))
    none = lambda kind: F.lit(None).cast(kind)

    def op(n: int, name: str, matrix=None, alpha=None, blend=None, obj=None):
        return F.struct((k * 10 + n).alias("idx"), F.lit(name).alias("op"), (matrix if matrix is not None else none("array<double>")).alias("matrix"), (alpha if alpha is not None else none("double")).alias("alpha"), (blend if blend is not None else none("string")).alias("blend"), none("string").alias("subtype"), (obj if obj is not None else none("string")).alias("obj_id"), none("double").alias("size"))

    scale = F.when(k == 1, op(-1, "transform", F.array(F.lit(2.0), zero, zero, F.lit(2.0), zero, zero)))
    steps = F.array_compact(F.array(
        scale, op(0, "save"), op(1, "transform", F.array(one, zero, zero, one, F.col("l_quantity"), F.col("l_tax") * 100)), op(2, "state", alpha=1 - F.col("l_discount"), blend=F.when(k % 3 == 0, "Multiply").otherwise("Normal")),
        op(3, "image", obj=F.col("l_partkey").cast("string")), F.when(k % 2 == 0, op(4, "restore")),
    ))
    ops = x.select(F.col("l_orderkey").alias("page"), F.inline(steps))
    e = painting.walk(ops, ["page"])
    return e.select("page", "idx", "obj_id", F.round(F.col("ctm")[4], 6).alias("x"), F.round(F.col("ctm")[5], 6).alias("y"), F.round("opacity", 6).alias("opacity"), "blended")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity * 12 + 25 <= 300 THEN 'A-Bold@10' WHEN l_quantity * 12 >= 250 AND l_quantity * 12 + 25 <= 500 THEN 'B@12' ELSE 'C@9' END AS font_key, CASE WHEN l_quantity * 12 + 25 <= 300 THEN 10.0 WHEN l_quantity * 12 >= 250 AND l_quantity * 12 + 25 <= 500 THEN 12.0 ELSE 9.0 END::DOUBLE AS font_size FROM lineitem""")
def token_fonts(spark, sf_dir):
    from ..operators import detection

    run = lambda key, size, a, z: F.struct(F.lit(key).alias("font_key"), F.lit(size).alias("size"), F.lit(a).alias("min_x"), F.lit(z).alias("max_x"))
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 12).alias("min_x"), (F.col("l_quantity") * 12 + 25).alias("max_x"), F.array(run("A-Bold@10", 10.0, 0.0, 300.0), run("B@12", 12.0, 250.0, 500.0)).alias("runs"), F.lit("C@9").alias("line_font"), F.lit(9.0).alias("line_size"))
    return detection.token_fonts(x).select("l_orderkey", "l_linenumber", "l_partkey", "font_key", "font_size")


@query("SELECT o_orderkey, c.c_nationkey AS page FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey * 2")
def outline_pages(spark, sf_dir):
    from ..operators import sections

    nodes = table(spark, sf_dir, "orders").select(F.lit(0).alias("doc"), (F.col("o_custkey") * 2).alias("dest"), "o_orderkey")
    dests = table(spark, sf_dir, "customer").select(F.lit(0).alias("doc"), F.col("c_custkey").alias("dest"), F.col("c_nationkey").alias("page"))
    return sections.resolve_outline(nodes, dests, "doc").select("o_orderkey", "page")
