"""Queries over places on pages, and over records on their way out."""

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import imports, places
from ..sources.tables import table, text_items
from . import documents, images
from .queries import ITEMS, query, rounded

LINES, OCC = documents.LINES, images.OCC
OVER = "{a}.x0 < {b}.x1 AND {b}.x0 < {a}.x1 AND {a}.y0 < {b}.y1 AND {b}.y0 < {a}.y1"


def boxes(spark, sf_dir):
    return images.occurrences(spark, sf_dir)


@query(f"WITH {ITEMS} SELECT doc_id, page::BIGINT AS page, line_no, word_no, CASE WHEN doc_id % 3 > 0 THEN CASE font_key WHEN 'Head@14' THEN 'heading' ELSE 'body' END ELSE 'unknown' END AS role FROM items")
def item_roles(spark, sf_dir):
    items = text_items(table(spark, sf_dir, "documents"))
    roles = items.where("doc_id % 3 > 0").select("doc_id", "font_key").distinct().withColumn("role", F.when(F.col("font_key") == "Head@14", "heading").otherwise("body"))
    return places.with_role(items, roles, ["doc_id"]).select("doc_id", "page", "line_no", "word_no", "role")


PAIRS = f"""{OCC}, a AS (SELECT * FROM occ WHERE idx % 2 = 1), b AS (SELECT * FROM occ WHERE idx % 2 = 0)"""


def halves(spark, sf_dir):
    x = boxes(spark, sf_dir)
    return x.where("idx % 2 = 1").select("page", F.col("idx").alias("line"), "bbox"), x.where("idx % 2 = 0").select("page", F.col("idx").alias("seq"), F.col("bbox").alias("area"))


@query(
    f"""WITH {PAIRS}, r AS (SELECT a.page, a.idx, min(b.idx) AS region FROM a JOIN b ON a.page = b.page AND {OVER.format(a='a', b='b')} GROUP BY ALL)
SELECT a.page, a.idx AS line, r.region, EXISTS (FROM b WHERE b.page = a.page AND a.x0 - 20 < b.x1 AND b.x0 < a.x1 + 20 AND a.y0 - 20 < b.y1 AND b.y0 < a.y1 + 20) AS near,
  EXISTS (FROM b WHERE b.page = a.page) AND NOT EXISTS (FROM b WHERE b.page = a.page AND a.x0 < b.x1 AND b.x0 < a.x1) AS beside FROM a LEFT JOIN r ON a.page = r.page AND a.idx = r.idx"""
)
def block_places(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    x = places.near_pictures(places.first_region(a, b, ["page"]), b.select("page", "area"), ["page"])
    columns = b.select("page", F.col("area.minX").alias("min_x"), F.col("area.maxX").alias("max_x"))
    return places.beside_columns(x, columns, ["page"]).select("page", F.col("line").cast("long").alias("line"), F.col("region").cast("long").alias("region"), "near", "beside")


@query(f"WITH {OCC}, s AS (SELECT book, floor(x1 - x0 + 0.5) AS w, floor(y1 - y0 + 0.5) AS h, count(*) AS n FROM occ GROUP BY ALL) SELECT book, round(max(n) / sum(n), 9) AS share FROM s GROUP BY book")
def same_sizes(spark, sf_dir):
    return rounded(places.same_size_share(boxes(spark, sf_dir), ["book"]), share=9)


LOOKS = "p AS (SELECT l_suppkey % 30 AS book, l_orderkey * 10 + l_linenumber AS id, l_quantity AS spread, l_discount * 100 AS saturation, l_tax * 300 AS mean, l_shipdate AS k FROM lineitem WHERE l_linenumber = 1)"


@query(f"WITH {LOOKS}, d AS (SELECT book, spread, saturation, mean, count(*) AS n FROM p GROUP BY ALL), o AS (SELECT d.book, d.spread, d.saturation, d.mean, sum(e.n) AS every FROM d JOIN d e ON d.book = e.book AND abs(d.spread - e.spread) <= 5 AND abs(d.saturation - e.saturation) <= 7 AND abs(d.mean - e.mean) <= 9 GROUP BY ALL) SELECT p.book, p.id, every - 1 >= 25 AS repeated FROM p JOIN o USING (book, spread, saturation, mean)")
def panel_looks(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select((F.col("l_suppkey") % 30).alias("book"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("spread"), (F.col("l_discount") * 100).alias("saturation"), (F.col("l_tax") * 300).alias("mean"))
    return places.repeated_looks(p, ["book"], 25).select("book", "id", "repeated")


@query("SELECT c_nationkey, c_mktsegment FROM customer GROUP BY ALL HAVING count(*) >= 2")
def repeated_keys(spark, sf_dir):
    return places.repeated_keys(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment")


@query(
    """WITH p AS (SELECT c_nationkey AS book, c_custkey % 9 AS page, c_custkey AS id, abs(c_acctbal) / 200000 AS share, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 10 / 10 + 0.08 END AS opaque FROM customer),
g AS (SELECT book, page, count(*) AS n, count(*) FILTER (WHERE coalesce(opaque, 1) < 0.97) AS cut FROM p WHERE page <= 6 AND share <= 0.03 GROUP BY ALL) SELECT p.book, p.id, p.page <= 6 AND share <= 0.03 AND coalesce(n >= 5 AND cut >= 0.5 * n, false) AS logo FROM p LEFT JOIN g ON p.book = g.book AND p.page = g.page"""
)
def credit_logos(spark, sf_dir):
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("book"), (k % 9).alias("page"), k.alias("id"), (F.abs("c_acctbal") / 200000).alias("share"), F.when(k % 4 > 0, k % 10 / 10 + 0.08).alias("opaque"))
    return places.credit_logos(p, ["book"]).select("book", "id", "logo")


@query(
    f"""WITH {OCC}, s AS (SELECT book % 10 AS page, floor(y0 / 60) AS row, x0 * 0.5 + floor(x0 / 200) * 90 AS a, x0 * 0.5 + floor(x0 / 200) * 90 + (x1 - x0) / 10 AS z FROM occ),
l AS (SELECT page, min(a) AS lo, max(z) AS hi, count(DISTINCT row) AS rows FROM s GROUP BY page HAVING count(DISTINCT row) >= 3),
c AS (SELECT s.page, unnest(range(floor((a - lo) / 2)::BIGINT, (floor((z - lo) / 2) + 1)::BIGINT)) AS bin, row FROM s JOIN l ON s.page = l.page),
d AS (SELECT page, lo, rows, greatest(1, ceil((hi - lo) / 2))::BIGINT AS bins, unnest(range(greatest(1, ceil((hi - lo) / 2))::BIGINT)) AS bin FROM l),
n AS (SELECT d.page, lo, bins, d.bin, count(DISTINCT c.row) <= floor(any_value(rows) * 0.05) AS low FROM d LEFT JOIN c ON d.page = c.page AND d.bin = c.bin GROUP BY d.page, lo, bins, d.bin),
r AS (SELECT *, bin - row_number() OVER (PARTITION BY page ORDER BY bin) AS run FROM n WHERE low)
SELECT page, lo + min(bin) * 2 AS min_x, lo + (max(bin) + 1) * 2 AS max_x FROM r GROUP BY page, lo, bins, run HAVING min(bin) > 0 AND max(bin) + 1 < bins AND count(*) >= 3"""
)
def row_gutters(spark, sf_dir):
    x = F.col("bbox.minX") * 0.5 + F.floor(F.col("bbox.minX") / 200) * 90
    s = boxes(spark, sf_dir).select((F.col("book") % 10).alias("page"), F.floor(F.col("bbox.minY") / 60).alias("row"), x.alias("min_x"), (x + (F.col("bbox.maxX") - F.col("bbox.minX")) / 10).alias("max_x"))
    return places.row_gutters(s, ["page"])


@query("""WITH c AS (SELECT conv_id, (count(*) - 3)::INT AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN n <= 0 THEN '' ELSE array_to_string(list_sort(list_distinct([1, greatest(1, floor(n * 0.25 + 0.5)::INT), greatest(1, floor(n * 0.5 + 0.5)::INT), greatest(1, floor(n * 0.75 + 0.5)::INT), n])), ',') END AS pages FROM c""")
def sampled_pages(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.count("*") - 3).alias("n"))
    return n.select("conv_id", F.array_join(places.sample_pages(F.col("n")), ",").alias("pages"))


@query(f"WITH {OCC} SELECT page, idx FROM occ QUALIFY count(*) OVER (PARTITION BY page) <= 4")
def capped_shapes(spark, sf_dir):
    return places.capped(boxes(spark, sf_dir), ["page"], 4).select("page", F.col("idx").cast("long").alias("idx"))


TARGET = "t AS (SELECT o_custkey % 500 AS key, o_orderkey AS id, o_orderpriority AS profile FROM orders WHERE o_orderkey % 9 = 0), r AS (SELECT c_custkey AS key, CASE c_custkey % 2 WHEN 0 THEN '1-URGENT' ELSE '5-LOW' END AS profile FROM customer)"


@query(
    f"""WITH {TARGET}, m AS (SELECT key, count(*) AS n, max(id) AS one FROM t GROUP BY key), w AS (SELECT key, profile, count(*) AS own, max(id) AS mine FROM t GROUP BY ALL)
SELECT r.key, CASE WHEN n IS NULL THEN 'create' WHEN n = 1 OR own = 1 THEN 'update' ELSE 'ambiguous' END AS action, CASE WHEN n = 1 THEN one WHEN own = 1 THEN mine END AS target_id FROM r LEFT JOIN m ON r.key = m.key LEFT JOIN w ON r.key = w.key AND r.profile = w.profile"""
)
def upsert_actions(spark, sf_dir):
    t = table(spark, sf_dir, "orders").where("o_orderkey % 9 = 0").select((F.col("o_custkey") % 500).alias("key"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("profile"))
    r = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("profile"))
    return imports.upsert_actions(r, t, ["key"], "overwrite").select("key", "action", "target_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_returnflag) IN (SELECT (o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'R' ELSE 'N' END) FROM orders)")
def replaced_items(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.lit("p").alias("profile"), F.col("l_returnflag").alias("collection"), "l_orderkey", "l_linenumber", "l_partkey")
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record"), F.lit("p").alias("profile"), F.when(F.col("o_orderstatus") == "F", "R").otherwise("N").alias("collection"))
    return imports.items_to_replace(items, found).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT p_partkey, p_name || CASE WHEN k > 0 THEN '-' || k ELSE '' END || '.webp' AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k FROM part)")
def file_names(spark, sf_dir):
    return imports.unique_names(table(spark, sf_dir, "part").withColumn("ext", F.lit("webp")), "p_name", "ext", ["p_partkey"]).select("p_partkey", "name")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT doc_id FROM labels)")
def pending_rows(spark, sf_dir):
    return imports.not_done(table(spark, sf_dir, "events").select("event_id"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id")), ["event_id"])


@query("""SELECT event_id, '{"system":{"type":"' || event_type || '","hp":{"value":"' || user_id || '"}}}' AS document, event_type AS kind, user_id::VARCHAR AS hp FROM events""")
def nested_paths(spark, sf_dir):
    pairs = F.create_map(F.lit("system.type"), F.col("event_type"), F.lit("system.hp.value"), F.col("user_id").cast("string"), F.lit("a.__proto__.b"), F.lit("x"))
    x = table(spark, sf_dir, "events").select("event_id", imports.set_paths(pairs).alias("document"))
    return x.select("event_id", "document", imports.get_path(F.col("document"), "system.type").alias("kind"), imports.get_path(F.col("document"), "system.hp.value").alias("hp"))


@query("SELECT doc_id, sha256(unhex(printf('%08x%08x', n_chars, doc_id)) || encode(text)) AS hash FROM documents")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", imports.content_hash(F.col("n_chars"), F.col("doc_id"), F.encode("text", "utf-8")).alias("hash"))


@query("SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) / len(a.embedding), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_distances(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rounded(e.join(b, "vec_id").select("vec_id", imports.mean_distance(F.col("embedding"), F.col("other")).alias("distance")), distance=6)


@query("""WITH s AS (SELECT conv_id, turn, floor((turn // 4 + least(1, greatest(0, (turn % 4 + length(text) % 3) / 5.0))) / 6 * 100)::BIGINT AS percent FROM conversations)
SELECT conv_id, turn, percent FROM s QUALIFY coalesce(percent > max(percent) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)""")
def staged_progress(spark, sf_dir):
    t = F.col("turn")
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", imports.progress(F.floor(t / 4), t % 4 + F.length("text") % 3, F.lit(5), 6).alias("percent"))
    return imports.reports(s, ["conv_id"], "turn", "percent")


@query("SELECT o_orderkey, coalesce(v, m) AS hp_value, coalesce(m, v) AS hp_max FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS v, CASE WHEN o_orderkey % 4 > 1 THEN o_custkey + 5 END AS m FROM orders)")
def resource_pairs(spark, sf_dir):
    k = F.col("o_orderkey")
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 > 0, F.col("o_custkey")).alias("hp_value"), F.when(k % 4 > 1, F.col("o_custkey") + 5).alias("hp_max"))
    return imports.complete_pairs(x, "hp")


@query("""SELECT o_orderkey, coalesce(string_agg(l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus), '') AS problems, count(*) FILTER (WHERE l_returnflag = 'R') = 0 AS importable FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def importable_records(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", "error").otherwise("warning").alias("severity"), F.concat("l_returnflag", "l_linestatus").alias("code"))
    return imports.importable(table(spark, sf_dir, "orders").select("o_orderkey"), d, "o_orderkey").select("o_orderkey", F.array_join("problems", ",").alias("problems"), "importable")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'missing v' WHEN event_id % 3 = 1 THEN 'not-json' END AS problem, event_id % 3 = 2 AS valid FROM events")
def profile_checks(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat("props", F.lit("}"))).otherwise('{"k": 1, "v": [2]}')
    return imports.valid_profiles(table(spark, sf_dir, "events").select("event_id", text.alias("t")), "t", ["k", "v"]).select("event_id", "problem", "valid")


@query("""WITH f AS (SELECT c_custkey, 'p' || c_custkey % 4 AS path, c_name AS value FROM customer), t(path, value) AS (VALUES ('p0', 'zero'), ('p1', 'one'), ('q', 'base'))
SELECT g.c_custkey, g.path, coalesce(f.value, g.value) AS value FROM (SELECT c_custkey, path, value FROM customer, t) g LEFT JOIN f ON f.c_custkey = g.c_custkey AND f.path = g.path UNION ALL SELECT c_custkey, path, value FROM f WHERE path NOT IN ('p0', 'p1', 'q')""")
def template_fields(spark, sf_dir):
    f = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("p"), (F.col("c_custkey") % 4).cast("string")).alias("path"), F.col("c_name").alias("value"))
    return imports.with_template(f, spark.createDataFrame([("p0", "zero"), ("p1", "one"), ("q", "base")], "path string, value string"), "c_custkey")
