"""Queries over lines, columns, blocks and candidates of pages."""

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import pages, regions, words
from ..sources.tables import table, text_items
from .queries import ITEMS, query

# Words of a line: a fourth word begins after white space, and headings have no reliable profile.
DECISIONS = (
    f"WITH {ITEMS}"
    + """, w1 AS (SELECT doc_id, page, line_no, word_no, str, x, y, width, font_key, CASE WHEN font_key = 'Head@14' THEN 14 ELSE 10 END AS size, word_no % 4 = 0 AS boundary FROM items),
w2 AS (SELECT *, floor(y / greatest(1, size * 0.3) + 0.5) AS r FROM w1),
w3 AS (SELECT *, lag(font_key) OVER w AS pf, lag(y) OVER w AS py, lag(x + width) OVER w AS pend, lag(size) OVER w AS ps FROM w2 WINDOW w AS (PARTITION BY doc_id, page ORDER BY r DESC, x, line_no * 100000 + word_no)),
d AS (SELECT *, CASE WHEN pf IS NULL THEN NULL WHEN pf <> font_key THEN 'different-font' WHEN boundary THEN 'word-boundary' WHEN abs(py - y) > greatest(1, ps * 0.3) THEN 'different-baseline'
  WHEN pf = 'Head@14' THEN 'unreliable-profile' WHEN x - pend < 0 THEN 'overlapping' WHEN x - pend < 7 THEN 'merged' ELSE 'gap-too-large' END AS decision FROM w3)
"""
)


def word_items(spark, sf_dir):
    items = text_items(table(spark, sf_dir, "documents")).withColumn("size", F.when(F.col("font_key") == "Head@14", 14.0).otherwise(10.0))
    idx = F.col("line_no").cast("long") * 100000 + F.col("word_no")
    return items.select("doc_id", "page", idx.alias("idx"), F.col("x").alias("along"), F.col("y").alias("cross"), "width", "size", "font_key", "str", (F.col("word_no") % 4 == 0).alias("boundary"))


def word_profiles(spark):
    return spark.createDataFrame([("Body@10", True, 7.0), ("Head@14", False, None)], "font_key string, reliable boolean, intra double")


@query(DECISIONS + "SELECT doc_id, decision, count(*) AS n FROM d GROUP BY doc_id, decision")
def merge_decisions(spark, sf_dir):
    return words.merge_decisions(word_items(spark, sf_dir), ["doc_id", "page"], word_profiles(spark)).groupBy("doc_id", "decision").agg(F.count("*").alias("n"))


@query(
    DECISIONS
    + """, t AS (SELECT *, line_no * 100000 + word_no AS idx, sum((decision IS DISTINCT FROM 'merged')::INT) OVER (PARTITION BY doc_id, page ORDER BY r DESC, x, line_no * 100000 + word_no) AS token FROM d)
SELECT doc_id, page::BIGINT AS page, token::BIGINT AS token, md5(string_agg(str, '' ORDER BY x, idx)) AS str, min(x)::DOUBLE AS along, (arg_max(x + width, x) - min(x))::DOUBLE AS width, count(*) AS items FROM t GROUP BY doc_id, page, token"""
)
def merged_words(spark, sf_dir):
    got = words.merge_words(word_items(spark, sf_dir), ["doc_id", "page"], word_profiles(spark))
    return got.select("doc_id", "page", "token", F.md5("str").alias("str"), "along", "width", "items")


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey % 300 AS x, l_quantity AS w FROM lineitem),
g AS (SELECT *, x - lag(x + w) OVER (PARTITION BY l_orderkey ORDER BY x, l_linenumber, w) AS gap FROM r),
m AS (SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE gap > 0) >= 2 THEN greatest(4 * median(gap) FILTER (WHERE gap > 0), 24) ELSE 24 END AS most FROM g GROUP BY l_orderkey)
SELECT g.l_orderkey, l_linenumber, (sum((coalesce(gap > most, true))::INT) OVER (PARTITION BY g.l_orderkey ORDER BY x, l_linenumber, w ROWS UNBOUNDED PRECEDING))::BIGINT AS segment FROM g JOIN m ON g.l_orderkey = m.l_orderkey"""
)
def row_segments(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 300).alias("x"), F.col("l_quantity").alias("w"))
    return words.row_segments(rows, ["l_orderkey"], "x", "w", "l_linenumber").select("l_orderkey", "l_linenumber", "segment")


# Orders as lines of pages: two columns, a wide line now and then, and a mark beside every third page.
LAID = """s AS (SELECT o_orderkey, o_orderkey // 64 AS page, o_orderkey % 64 AS slot FROM orders),
l AS (SELECT o_orderkey, page, CASE WHEN slot % 16 = 7 THEN 50 WHEN slot = 5 AND page % 3 = 0 THEN 600 ELSE 50 + 260 * (slot % 2) + slot % 5 END AS a,
  CASE WHEN slot % 16 = 7 THEN 530 WHEN slot = 5 AND page % 3 = 0 THEN 640 ELSE 230 + 260 * (slot % 2) + slot % 5 + slot % 40 END AS z, 740 - 12 * (slot // 2) AS y0, 750 - 12 * (slot // 2) AS y1 FROM s)"""
SPANNING = (
    LAID
    + """, b AS (SELECT page, max(z) - min(a) AS wide, count(*) AS lines, FROM l GROUP BY page),
k AS (SELECT l.*, wide > 0 AND z - a >= wide * 0.7 AS w, lines FROM l JOIN b ON l.page = b.page),
m AS (SELECT *, w AND (count(*) FILTER (WHERE w) OVER (PARTITION BY page)) <= lines / 2 AS spanning FROM k)"""
)


def laid(spark, sf_dir):
    slot, page = F.col("o_orderkey") % 64, F.floor(F.col("o_orderkey") / 64)
    wide, mark = slot % 16 == 7, (slot == 5) & (page % 3 == 0)
    left = 50 + 260 * (slot % 2) + slot % 5
    y = 740 - 12 * F.floor(slot / 2)
    a, z = F.when(wide, 50).when(mark, 600).otherwise(left), F.when(wide, 530).when(mark, 640).otherwise(left + 180 + slot % 40)
    lines = table(spark, sf_dir, "orders").select("o_orderkey", page.alias("page"), a.alias("minX"), y.alias("minY"), z.alias("maxX"), (y + 10).alias("maxY"))
    return pages.mark_spanning(lines, ["page"])


@query(f"WITH {SPANNING} SELECT o_orderkey, page, spanning FROM m")
def spanning_lines(spark, sf_dir):
    return laid(spark, sf_dir).select("o_orderkey", "page", "spanning")


GUTTERS = (
    SPANNING
    + """, c AS (SELECT * FROM m WHERE NOT spanning), x AS (SELECT page, min(a) AS x0, max(z) AS x1, max(y1) - min(y0) AS h FROM c GROUP BY page),
bins AS (SELECT page, x0, h, ceil((x1 - x0) / 2)::INT AS n, unnest(range(ceil((x1 - x0) / 2)::INT)) AS bin FROM x WHERE x1 > x0),
dens AS (SELECT bins.page, bins.x0, bins.h, bins.n, bin, count(c.page) AS d FROM bins LEFT JOIN c ON c.page = bins.page AND (c.a - x0) // 2 <= bin AND (c.z - x0) // 2 >= bin GROUP BY ALL),
low AS (SELECT *, d <= 0.05 * max(d) OVER (PARTITION BY page) AS low FROM dens),
isl AS (SELECT *, bin - row_number() OVER (PARTITION BY page ORDER BY bin) AS run FROM low WHERE low),
runs AS (SELECT page, any_value(x0) AS x0, any_value(h) AS h, min(bin) AS f, max(bin) AS t FROM isl GROUP BY page, run HAVING min(bin) > 0 AND max(bin) < any_value(n) - 1 AND max(bin) - min(bin) >= 4),
strips AS (SELECT runs.page, x0 + f * 2 AS gutter_min, x0 + (t + 1) * 2 AS gutter_max, h, coalesce(sum(c.y1 - c.y0), 0) AS covered FROM runs LEFT JOIN c ON c.page = runs.page AND c.a < x0 + (t + 1) * 2 AND x0 + f * 2 < c.z GROUP BY ALL),
gut AS (SELECT page, gutter_min, gutter_max, CASE WHEN h > 0 THEN 1 - least(1.0, covered / h) ELSE 1 END AS "empty" FROM strips WHERE h <= 0 OR 1 - least(1.0, covered / h) >= 0.7)"""
)


@query(f'WITH {GUTTERS} SELECT page, gutter_min, gutter_max, round("empty", 9) AS "empty" FROM gut')
def gutters(spark, sf_dir):
    found = pages.gutters(laid(spark, sf_dir).where("NOT spanning"), ["page"])
    return found.select("page", "gutter_min", "gutter_max", F.round("empty", 9).alias("empty"))


def page_columns(spark, sf_dir):
    lines = laid(spark, sf_dir)
    body = lines.where("NOT spanning")
    return lines, pages.drop_sparse(pages.columns(body, ["page"]), body, ["page"])


# At most one sparse column, the last, is there to drop: one step of the loop is enough here.
COLUMNS = (
    GUTTERS
    + """, edges AS (SELECT page, x0 AS e, 1 AS s FROM x UNION ALL SELECT page, gutter_max, 1 FROM gut UNION ALL SELECT page, x1, 0 FROM x UNION ALL SELECT page, gutter_min, 0 FROM gut),
cols AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY e) - 1 AS i, e AS lo, (SELECT min(f.e) FROM edges f WHERE f.page = edges.page AND f.s = 0 AND f.e > edges.e) AS hi FROM edges WHERE s = 1),
dealt AS (SELECT o_orderkey, c.page, c.y0, c.y1, i FROM c JOIN cols ON c.page = cols.page QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY least(hi, z) - greatest(lo, a) DESC, i) = 1),
share AS (SELECT cols.page, cols.i, lo, hi, coalesce(max(dealt.y1) - min(dealt.y0), 0) AS span, any_value(x.h) AS h FROM cols JOIN x ON x.page = cols.page LEFT JOIN dealt ON dealt.page = cols.page AND dealt.i = cols.i GROUP BY cols.page, cols.i, lo, hi),
kept AS (SELECT page, lo, hi, row_number() OVER (PARTITION BY page ORDER BY i) - 1 AS i FROM share WHERE (CASE WHEN h > 0 THEN span / h ELSE 0 END) >= 0.5 OR (SELECT count(*) FROM cols WHERE cols.page = share.page) = 1)"""
)


@query(f"WITH {COLUMNS} SELECT page, i::INT AS col, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM kept")
def page_column_boxes(spark, sf_dir):
    _, cols = page_columns(spark, sf_dir)
    return cols.select("page", F.posexplode("columns").alias("col", "c")).select("page", "col", F.col("c.minX").alias("lo"), F.col("c.maxX").alias("hi"))


@query(
    f"""WITH {COLUMNS}, own AS (SELECT m.*, i FROM m LEFT JOIN kept ON m.page = kept.page QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY least(hi, z) - greatest(lo, a) DESC, i) = 1),
banded AS (SELECT p.*, coalesce(i, -1) AS col, (SELECT count(*) FROM m q WHERE q.page = p.page AND q.spanning AND (q.y0 > p.y0 OR (q.y0 = p.y0 AND (NOT p.spanning OR q.o_orderkey <= p.o_orderkey)))) AS band FROM own p)
SELECT o_orderkey, band, row_number() OVER (PARTITION BY page ORDER BY band, spanning DESC, CASE WHEN spanning THEN 0 ELSE col END, y0 DESC, o_orderkey) - 1 AS position FROM banded"""
)
def line_order(spark, sf_dir):
    lines, cols = page_columns(spark, sf_dir)
    return pages.reading_order(pages.assign_columns(lines, cols, ["page"]), ["page"], "o_orderkey").select("o_orderkey", "band", "position")


# Lines of documents as one column; leading blanks indent.
BLOCKS = """WITH t AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
l AS (SELECT doc_id, line_no // 60 AS page, line_no, line, 72 + 6 * (length(line) - length(ltrim(line, ' '))) AS a, 792 - 12 * (line_no % 60) AS y, CASE WHEN line_no = 0 THEN 'Head' ELSE 'Body' END AS font FROM t WHERE line <> ''),
p AS (SELECT *, lag(y) OVER w - y AS gap, lag(a) OVER w AS pa, lag(font) OVER w AS pf FROM l WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)),
g AS (SELECT doc_id, page, CASE WHEN count(gap) >= 3 THEN median(gap) ELSE 0 END AS typical FROM p GROUP BY doc_id, page),
n AS (SELECT p.*, typical, sum((pf IS NULL OR pf <> font OR (typical > 0 AND gap > typical * 1.8) OR abs(a - pa) > 8)::INT) OVER (PARTITION BY p.doc_id, p.page ORDER BY line_no) AS block FROM p JOIN g ON p.doc_id = g.doc_id AND p.page = g.page),
b AS (SELECT doc_id, page, block, any_value(font) AS font, any_value(typical) AS typical, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS text, max(y) AS top, min(y) AS bottom,
  count(*) FILTER (WHERE length(trim(line, ' ')) BETWEEN 1 AND 40) AS short FROM n GROUP BY doc_id, page, block),
i AS (SELECT *, n_lines = 1 AND coalesce(typical <= 0 OR lag(bottom) OVER w - top > typical * 1.5, true) AND coalesce(typical <= 0 OR bottom - lead(top) OVER w > typical * 1.5, true) AS isolated FROM b WINDOW w AS (PARTITION BY doc_id, page ORDER BY block))
SELECT doc_id, page, block::BIGINT AS block, n_lines, isolated, md5(text) AS text, CASE WHEN regexp_matches(text, '[.·]{5,}') THEN 'table' WHEN n_lines >= 4 AND short / n_lines >= 0.8 THEN 'table' WHEN font = 'Head' AND n_lines = 1 AND isolated THEN 'heading'
  WHEN font = 'Body' THEN 'body' ELSE 'unknown' END AS kind FROM i"""


@query(BLOCKS)
def text_blocks(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).where("text <> ''")
    x, y = 72 + 6 * (F.length("text") - F.length(F.ltrim("text"))), (792 - 12 * (F.col("line_no") % 60)).cast("double")
    lines = lines.select(
        "doc_id", F.floor(F.col("line_no") / 60).alias("page"), F.col("line_no").alias("position"), "text", F.lit(0).alias("col"), F.when(F.col("line_no") == 0, "Head").otherwise("Body").alias("font_key"),
        y.alias("cross"), x.cast("double").alias("minX"), y.alias("minY"), (x + 6 * F.length(F.ltrim("text"))).cast("double").alias("maxX"), (y + 10).alias("maxY"),
    )
    found = pages.blocks(lines, ["doc_id", "page"]).withColumn("role", F.when(F.col("font_key") == "Head", "accent").otherwise("body"))
    return pages.classify(found).select("doc_id", "page", "block", "n_lines", "isolated", F.md5("text").alias("text"), "kind")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, coalesce(role = 'user', false) AS a, coalesce(length(text) > 200, false) AS s FROM conversations),
c AS (SELECT *, sum(a::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS candidate FROM r)
SELECT conv_id, candidate::BIGINT AS candidate, min(i) AS start, coalesce(min(i) FILTER (WHERE s AND NOT a), max(i) + 1) AS "end" FROM c WHERE candidate > 0 GROUP BY conv_id, candidate"""
)
def candidate_ranges(spark, sf_dir):
    return regions.anchor_ranges(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role = 'user'", "length(text) > 200")


@query(
    """WITH b AS (SELECT conv_id, turn, role, sum((coalesce(role = 'user', false) AND rn > 1 OR rn = 1)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS entry
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)),
g AS (SELECT *, sum(coalesce(role = 'user', false)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations),
d AS (SELECT conv_id, turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY g) AS inner_entry FROM g WHERE coalesce(role <> 'user', true))
SELECT b.conv_id, b.turn, entry::BIGINT AS entry, inner_entry::BIGINT AS inner_entry FROM b LEFT JOIN d ON b.conv_id = d.conv_id AND b.turn = d.turn"""
)
def entry_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    inner = regions.delimiter_entries(rows, "conv_id", "turn", "role = 'user'").select("conv_id", "turn", F.col("entry").cast("long").alias("inner_entry"))
    return regions.boundary_entries(rows, "conv_id", "turn", "role = 'user'").drop("role").join(inner, ["conv_id", "turn"], "left")


@query("""SELECT event_id, lower(event_type) || '#' || (row_number() OVER (PARTITION BY user_id, lower(event_type) ORDER BY event_id) - 1) AS key FROM events""")
def ordinal_keys(spark, sf_dir):
    return regions.ordinal_keys(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id").select("event_id", "key")


# Line numbers repeat within an order: a box is the union of the rows that share one.
BOXES = """r AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS x0, min(l_discount * 100) AS y0, max(l_quantity + 10) AS x1, max(l_discount * 100 + l_tax * 100 + 1) AS y1 FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def boxes(spark, sf_dir):
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    r = G.rect(F.min(x), F.min(y), F.max(x + 10), F.max(y + F.col("l_tax") * 100 + 1))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(r.alias("r"))


@query(
    f"""WITH {BOXES} SELECT a.l_orderkey, a.l_linenumber, round(least(1.0, sum(CASE WHEN b.l_linenumber IS NULL THEN 0 ELSE greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) END) / any_value((a.x1 - a.x0) * (a.y1 - a.y0))), 6) AS coverage
FROM r a LEFT JOIN r b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber > 2 WHERE a.l_linenumber <= 2 GROUP BY a.l_orderkey, a.l_linenumber"""
)
def text_coverage(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return regions.coverage(b.where("l_linenumber <= 2"), b.where("l_linenumber > 2"), "l_orderkey", "l_linenumber").withColumn("coverage", F.round("coverage", 6))


@query(
    f"""WITH {BOXES}, d AS (SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS other, CASE WHEN b.l_linenumber IS NOT NULL THEN sqrt(pow(greatest(0, a.x0 - b.x1, b.x0 - a.x1), 2) + pow(greatest(0, a.y0 - b.y1, b.y0 - a.y1), 2)) END AS gap
  FROM r a LEFT JOIN r b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber > 2 WHERE a.l_linenumber <= 2)
SELECT l_orderkey, l_linenumber, round(min(gap), 6) AS gap, (max(other) IS NOT NULL) AS found FROM d GROUP BY l_orderkey, l_linenumber"""
)
def nearest_image(spark, sf_dir):
    b = boxes(spark, sf_dir)
    got = regions.nearest(b.where("l_linenumber <= 2"), b.where("l_linenumber > 2"), "l_orderkey", "l_linenumber", "l_linenumber")
    return got.select("l_orderkey", "l_linenumber", F.round("gap", 6).alias("gap"), F.col("nearest").isNotNull().alias("found"))
