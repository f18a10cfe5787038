"""Queries over sections, HTML, and records found by a profile; conversations are documents of blocks or lines."""

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import detection, sections
from ..sources.tables import table
from .queries import query, rounded

BLOCKS = """blocks AS (SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, turn // 2 + 1 AS page,
  CASE WHEN length(text) % 13 = 0 THEN 'header' WHEN length(text) % 11 = 0 THEN 'marginalia' WHEN length(text) % 7 = 0 THEN 'table' WHEN length(text) % 5 = 0 THEN 'sidebar' WHEN length(text) % 3 = 0 THEN 'note' WHEN role = 'user' THEN 'heading' ELSE 'body' END AS kind,
  CASE WHEN length(text) % 17 = 0 THEN ' ' ELSE substr(text, 1, 30) || ' <&> ' END AS text, length(text) % 4 + 10 AS size, 700 - turn % 2 * 100 AS top FROM conversations)"""


def blocks(spark, sf_dir):
    from pyspark.sql import Window

    n = F.length("text")
    kind = F.when(n % 13 == 0, "header").when(n % 11 == 0, "marginalia").when(n % 7 == 0, "table").when(n % 5 == 0, "sidebar").when(n % 3 == 0, "note").when(F.col("role") == "user", "heading").otherwise("body")
    idx = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    text = F.when(n % 17 == 0, " ").otherwise(F.concat(F.substring("text", 1, 30), F.lit(" <&> ")))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), idx.alias("idx"), (F.floor(F.col("turn") / 2) + 1).alias("page"), kind.alias("kind"), text.alias("text"), (n % 4 + 10).alias("size"), (700 - F.col("turn") % 2 * 100).alias("top"))


NODES = "nodes AS (SELECT conv_id AS doc, turn AS seq, 'T' || turn AS title, CASE WHEN turn % 3 <> 1 THEN turn + 1 END AS page, (turn % 3 + 1)::INT AS level FROM conversations WHERE turn % 2 = 0)"
OUTLINE = f"""{BLOCKS}, {NODES}, marks AS (SELECT n.doc, n.title, n.level, coalesce((SELECT min(idx) FROM blocks b WHERE b.doc = n.doc AND b.page >= n.page), (SELECT count(*) FROM blocks b WHERE b.doc = n.doc)) AS start, n.seq FROM nodes n WHERE n.page IS NOT NULL)"""


def nodes(spark, sf_dir):
    t = F.col("turn")
    return table(spark, sf_dir, "conversations").where("turn % 2 = 0").select(F.col("conv_id").alias("doc"), t.alias("seq"), F.concat(F.lit("T"), t.cast("string")).alias("title"), F.when(t % 3 != 1, t + 1).alias("page"), (t % 3 + 1).cast("int").alias("level"))


@query(f"WITH {OUTLINE} SELECT doc, title, level, start::BIGINT AS start, seq FROM marks")
def outline_markers(spark, sf_dir):
    return sections.outline_markers(nodes(spark, sf_dir), blocks(spark, sf_dir), "doc")


HEADS = f"""{BLOCKS}, marks AS (SELECT doc, coalesce(nullif(trim(text), ''), 'Section ' || row_number() OVER (PARTITION BY doc ORDER BY idx)) AS title, least(dense_rank() OVER (PARTITION BY doc ORDER BY size DESC), 6) AS level, idx AS start, idx AS seq FROM blocks WHERE kind = 'heading')"""


@query(f"WITH {HEADS} SELECT doc, title, level::INT AS level, start::BIGINT AS start, seq::BIGINT AS seq FROM marks")
def heading_markers(spark, sf_dir):
    return sections.heading_markers(blocks(spark, sf_dir), "doc")


def sections_sql(marks: str) -> str:
    return f"""WITH {marks}, lv AS (SELECT doc, min(level) AS low FROM marks GROUP BY doc), jm AS (SELECT m.*, row_number() OVER (PARTITION BY m.doc ORDER BY start, seq) AS no FROM marks m JOIN lv ON m.doc = lv.doc WHERE level = low),
pm AS (SELECT m.* FROM marks m JOIN lv ON m.doc = lv.doc WHERE level = low + 1),
j AS (SELECT b.doc, b.idx, max(jm.no) AS no FROM blocks b LEFT JOIN jm ON b.doc = jm.doc AND jm.start <= b.idx GROUP BY b.doc, b.idx),
r AS (SELECT j.doc, j.idx, coalesce(j.no, 0) AS journal, jm.title AS jt, coalesce(jm.start, 0) AS lo, coalesce(nx.start, 1000000000) AS hi FROM j LEFT JOIN jm ON j.doc = jm.doc AND j.no = jm.no LEFT JOIN jm nx ON j.doc = nx.doc AND nx.no = coalesce(j.no, 0) + 1),
p AS (SELECT r.doc, r.idx, arg_max(pm.title, (pm.start, pm.seq)) FILTER (WHERE pm.start <= r.idx) AS own, arg_min(pm.title, (pm.start, pm.seq)) AS first_ FROM r LEFT JOIN pm ON pm.doc = r.doc AND pm.start >= r.lo AND pm.start < r.hi GROUP BY r.doc, r.idx)
SELECT r.doc, r.idx, journal::BIGINT AS journal, coalesce(jt, 'Rest') AS journal_title, coalesce(own, first_, jt, 'Rest') AS page_title, CASE WHEN first_ IS NULL THEN 1 ELSE 2 END AS heading_level FROM r JOIN p ON r.doc = p.doc AND r.idx = p.idx"""


@query(sections_sql(HEADS))
def journal_sections(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return sections.assign_sections(b, sections.heading_markers(b, "doc"), "doc", "Rest").select("doc", "idx", "journal", "journal_title", "page_title", "heading_level")


ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(
    f"""WITH {BLOCKS}, f AS (SELECT *, {ESC.format("trim(replace(text, chr(10), ' '))")} AS safe, trim(replace(text, chr(10), ' ')) AS one FROM blocks),
h AS (SELECT doc, page, idx, top, kind, CASE WHEN kind = 'heading' AND length(one) >= 3 THEN '<h' || least(6, greatest(1, size - 9)) || '>' || safe || '</h' || least(6, greatest(1, size - 9)) || '>' WHEN kind IN ('heading', 'body', 'marginalia') THEN '<p>' || safe || '</p>'
  WHEN kind = 'sidebar' THEN '<aside class="bindery-sidebar">' || safe || '</aside>' WHEN kind = 'table' THEN '<table><tbody>' || array_to_string(list_transform(string_split({ESC.format('text')}, chr(10)), lambda x: '<tr><td>' || x || '</td></tr>'), '') || '</tbody></table>'
  ELSE '<p class="bindery-' || kind || '">' || safe || '</p>' END AS html FROM f),
im AS (SELECT conv_id AS doc, turn AS id, turn + 1 AS page, 650 AS top, '<figure><img src="a&amp;' || turn || '" alt="">' || CASE WHEN turn % 4 = 0 THEN '<figcaption>' || role || '</figcaption>' ELSE '' END || '</figure>' AS html FROM conversations WHERE turn % 2 = 0),
pt AS (SELECT doc, 0 AS last, page, -top AS down, 0 AS what, idx AS seq, NULL::BIGINT AS id, html FROM h WHERE kind NOT IN ('header', 'footer', 'marginalia')
  UNION ALL SELECT im.doc, CASE WHEN EXISTS (FROM blocks b WHERE b.doc = im.doc AND b.page = im.page) THEN 0 ELSE 1 END, page, CASE WHEN EXISTS (FROM blocks b WHERE b.doc = im.doc AND b.page = im.page) THEN -top END, 1, id, id, html FROM im),
n AS (SELECT doc, string_agg(html, '' ORDER BY page, -top, idx) AS notes FROM h WHERE kind = 'marginalia' GROUP BY doc),
d AS (SELECT doc, string_agg(html, chr(10) ORDER BY last, CASE WHEN last = 0 THEN page END, down, what, seq) AS body, string_agg(id::VARCHAR, ',' ORDER BY last, CASE WHEN last = 0 THEN page END, down, what, seq) FILTER (WHERE id IS NOT NULL) AS images FROM pt GROUP BY doc)
SELECT d.doc, md5(body || CASE WHEN notes IS NOT NULL THEN chr(10) || '<aside class="bindery-marginalia">' || notes || '</aside>' ELSE '' END) AS html, images FROM d LEFT JOIN n ON d.doc = n.doc"""
)
def document_html(spark, sf_dir):
    t = F.col("turn")
    images = table(spark, sf_dir, "conversations").where("turn % 2 = 0").select(F.col("conv_id").alias("doc"), t.alias("id"), (t + 1).alias("page"), F.lit(650).cast("long").alias("top"), F.concat(F.lit("a&"), t.cast("string")).alias("src"), F.when(t % 4 == 0, F.col("role")).alias("caption"))
    out = sections.document_html(blocks(spark, sf_dir).withColumn("level", F.col("size") - 9), images, "doc")
    return out.select("doc", F.md5("html").alias("html"), F.array_join("images", ",").alias("images"))


LINES = """ln AS (SELECT conv_id AS doc, turn // 3 + 1 AS page, turn % 2 AS col, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 3, turn % 2, turn) AS pos, role || ': ' || substr(text, 1, 20) || ' HP: ' || length(text) || ' AC ' || length(text) % 20 AS text,
  length(text) % 5 + 8.0 AS font_size, length(text) % 2 = 0 AS bold, turn % 2 * 300.0 AS x0, 700 - turn * 40.0 AS y0, turn % 2 * 300 + 200.0 AS x1, 700 - turn * 40 + 10.0 + length(text) % 3 * 10 AS y1 FROM conversations)"""


def lines(spark, sf_dir):
    from pyspark.sql import Window

    t, n = F.col("turn"), F.length("text")
    third = F.floor(t / 3)
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(third, t % 2, t))
    text = F.concat("role", F.lit(": "), F.substring("text", 1, 20), F.lit(" HP: "), n.cast("string"), F.lit(" AC "), (n % 20).cast("string"))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc"), (third + 1).alias("page"), (t % 2).alias("column"), pos.alias("pos"), text.alias("text"), (n % 5 + 8.0).alias("font_size"), (n % 2 == 0).alias("bold"),
        G.rect(t % 2 * 300, 700 - t * 40, t % 2 * 300 + 200, 700 - t * 40 + 10 + n % 3 * 10).alias("bbox"),
    )


def candidate_sql(anchor: str, stop: str) -> str:
    return f"""{LINES}, an AS (SELECT *, {anchor} AS anchor FROM ln), cd AS (SELECT *, sum(anchor::INT) OVER (PARTITION BY doc ORDER BY pos) - 1 AS candidate FROM an QUALIFY candidate >= 0),
st AS (SELECT *, {stop} AS stop FROM cd WINDOW w AS (PARTITION BY doc, candidate ORDER BY pos)), kept AS (SELECT * FROM st QUALIFY max(stop::INT) OVER (PARTITION BY doc, candidate ORDER BY pos) = 0)"""


REGIONS = """, rg AS (SELECT *, sum(turn_::INT) OVER (PARTITION BY doc, candidate ORDER BY pos) - 1 AS region FROM (SELECT *, coalesce(lag((page, col)) OVER (PARTITION BY doc, candidate ORDER BY pos) <> (page, col), true) AS turn_ FROM kept))
SELECT doc, candidate::BIGINT AS candidate, region::BIGINT AS region, any_value(page) AS page, count(*) AS lines, min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, max(x1)::DOUBLE AS x1, max(y1)::DOUBLE AS y1 FROM rg GROUP BY doc, candidate, region"""


def region_rows(found):
    return detection.regions(found, "doc").select("doc", "candidate", "region", "page", "lines", F.col("bbox.minX").alias("x0"), F.col("bbox.minY").alias("y0"), F.col("bbox.maxX").alias("x1"), F.col("bbox.maxY").alias("y1"))


@query(f"WITH {candidate_sql('contains(text, $$user:$$)', 'first_value((page, col)) OVER w <> (page, col)')}{REGIONS}")
def column_regions(spark, sf_dir):
    x = detection.is_anchor(lines(spark, sf_dir), ["doc", "page"], pattern=" user: ")
    return region_rows(detection.candidates(x, "doc", boundary="endOfColumnOrPage"))


@query(f"WITH {candidate_sql('font_size = max(font_size) OVER (PARTITION BY doc, page) AND font_size >= 9', 'coalesce((lag((page, col)) OVER w = (page, col)) AND lag(y0) OVER w - y1 > 55, false)')}{REGIONS}")
def gap_regions(spark, sf_dir):
    x = detection.is_anchor(lines(spark, sf_dir), ["doc", "page"], heading={"min_size": 9, "largest": True})
    return region_rows(detection.candidates(x, "doc", boundary="verticalGap", gap=55))


VALUES = r"""SELECT doc, candidate, arg_min(hp, pos) FILTER (WHERE hp IS NOT NULL) AS hp, arg_min(ac, pos) FILTER (WHERE ac IS NOT NULL) AS ac, arg_min(usr, pos) FILTER (WHERE usr IS NOT NULL) AS usr FROM (SELECT *, CASE WHEN regexp_matches(text, '(?:^|\s)HP\s*:?(?:\s|$)') THEN regexp_extract(text, '(?:^|\s)HP\s*:?\s+(.*?)\s+AC', 1) END AS hp,
  CASE WHEN regexp_matches(text, '(?:^|\s)AC\s*:?(?:\s|$)') THEN trim(regexp_extract(text, '(?:^|\s)AC\s*:?\s+(.*)$', 1)) END AS ac, CASE WHEN regexp_matches(text, '(?:^|\s)user\s*:?(?:\s|$)') THEN trim(regexp_extract(text, '(?:^|\s)user\s*:?\s+((?s:.*?))\s+HP', 1)) END AS usr FROM kept) GROUP BY doc, candidate"""


@query(f"WITH {candidate_sql('contains(text, $$user:$$)', 'anchor IS FALSE AND font_size = 12')}, v AS ({VALUES}) SELECT doc, candidate::BIGINT AS candidate, hp, ac, md5(usr) AS usr, round(((hp IS NOT NULL)::INT + (ac IS NOT NULL)::INT + (usr IS NOT NULL)::INT) / 4, 6) AS confidence FROM v")
def field_values(spark, sf_dir):
    x = detection.is_anchor(lines(spark, sf_dir), ["doc", "page"], pattern="user:")
    x = x.withColumn("text", F.when(~F.col("anchor") & (F.col("font_size") == 12), "END").otherwise(F.col("text")))
    found = detection.candidates(x, "doc", boundary="endLabel", label="END")
    values = detection.label_fields(found, "doc", {"hp": "HP:", "ac": "AC", "usr": "user", "none": "Speed"})
    return rounded(detection.confidence(values, ["hp", "none"], ["ac", "usr"]).select("doc", "candidate", "hp", "ac", F.md5("usr").alias("usr"), "confidence"), confidence=6)


@query(
    f"""WITH {LINES}, a AS (SELECT doc, min(x0) AS ax, min(y0) AS ay, max(x1) AS bx, max(y1) AS by_ FROM ln GROUP BY doc)
SELECT ln.doc, pos FROM ln JOIN a ON ln.doc = a.doc WHERE (x0 + x1) / 2 BETWEEN ax AND ax + (bx - ax) * 0.5 AND (y0 + y1) / 2 BETWEEN ay + (by_ - ay) * 0.25 AND by_"""
)
def region_elements(spark, sf_dir):
    x = lines(spark, sf_dir)
    area = x.groupBy("doc").agg(G.rect(F.min("bbox.minX"), F.min("bbox.minY"), F.max("bbox.maxX"), F.max("bbox.maxY")).alias("area"))
    return detection.in_region(x, area, ["doc"], (0, 0.25, 0.5, 1)).select("doc", "pos")


@query(f"WITH {LINES}, s AS (SELECT * FROM ln WHERE bold AND font_size >= 9) SELECT doc, pos FROM s QUALIFY abs(font_size - max(font_size) OVER (PARTITION BY doc)) <= 0.01")
def largest_bold(spark, sf_dir):
    return detection.styled(lines(spark, sf_dir), ["doc"], min_size=9, bold=True, largest=True).select("doc", "pos")


@query(
    f"""WITH {LINES}, c(k, a, b) AS (VALUES (0, 0, 90), (1, 140, 250), (2, 350, 380)), d AS (SELECT doc, pos, page, k, greatest(a - (x0 + x1 + pos * 30) / 2, (x0 + x1 + pos * 30) / 2 - b, 0) AS off FROM ln, c WHERE page <> 2)
SELECT doc, pos, k::INT AS col FROM d QUALIFY row_number() OVER (PARTITION BY doc, pos ORDER BY off, k) = 1 UNION ALL SELECT doc, pos, 0 FROM ln WHERE page = 2"""
)
def element_columns(spark, sf_dir):
    x = lines(spark, sf_dir).withColumn("bbox", G.rect(F.col("bbox.minX") + F.col("pos") * 15, F.col("bbox.minY"), F.col("bbox.maxX") + F.col("pos") * 15, F.col("bbox.maxY"))).drop("column")
    columns = x.where("page <> 2").select("doc", "page").distinct().crossJoin(spark.createDataFrame([(0, 0.0, 90.0), (1, 140.0, 250.0), (2, 350.0, 380.0)], "column int, min_x double, max_x double"))
    return detection.nearest_column(x, columns, ["doc", "page"]).select("doc", "pos", F.col("column").alias("col"))


@query(f"""WITH sec AS ({sections_sql(HEADS)}), p AS (SELECT doc, journal, journal_title, page_title, heading_level, min(idx) AS at_, string_agg(idx::VARCHAR, '+' ORDER BY idx) AS bl FROM sec GROUP BY ALL),
j AS (SELECT doc, journal, md5(any_value(journal_title) || string_agg(page_title || heading_level || ':' || bl, '|' ORDER BY at_)) AS digest FROM p GROUP BY doc, journal) SELECT doc, count(*) AS n, string_agg(digest, ',' ORDER BY journal) AS journals FROM j GROUP BY doc""")
def assembled_documents(spark, sf_dir):
    b = blocks(spark, sf_dir)
    out = sections.assemble(sections.assign_sections(b, sections.heading_markers(b, "doc"), "doc", "Rest"), "doc")
    page = lambda p: F.concat(p["title"], p["level"].cast("string"), F.lit(":"), F.array_join(F.transform(p["blocks"], lambda i: i.cast("string")), "+"))
    digest = F.transform("journals", lambda j: F.md5(F.concat(j["title"], F.array_join(F.transform(j["pages"], page), "|"))))
    return out.select("doc", F.size("journals").cast("long").alias("n"), F.array_join(digest, ",").alias("journals"))
