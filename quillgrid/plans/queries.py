"""Named queries over the driver's tables, each with the SQL it must agree with."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import gaps, layout, records, textquality
from ..sources.tables import table, text_items

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def cls(p: str) -> str:
    return f"length(text) - length(regexp_replace(text, '{p}', '', 'g'))"


@query(
    rf"""
WITH c AS (SELECT lang, length(text) AS total_chars, {cls(r'[^\x{0000}-\x{024F}\x{2000}-\x{206F}]')} AS outside, {cls(r'\x{FFFD}')} AS replacement,
  {cls(r'[\x{E000}-\x{F8FF}]')} AS private_use, {cls(r'[\x{FB00}-\x{FB06}]')} AS ligatures, {cls(r'\x{00AD}')} AS soft_hyphens, {cls(r'[\x{0300}-\x{036F}]')} AS combining,
  list_filter(string_split_regex(text, '[ \n]'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT lang, sum(total_chars)::BIGINT AS total_chars, sum(outside)::BIGINT AS outside, sum(replacement)::BIGINT AS replacement, sum(private_use)::BIGINT AS private_use,
  sum(ligatures)::BIGINT AS ligatures, sum(soft_hyphens)::BIGINT AS soft_hyphens, sum(combining)::BIGINT AS combining, sum(len(w))::BIGINT AS words,
  sum(len(list_filter(w, lambda x: length(x) <= 2)))::BIGINT AS fragments FROM c GROUP BY lang)
SELECT *, round(CASE WHEN total_chars = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - 5 * (replacement + private_use + combining) / total_chars - outside / total_chars * 0.5)) END, 9) AS confidence,
  total_chars = 0 AS suspected_scan FROM s"""
)
def text_quality(spark, sf_dir):
    return textquality.quality_by(table(spark, sf_dir, "documents"), "lang")


ITEMS = """
l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (SELECT doc_id, line_no, unnest(range(len(string_split(line, ' ')))) AS word_no, unnest(string_split(line, ' ')) AS str, string_split(line, ' ') AS parts FROM l),
items AS (SELECT doc_id, line_no // 60 + 1 AS page, line_no, word_no, str,
  72 + 6 * CASE WHEN word_no = 0 THEN 0 ELSE length(array_to_string(parts[1:word_no], ' ')) + 1 END AS x, 792 - 12 * (line_no % 60) AS y, 6 * length(str) AS width,
  CASE WHEN line_no = 0 THEN 'Head@14' ELSE 'Body@10' END AS font_key FROM w WHERE str <> '')
"""


@query(f"WITH {ITEMS} SELECT doc_id, page::BIGINT AS page, count(*) AS items, max(x + width)::DOUBLE AS right_edge, min(y)::DOUBLE AS bottom, sum(x)::DOUBLE AS x_sum FROM items GROUP BY doc_id, page")
def page_boxes(spark, sf_dir):
    items = text_items(table(spark, sf_dir, "documents"))
    return items.groupBy("doc_id", "page").agg(F.count("*").alias("items"), F.max(F.col("x") + F.col("width")).alias("right_edge"), F.min("y").alias("bottom"), F.sum("x").alias("x_sum"))


@query(
    f"""WITH {ITEMS}, f AS (SELECT doc_id, font_key, sum(length(str))::BIGINT AS glyph_count, count(*) AS item_count, count(DISTINCT page) AS pages,
  CAST(string_split(font_key, '@')[2] AS DOUBLE) AS size FROM items GROUP BY doc_id, font_key),
b AS (SELECT doc_id, sum(glyph_count) AS total FROM f GROUP BY doc_id),
m AS (SELECT doc_id, font_key AS body, size AS bs FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY glyph_count DESC, font_key) = 1)
SELECT f.doc_id, font_key, glyph_count, item_count, pages, size, round(glyph_count / total, 9) AS share, round(size / bs, 9) AS size_ratio,
  CASE WHEN font_key = body THEN 'body' WHEN glyph_count / total < 0.05 AND size / bs > 1.2 THEN 'heading' WHEN glyph_count / total < 0.1 AND size / bs < 0.9 THEN 'caption'
    WHEN glyph_count / total < 0.05 AND size / bs BETWEEN 0.9 AND 1.2 THEN 'accent' ELSE 'unknown' END AS role FROM f JOIN b ON f.doc_id = b.doc_id JOIN m ON f.doc_id = m.doc_id"""
)
def font_roles(spark, sf_dir):
    return layout.font_roles(layout.font_registry(text_items(table(spark, sf_dir, "documents")), ["doc_id"]), ["doc_id"])


@query(
    r"""SELECT doc_id, md5(array_to_string(list_transform(string_split(replace(replace(replace(replace(replace(replace(replace(replace(text, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'st'), 'ﬆ', 'st'), chr(173), ''), chr(10)),
  lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ')), chr(10))) AS repaired, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS html_chars FROM documents"""
)
def text_repair(spark, sf_dir):
    fixed = T.normalize_whitespace(T.remove_soft_hyphens(T.expand_ligatures(F.col("text"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fixed).alias("repaired"), F.length(T.escape_html(F.col("text"), quotes=False)).cast("long").alias("html_chars"))


def event_samples(spark, sf_dir):
    """Events as items: users are pages of the documents user_id % 4, types are fonts."""
    events = table(spark, sf_dir, "events").withColumn("at", F.expr("unix_micros(CAST(ts AS TIMESTAMP)) / 1000000D"))
    return gaps.gap_samples(events, ["user_id"], "at", "event_type", tie="event_id").withColumn("doc", F.col("user_id") % 4)


def event_fonts(spark, sf_dir):
    """A size for each font of three documents; of the fourth none is known, and one has no samples."""
    fonts = table(spark, sf_dir, "events").select("event_type").distinct().withColumnRenamed("event_type", "font").crossJoin(spark.range(3).withColumnRenamed("id", "doc"))
    return fonts.select("doc", "font", F.length("font").cast("double").alias("size")).unionByName(spark.createDataFrame([(9, "none", 12.0)], "doc long, font string, size double"))


SAMPLES = """
e AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS t_at, event_type, event_id FROM events),
g AS (SELECT user_id, lag(event_type) OVER w AS font, t_at - lag(t_at) OVER w AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t_at, event_id)),
samples AS (SELECT *, user_id % 4 AS doc FROM g WHERE gap >= 0),
fonts AS (SELECT doc, event_type AS font, length(event_type)::DOUBLE AS size FROM (SELECT DISTINCT event_type FROM events), range(3) AS r(doc) UNION ALL SELECT 9, 'none', 12.0)
"""


def histogram_sql(source: str) -> str:
    """From rows with k, a key, and gap."""
    return f"""m AS (SELECT k, max(gap) AS most, count(*) AS total FROM {source} GROUP BY k HAVING max(gap) > 0),
c AS (SELECT m.k, least(47, floor(gap / (most / 48))::BIGINT) AS bin, count(*) AS n FROM {source} s JOIN m ON s.k = m.k GROUP BY ALL),
d AS (SELECT k, total, most / 48 AS width, unnest(range(48)) AS bin FROM m),
h AS (SELECT d.k, d.bin, width, total, coalesce(n, 0) AS n FROM d LEFT JOIN c ON d.k = c.k AND d.bin = c.bin),
hist AS (SELECT *, sum(n) OVER w / count(n) OVER w AS smooth FROM h WINDOW w AS (PARTITION BY k ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""


PROFILES = """
p AS (SELECT *, smooth > 0 AND smooth >= coalesce(lag(smooth) OVER w, -1) AND smooth >= coalesce(lead(smooth) OVER w, -1) AS peak FROM hist WINDOW w AS (PARTITION BY k ORDER BY bin)),
p1 AS (SELECT k, bin AS b1, smooth AS h1 FROM p WHERE peak QUALIFY row_number() OVER (PARTITION BY k ORDER BY smooth DESC, bin) = 1),
p2 AS (SELECT p.k, bin AS b2, smooth AS h2 FROM p JOIN p1 ON p.k = p1.k WHERE peak AND abs(bin - b1) >= 3 QUALIFY row_number() OVER (PARTITION BY p.k ORDER BY smooth DESC, bin) = 1),
v AS (SELECT p.k, bin AS vb, smooth AS vh FROM p JOIN p1 ON p.k = p1.k JOIN p2 ON p.k = p2.k WHERE bin BETWEEN least(b1, b2) AND greatest(b1, b2) QUALIFY row_number() OVER (PARTITION BY p.k ORDER BY smooth, bin) = 1),
x AS (SELECT n.k, n.total, n.size, CASE WHEN b2 IS NULL THEN most / 2 ELSE (vb + 0.5) * most / 48 END AS threshold,
  CASE WHEN n.total < 50 OR b2 IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - vh / least(h1, h2))) END AS separation
  FROM n LEFT JOIN m ON n.k = m.k LEFT JOIN p1 ON n.k = p1.k LEFT JOIN p2 ON n.k = p2.k LEFT JOIN v ON n.k = v.k),
prof AS (SELECT k, total, separation, total >= 50 AND separation >= 0.3 AS reliable, CASE WHEN total >= 50 AND separation >= 0.3 THEN threshold * 0.85 ELSE size * 0.25 END AS "intra",
  CASE WHEN total >= 50 AND separation >= 0.3 THEN threshold * 1.15 ELSE size * 0.6 END AS "inter" FROM x)
"""


@query(f"WITH {SAMPLES}, s1 AS (SELECT *, (doc, font) AS k FROM samples), {histogram_sql('s1')} SELECT k[1] AS doc, k[2] AS font, bin, n, total, round(smooth, 9) AS smooth FROM hist")
def gap_histogram(spark, sf_dir):
    return gaps.histogram(event_samples(spark, sf_dir), ["doc", "font"]).select("doc", "font", "bin", "n", "total", F.round("smooth", 9).alias("smooth"))


@query(
    f"""WITH {SAMPLES}, s1 AS (SELECT *, (doc, font) AS k FROM samples), {histogram_sql('s1')},
n AS (SELECT coalesce(a.k, b.k) AS k, coalesce(total, 0) AS total, coalesce(size, 1) AS size FROM (SELECT k, count(*) AS total FROM s1 GROUP BY k) a FULL JOIN (SELECT (doc, font) AS k, size FROM fonts) b ON a.k = b.k), {PROFILES}
SELECT k[1] AS doc, k[2] AS font, total, round(separation, 9) AS separation, reliable, round("intra", 3) AS "intra", round("inter", 3) AS "inter" FROM prof"""
)
def gap_profiles(spark, sf_dir):
    p = gaps.profiles(event_samples(spark, sf_dir), event_fonts(spark, sf_dir), ["doc", "font"])
    return p.select("doc", "font", "total", F.round("separation", 9).alias("separation"), "reliable", F.round("intra", 3).alias("intra"), F.round("inter", 3).alias("inter"))


LEVELS = f"""{SAMPLES}, big AS (SELECT doc, font, user_id FROM samples GROUP BY ALL HAVING count(*) >= 20),
s2 AS (SELECT gap, ('document', doc, font, NULL::BIGINT) AS k FROM samples UNION ALL SELECT gap, ('page', s.doc, s.font, s.user_id) FROM samples s JOIN big b ON s.doc = b.doc AND s.font = b.font AND s.user_id = b.user_id),
s1 AS (SELECT gap, k[1] || '|' || k[2] || '|' || k[3] || '|' || coalesce(k[4]::VARCHAR, '') AS k, k AS full_k FROM s2), {histogram_sql('s1')},
n AS (SELECT coalesce(a.k, b.k) AS k, coalesce(total, 0) AS total, coalesce(b.size, f.size, 1) AS size, coalesce(full_k, b.fk) AS full_k FROM (SELECT k, any_value(full_k) AS full_k, count(*) AS total FROM s1 GROUP BY k) a
  FULL JOIN (SELECT 'document|' || doc || '|' || font || '|' AS k, ('document', doc, font, NULL::BIGINT) AS fk, size FROM fonts) b ON a.k = b.k LEFT JOIN fonts f ON f.doc = full_k[2] AND f.font = full_k[3]), {PROFILES},
levels AS (SELECT n.full_k[1] AS level, n.full_k[2] AS doc, n.full_k[3] AS font, n.full_k[4] AS user_id, prof.total, separation, reliable, "intra", "inter" FROM prof JOIN n ON prof.k = n.k)"""


def levels_of(spark, sf_dir):
    return gaps.two_level_profiles(event_samples(spark, sf_dir), event_fonts(spark, sf_dir), ["doc", "font"], "user_id")


def rounded(df, **places):
    return df.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in df.columns])


@query(f'WITH {LEVELS} SELECT level, doc, font, user_id, total, round(separation, 9) AS separation, reliable, round("intra", 3) AS "intra", round("inter", 3) AS "inter" FROM levels')
def gap_levels(spark, sf_dir):
    return rounded(levels_of(spark, sf_dir), separation=9, intra=3, inter=3)


@query(
    f"""WITH {LEVELS}, q AS (SELECT DISTINCT doc, font, user_id FROM samples),
j AS (SELECT q.doc, q.font, q.user_id, d.reliable AND o.total IS NOT NULL AS both_, d, o FROM q JOIN levels d ON d.level = 'document' AND d.doc = q.doc AND d.font = q.font LEFT JOIN levels o ON o.level = 'page' AND o.doc = q.doc AND o.font = q.font AND o.user_id = q.user_id)
SELECT doc, font, user_id, coalesce(o.total, d.total) AS total, round(CASE WHEN both_ THEN least(d.separation, o.separation) ELSE coalesce(o.separation, d.separation) END, 9) AS separation,
  CASE WHEN both_ THEN true ELSE coalesce(o.reliable, d.reliable) END AS reliable, round(CASE WHEN both_ THEN least(d."intra", o."intra") ELSE coalesce(o."intra", d."intra") END, 3) AS "intra",
  round(CASE WHEN both_ THEN least(d."inter", o."inter") ELSE coalesce(o."inter", d."inter") END, 3) AS "inter" FROM j"""
)
def gap_effective(spark, sf_dir):
    return rounded(gaps.effective_profiles(levels_of(spark, sf_dir), event_samples(spark, sf_dir), ["doc", "font"], "user_id"), separation=9, intra=3, inter=3)


@query(
    f"""WITH {LEVELS}, fc AS (SELECT user_id % 4 AS doc, event_type AS font, count(*) AS glyphs FROM events GROUP BY ALL)
SELECT fc.doc, round(coalesce(sum(glyphs) FILTER (WHERE reliable) / nullif(sum(glyphs), 0), 0), 9) AS coverage FROM fc LEFT JOIN levels l ON l.level = 'document' AND l.doc = fc.doc AND l.font = fc.font GROUP BY fc.doc"""
)
def gap_coverage(spark, sf_dir):
    fonts = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).alias("doc"), F.col("event_type").alias("font")).agg(F.count("*").alias("glyph_count"))
    return rounded(gaps.reliable_coverage(fonts, levels_of(spark, sf_dir), ["doc"], "font"), coverage=9)


@query(f"WITH {SAMPLES} SELECT user_id, round(median(gap), 6) AS typical FROM samples GROUP BY user_id HAVING count(*) >= 3")
def typical_gaps(spark, sf_dir):
    return layout.typical_gap(event_samples(spark, sf_dir), "user_id").select("user_id", F.round("typical", 6).alias("typical"))


LINES = f"""{ITEMS}, ls AS (SELECT doc_id, page, line_no, any_value(font_key) AS font_key, min(x) AS min_x, max(x + width) AS max_x, any_value(y) AS min_y, any_value(y) + 10 AS max_y, count(*) AS words FROM items GROUP BY doc_id, page, line_no)"""


def text_lines_of(spark, sf_dir):
    items = text_items(table(spark, sf_dir, "documents"))
    return items.groupBy("doc_id", "page", "line_no").agg(F.first("font_key").alias("font_key"), F.min("x").alias("min_x"), F.max(F.col("x") + F.col("width")).alias("max_x"), F.first("y").alias("min_y"), (F.first("y") + 10).alias("max_y"), F.count("*").alias("words"))


@query(
    f"""WITH {LINES}, b AS (SELECT *, doc_id % 50 AS book, doc_id * 1000 + page AS sheet FROM ls), t AS (SELECT book, count(DISTINCT sheet) AS total FROM b GROUP BY book),
c AS (SELECT *, CASE WHEN (min_y + max_y) / 2 / 720 > 0.93 THEN 'header' WHEN (min_y + max_y) / 2 / 720 < 0.07 THEN 'footer' END AS kind, floor(min_x / 3 + 0.5) AS qx FROM b),
g AS (SELECT c.book, kind, font_key, qx, floor((max_x - min_x) / 12 + 0.5) AS w12 FROM c JOIN t ON c.book = t.book WHERE kind IS NOT NULL GROUP BY c.book, kind, font_key, qx, floor((max_x - min_x) / 12 + 0.5), total HAVING count(DISTINCT sheet) / total >= 0.3)
SELECT c.book, sheet, line_no, c.kind FROM c JOIN g ON c.book = g.book AND c.kind = g.kind AND c.font_key = g.font_key AND c.qx = g.qx AND floor((max_x - min_x) / 12 + 0.5) = g.w12"""
)
def running_lines(spark, sf_dir):
    lines = text_lines_of(spark, sf_dir).withColumn("book", F.col("doc_id") % 50).withColumn("sheet", F.col("doc_id") * 1000 + F.col("page"))
    pages = lines.select("book", "sheet").distinct().withColumn("page_height", F.lit(720.0))
    return layout.running_elements(lines, ["book"], "sheet", pages, 0.3).select("book", "sheet", "line_no", "kind")


@query(
    """WITH c AS (SELECT conv_id, turn, length(text) % 3 AS columns FROM conversations), n AS (SELECT *, lag(columns) OVER w AS before, lead(columns) OVER w AS after FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT * FROM n WHERE coalesce(before <> columns, true) AND coalesce(after <> columns, true) AND coalesce(before, after) IS NOT NULL"""
)
def column_stability(spark, sf_dir):
    counts = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 3).cast("long").alias("columns"))
    return layout.column_stability(counts, ["conv_id"], "turn", "columns")


@query(
    """WITH m AS (SELECT *, (coalesce(lag(role) OVER w <> role, true))::INT AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM m)
SELECT conv_id, island::BIGINT AS island, any_value(role) AS value, min(turn) AS first, max(turn) AS last, count(*) AS n FROM i GROUP BY conv_id, island"""
)
def role_runs(spark, sf_dir):
    return layout.islands(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query(
    """WITH s AS (SELECT conv_id, role, sum(length(text))::BIGINT AS weight, min(turn) AS t_at FROM conversations GROUP BY conv_id, role)
SELECT conv_id, role, weight FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY weight DESC, t_at) = 1"""
)
def dominant_role(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("chars", F.length("text").cast("long"))
    return layout.dominant(rows, "conv_id", "role", "chars", "turn")


SPANS = "s AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS id, epoch_us(l_shipdate) // 86400000000 AS a, epoch_us(l_shipdate) // 86400000000 + l_quantity::BIGINT AS z FROM lineitem)"


@query(
    f"""WITH {SPANS}, n AS (SELECT *, (coalesce(a >= max(z) OVER (PARTITION BY l_suppkey ORDER BY a, z, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true))::INT AS s FROM s)
SELECT l_suppkey, id, (sum(s) OVER (PARTITION BY l_suppkey ORDER BY a, z, id ROWS UNBOUNDED PRECEDING))::BIGINT AS cluster FROM n"""
)
def span_clusters(spark, sf_dir):
    day = F.expr("unix_date(CAST(l_shipdate AS DATE))").cast("long")
    spans = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), day.alias("a"), (day + F.col("l_quantity").cast("long")).alias("z"))
    return layout.overlap_clusters(spans, "l_suppkey", "a", "z", "id")


@query("SELECT p_brand, p_size, least(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC), 6)::INT AS level FROM (SELECT DISTINCT p_brand, p_size FROM part)")
def heading_levels(spark, sf_dir):
    return layout.heading_levels(table(spark, sf_dir, "part"), ["p_brand"], "p_size")


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_discount * 100 AS y0, l_quantity + 10 AS x1, l_discount * 100 + l_tax * 100 + 1 AS y1 FROM lineitem),
p AS (SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, (a.x1 - a.x0) * (a.y1 - a.y0) AS area_a, (b.x1 - b.x0) * (b.y1 - b.y0) AS area_b,
  greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS common,
  (greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0)) AS union_area, greatest(0, a.x0 - b.x1, b.x0 - a.x1) AS dx, greatest(0, a.y0 - b.y1, b.y0 - a.y1) AS dy
  FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
SELECT l_orderkey, i, j, round(common / least(area_a, area_b), 6) AS ratio, round(union_area, 6) AS union_area, round(sqrt(dx * dx + dy * dy), 6) AS gap FROM p"""
)
def rect_pairs(spark, sf_dir):
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.rect(x, y, x + 10, y + F.col("l_tax") * 100 + 1).alias("r"))
    pairs = r.select("l_orderkey", F.col("l_linenumber").alias("i"), F.col("r").alias("a")).join(r.select("l_orderkey", F.col("l_linenumber").alias("j"), F.col("r").alias("b")), "l_orderkey").where("i < j")
    a, b = F.col("a"), F.col("b")
    return pairs.select("l_orderkey", "i", "j", F.round(G.overlap_ratio(a, b), 6).alias("ratio"), F.round(G.area(G.union(a, b)), 6).alias("union_area"), F.round(G.gap_distance(a, b), 6).alias("gap"))


CHECKS = [("lineitem-order", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("order-customer", "orders", "o_custkey", "customer", "c_custkey"), ("label-document", "labels", "doc_id", "documents", "doc_id"), ("document-label", "documents", "doc_id", "labels", "doc_id")]


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS checked, count(*) FILTER (WHERE {k} NOT IN (SELECT {pk} FROM {p})) AS missing, count(*) FILTER (WHERE {k} NOT IN (SELECT {pk} FROM {p})) / greatest(count(*), 1) AS ratio FROM {c}" for n, c, k, p, pk in CHECKS))
def reference_report(spark, sf_dir):
    out = None
    for n, c, k, p, pk in CHECKS:
        one = records.invariant(n, table(spark, sf_dir, c), k, table(spark, sf_dir, p), pk)
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_key FROM events")
def next_purchase(spark, sf_dir):
    return records.next_match(table(spark, sf_dir, "events"), "user_id", "ts", "event_type = 'purchase'", "event_id").select("event_id", "next_key")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN k.n IS NULL THEN 'create' WHEN k.n = 1 THEN 'update' ELSE 'skip' END AS status FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) k ON c.c_custkey = k.o_custkey) GROUP BY status")
def import_report(spark, sf_dir):
    target = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return records.upsert_plan(table(spark, sf_dir, "customer"), target, "c_custkey").groupBy("status").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT count(*) FILTER (WHERE n_chars >= 500) AS found, count(*) FILTER (WHERE n_chars >= 500 AND quality = 1) AS "right", count(*) FILTER (WHERE quality = 1) AS wanted FROM documents JOIN labels USING (doc_id))
SELECT found, "right", wanted, round("right" / nullif(found, 0), 9) AS "precision", round("right" / nullif(wanted, 0), 9) AS recall FROM s"""
)
def label_report(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return records.precision_recall(rows, "n_chars >= 500", "quality = 1")


@query(r"""SELECT event_id, CAST(nullif(regexp_extract(props, '(\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS number, regexp_extract_all(props, '[+-]?\d+(?:\.\d+)?')[1] AS nth, coalesce(nullif(event_type, ''), 'none') AS kind FROM events""")
def parse_numbers(spark, sf_dir):
    props = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", T.parse_number(props).alias("number"), T.nth_number(props, 1).alias("nth"), T.default_value(F.col("event_type"), "none").alias("kind"))


ENTRIES = [("africa", "AF", 0), ("AMERIKA", "AM", 1), ("a-s-i-a", "AS", 2), ("Europe", "EU", 3), ("middle east!", "ME", 4), ("AFRICA", "never", 5)]
BARE = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"


@query(
    "WITH t(key, value, seq) AS (VALUES " + ", ".join(map(str, ENTRIES)) + f"""), v AS (SELECT DISTINCT r_name AS name FROM region), e AS (SELECT name, arg_min(value, seq) AS value FROM v JOIN t ON lower(trim(name)) = lower(key) GROUP BY name),
n AS (SELECT name, arg_min(value, seq) AS value FROM v JOIN t ON {BARE.format('name')} = {BARE.format('key')} GROUP BY name),
l AS (SELECT name, value, levenshtein({BARE.format('name')}, {BARE.format('key')}) AS d FROM v, t QUALIFY row_number() OVER (PARTITION BY name ORDER BY d, seq) = 1)
SELECT r_regionkey, r_name, coalesce(e.value, n.value, CASE WHEN d <= greatest(1, floor(length({BARE.format('r_name')}) * 0.25)) THEN l.value END) AS mapped,
  CASE WHEN e.value IS NOT NULL THEN 'exact' WHEN n.value IS NOT NULL THEN 'normalized' WHEN d <= greatest(1, floor(length({BARE.format('r_name')}) * 0.25)) THEN 'near' END AS match
FROM region r LEFT JOIN e ON r.r_name = e.name LEFT JOIN n ON r.r_name = n.name LEFT JOIN l ON r.r_name = l.name"""
)
def value_map(spark, sf_dir):
    entries = spark.createDataFrame(ENTRIES, "key string, value string, seq int")
    return records.value_map(table(spark, sf_dir, "region"), "r_name", entries, fuzzy=True).select("r_regionkey", "r_name", "mapped", "match")


@query("SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents QUALIFY rank <= 2")
def largest_two(spark, sf_dir):
    return records.top_n(table(spark, sf_dir, "documents"), "source", [F.desc("n_chars"), "doc_id"], 2).select("source", "doc_id", "n_chars", "rank")


@query("SELECT c_custkey, round(least(d, 360 - d), 6) AS hue FROM (SELECT c_custkey, abs(c_acctbal - 1000) % 360 AS d FROM customer)")
def hue_distances(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(G.hue_distance(F.col("c_acctbal"), F.lit(1000.0)), 6).alias("hue"))
