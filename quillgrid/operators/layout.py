"""Fonts, running elements, islands, clusters, headings."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def font_registry(items: DataFrame, book: list[str]) -> DataFrame:
    """The book's columns, font_key, glyph_count, item_count, pages, size of positioned items (page, str, font_key)."""
    return items.groupBy(*book, "font_key").agg(F.sum(F.length("str")).alias("glyph_count"), F.count("*").alias("item_count"), F.countDistinct("page").alias("pages")).withColumn("size", F.regexp_extract("font_key", "@([0-9.]+)$", 1).cast("double"))


def font_roles(fonts: DataFrame, book: list[str]) -> DataFrame:
    """fonts with share, size_ratio and role, each book by itself: body is the font of most glyphs (ties: the first key)."""
    whole = Window.partitionBy(*book)
    ranked = fonts.withColumn("_k", -F.dense_rank().over(whole.orderBy("font_key")))
    first = F.max(F.struct("glyph_count", "_k", "font_key", "size")).over(whole)
    x = ranked.withColumn("body", first).withColumn("total", F.sum("glyph_count").over(whole))
    x = x.withColumn("share", F.col("glyph_count") / F.col("total")).withColumn("size_ratio", F.col("size") / F.coalesce(F.nullif(F.col("body.size"), F.lit(0.0)), F.lit(1.0)))
    role = (
        F.when(F.col("total") == 0, "unknown").when(F.col("font_key") == F.col("body.font_key"), "body")
        .when((F.col("share") < 0.05) & (F.col("size_ratio") > 1.2), "heading").when((F.col("share") < 0.1) & (F.col("size_ratio") < 0.9), "caption")
        .when((F.col("share") < 0.05) & F.col("size_ratio").between(0.9, 1.2), "accent").otherwise("unknown")
    )
    return x.select(*book, "font_key", "glyph_count", "item_count", "pages", "size", F.round("share", 9).alias("share"), F.round("size_ratio", 9).alias("size_ratio"), role.alias("role"))


def running_elements(lines: DataFrame, book: list[str], page: str, pages: DataFrame, fraction: float = K.RUNNING_PAGE_FRACTION) -> DataFrame:
    """lines with kind, header or footer: those in a margin band whose font, left edge (in steps of 3 points) and width (of 12) come on at least
    `fraction` of the book's pages (pages: book, page, page_height). Texts aren't compared, as page numbers change.

    lines: the book's columns, page, font_key, min_x, max_x, min_y, max_y.
    """
    total = pages.groupBy(*book).agg(F.countDistinct(page).alias("_total"))
    x = lines.join(pages.where("page_height > 0").select(*book, page, "page_height"), [*book, page])
    place = (F.col("min_y") + F.col("max_y")) / 2 / F.col("page_height")
    x = x.withColumn("kind", F.when(place > K.HEADER_BAND, "header").when(place < K.FOOTER_BAND, "footer")).where("kind IS NOT NULL")
    step = lambda v, by: F.floor(v / by + 0.5)
    x = x.withColumn("_x", step(F.col("min_x"), K.RUNNING_POSITION_STEP)).withColumn("_w", step(F.col("max_x") - F.col("min_x"), K.RUNNING_WIDTH_STEP))
    group = [*book, "kind", "font_key", "_x", "_w"]
    often = x.groupBy(*group).agg(F.countDistinct(page).alias("_pages")).join(total, book).where(F.col("_pages") / F.col("_total") >= fraction).select(*group)
    return x.join(often, group, "left_semi").drop("_x", "_w", "page_height")


def column_stability(counts: DataFrame, book: list[str], page: str, count: str) -> DataFrame:
    """The pages whose column count is neither that of the page before nor after, with both; a book of one page has none."""
    w = Window.partitionBy(*book).orderBy(page)
    x = counts.withColumn("before", F.lag(count).over(w)).withColumn("after", F.lead(count).over(w))
    same = F.coalesce(F.col("before") == F.col(count), F.lit(False)) | F.coalesce(F.col("after") == F.col(count), F.lit(False))
    return x.where(~same & F.coalesce("before", "after").isNotNull())


def islands(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """group, island, value, first, last, n: runs of rows with one value."""
    w = Window.partitionBy(group).orderBy(order)
    starts = F.coalesce(F.lag(value).over(w) != F.col(value), F.lit(True)).cast("int")
    marked = rows.withColumn("_s", starts).withColumn("island", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(group, "island").agg(F.first(value).alias("value"), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def overlap_clusters(spans: DataFrame, group: str, start: str, end: str, key: str) -> DataFrame:
    """group, key, cluster: spans linked by strict overlap, however many between; a cluster is numbered by its place in the group."""
    w = Window.partitionBy(group).orderBy(start, end, key)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col(start) >= reach, F.lit(True)).cast("int")
    return spans.withColumn("_n", new).select(group, key, F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cluster"))


def heading_levels(fonts: DataFrame, book: list[str], size: str) -> DataFrame:
    """The book's columns, its sizes and their levels: the largest is 1, none above 6. One row a distinct size."""
    sizes = fonts.select(*book, size).distinct()
    return sizes.withColumn("level", F.least(F.dense_rank().over(Window.partitionBy(*book).orderBy(F.desc(size))), F.lit(K.MAX_HEADING_LEVEL)))


def dominant(rows: DataFrame, group: str, value: str, weight: str, order: str) -> DataFrame:
    """group, value, weight: the value of most weight; of equal ones the first seen."""
    sums = rows.groupBy(group, value).agg(F.sum(weight).alias("weight"), F.min(order).alias("_at"))
    return sums.groupBy(group).agg(F.max_by(F.struct(value, "weight"), F.struct("weight", -F.col("_at"))).alias("m")).select(group, f"m.{value}", "m.weight")


def typical_gap(samples: DataFrame, group: str) -> DataFrame:
    """group, typical: the median gap of groups with at least 3."""
    return samples.groupBy(group).agg(F.count("*").alias("n"), F.percentile("gap", 0.5).alias("typical")).where(F.col("n") >= K.MIN_MEDIAN_SAMPLES).drop("n")
