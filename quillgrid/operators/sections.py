"""Blocks of documents to journals and pages, and to HTML.

A block is a row with the document's columns, idx (0, 1, ... in reading order), page, kind, text.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import layout


def outline_markers(nodes: DataFrame, blocks: DataFrame, doc: str) -> DataFrame:
    """doc, title, level, start, seq: each bookmark (doc, seq, title, page, level) at the first block on its page or after it; behind the last block
    if there is none. Bookmarks without a page are left out."""
    pages = blocks.groupBy(doc, "page").agg(F.min("idx").alias("idx"), F.max("idx").alias("last"))
    known = nodes.where("page IS NOT NULL").select(doc, "seq", "title", "page", "level")
    both = known.select("*", F.lit(None).cast("long").alias("idx"), F.lit(1).alias("_node")).unionByName(pages.select(doc, F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("title"), "page", F.lit(None).cast("int").alias("level"), F.col("idx").cast("long").alias("idx"), F.lit(0).alias("_node")))
    # The least index among pages from this one on; as pages needn't ascend, it is a running minimum from the end.
    later = Window.partitionBy(doc).orderBy(F.desc("page"), "_node").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("start", F.min("idx").over(later)).where("_node = 1")
    ends = blocks.groupBy(doc).agg((F.max("idx") + 1).alias("_end"))
    return found.join(ends, doc, "left").select(doc, "title", "level", F.coalesce("start", "_end", F.lit(0)).cast("long").alias("start"), "seq")


def heading_markers(blocks: DataFrame, doc: str) -> DataFrame:
    """doc, title, level, start, seq: the blocks of kind heading (with size); a title without text is Section and its number."""
    heads = blocks.where("kind = 'heading'")
    levels = layout.heading_levels(heads, [doc], "size")
    n = F.row_number().over(Window.partitionBy(doc).orderBy("idx"))
    title = F.coalesce(F.nullif(T.trimmed(F.col("text")), F.lit("")), F.concat(F.lit("Section "), n.cast("string")))
    return heads.join(levels, [doc, "size"]).select(doc, title.alias("title"), "level", F.col("idx").cast("long").alias("start"), F.col("idx").cast("long").alias("seq"))


def assign_sections(blocks: DataFrame, markers: DataFrame, doc: str, fallback: str) -> DataFrame:
    """blocks with journal (its number in the document), journal_title, page_title and heading_level.

    Markers of the least level begin journals, those of the next level pages in them; deeper ones count for nothing. What comes before the
    first journal, or all without markers, is the fallback's. A journal's first page begins with it; one without pages is a page of its title.
    """
    least = Window.partitionBy(doc)
    m = markers.withColumn("_min", F.min("level").over(least))
    rows = m.where(F.col("level") <= F.col("_min") + 1).select(doc, F.col("start").alias("idx"), F.lit(0).alias("_block"), "seq", "title", (F.col("level") == F.col("_min")).alias("_journal"))
    rows = rows.unionByName(blocks.select(doc, F.col("idx").cast("long").alias("idx"), F.lit(1).alias("_block")), allowMissingColumns=True)
    w = Window.partitionBy(doc).orderBy("idx", "_block", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("journal", F.sum(F.coalesce(F.col("_journal"), F.lit(False)).cast("int")).over(w)).withColumn("journal_title", F.last(F.when(F.col("_journal"), F.col("title")), ignorenulls=True).over(w))
    inner = Window.partitionBy(doc, "journal").orderBy("idx", "_block", "seq")
    page = F.when(~F.col("_journal"), F.col("title"))
    rows = rows.withColumn("_own", F.last(page, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_first", F.first(page, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    title = F.coalesce("journal_title", F.lit(fallback))
    found = rows.where("_block = 1").select(doc, "idx", "journal", title.alias("journal_title"), F.coalesce("_own", "_first", title).alias("page_title"), F.when(F.col("_first").isNull(), 1).otherwise(2).alias("heading_level"))
    return blocks.join(found, [doc, "idx"])


def _one_line(text: Column) -> Column:
    return T.trimmed(F.replace(text, F.lit("\n"), F.lit(" ")))


def block_html() -> Column:
    """The markup of a block, from columns kind, text and level."""
    line, kind = _one_line(F.col("text")), F.col("kind")
    safe, tag = T.escape_html(line), F.concat(F.lit("h"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(2)))).cast("string"))
    wrap = lambda a, x, z: F.concat(F.lit(a), x, F.lit(z))
    cells = F.array_join(F.transform(F.split(F.col("text"), "\n"), lambda x: wrap("<tr><td>", T.escape_html(x), "</td></tr>")), "")
    return (
        F.when((kind == "heading") & (F.length(line) >= 3), F.concat(F.lit("<"), tag, F.lit(">"), safe, F.lit("</"), tag, F.lit(">"))).when(kind.isin("heading", "body", "marginalia"), wrap("<p>", safe, "</p>"))
        .when(kind == "sidebar", wrap('<aside class="bindery-sidebar">', safe, "</aside>")).when(kind == "caption", wrap("<figcaption>", safe, "</figcaption>")).when(kind == "table", wrap("<table><tbody>", cells, "</tbody></table>"))
        .otherwise(F.concat(F.lit('<p class="bindery-'), kind, F.lit('">'), safe, F.lit("</p>")))
    )


def figure_html() -> Column:
    """The markup of a picture, from columns src and caption."""
    caption = F.when(F.length("caption") > 0, F.concat(F.lit("<figcaption>"), T.escape_html(F.col("caption")), F.lit("</figcaption>"))).otherwise("")
    return F.concat(F.lit('<figure><img src="'), T.escape_html(F.col("src")), F.lit('" alt="">'), caption, F.lit("</figure>"))


def document_html(blocks: DataFrame, images: DataFrame, doc: str) -> DataFrame:
    """doc, html, images (their ids in order): blocks (with top and level) and pictures (doc, id, page, top, src, caption) of a page from the top, blocks first on a tie.

    Headers and footers are left out, notes on the margin come last together. A picture stands with the first stretch of its page's blocks;
    those of pages without blocks come after all others.
    """
    w = Window.partitionBy(doc).orderBy("idx")
    turn = F.coalesce(F.lag("page").over(w) != F.col("page"), F.lit(True)).cast("int")
    b = blocks.withColumn("_t", turn).withColumn("group", F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = b.groupBy(doc, "page").agg(F.min("group").alias("group"))
    parts = b.where("kind NOT IN ('header', 'footer')").select(doc, F.when(F.col("kind") == "marginalia", 2).otherwise(0).alias("last"), "group", (-F.col("top")).alias("down"), F.lit(0).alias("what"), F.col("idx").cast("long").alias("seq"), F.lit(None).cast("string").alias("id"), block_html().alias("html"))
    figures = images.join(first, [doc, "page"], "left").withColumn("seq", F.row_number().over(Window.partitionBy(doc).orderBy("id")).cast("long"))
    figures = figures.select(doc, F.when(F.col("group").isNull(), 1).otherwise(0).alias("last"), "group", F.when(F.col("group").isNotNull(), -F.col("top")).alias("down"), F.lit(1).alias("what"), "seq", F.col("id").cast("string").alias("id"), figure_html().alias("html"))
    every = parts.unionByName(figures).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("last", "group", "down", "what", "seq", "id", "html"))).alias("all"))
    joined = lambda test, by: F.array_join(F.transform(F.filter("all", test), lambda p: p["html"]), by)
    notes = joined(lambda p: p["last"] == 2, "")
    body = joined(lambda p: p["last"] < 2, "\n")
    aside = F.when(notes != "", F.concat(F.lit('<aside class="bindery-marginalia">'), notes, F.lit("</aside>")))
    ids = F.filter(F.transform("all", lambda p: p["id"]), lambda x: x.isNotNull())
    return every.select(doc, F.concat_ws("\n", F.nullif(body, F.lit("")), aside).alias("html"), ids.alias("images"))


def assemble(sectioned: DataFrame, doc: str) -> DataFrame:
    """doc, journals: array of title and pages (title, level, blocks: their idx), in order, of blocks with their sections; each block's idx says where it came from."""
    pages = sectioned.groupBy(doc, "journal", "journal_title", "page_title", "heading_level").agg(F.min("idx").alias("at"), F.array_sort(F.collect_list("idx")).alias("blocks"))
    journals = pages.groupBy(doc, "journal", "journal_title").agg(F.array_sort(F.collect_list(F.struct("at", F.col("page_title").alias("title"), F.col("heading_level").alias("level"), "blocks"))).alias("pages"))
    return journals.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("journal", F.col("journal_title").alias("title"), "pages"))).alias("journals"))


def resolve_outline(nodes: DataFrame, destinations: DataFrame, doc: str) -> DataFrame:
    """nodes (doc, dest) with page: that of their destination (doc, dest, page); null where there is none."""
    return nodes.join(destinations.groupBy(doc, "dest").agg(F.min("page").alias("page")), [doc, "dest"], "left")


def write_documents(documents: DataFrame, path: str, kind: str) -> None:
    """The documents as JSON, a folder for each value of the column `kind` (journal, scene, handout)."""
    documents.write.partitionBy(kind).mode("overwrite").json(path)
