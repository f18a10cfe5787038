"""Items as they are emitted: word boundaries, duplicates, repaired text."""

import math
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from .perpage import per_page, with_field


def nfc(text: Column) -> Column:
    """Composed (normal form C); Spark has no function for it."""

    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))

    return F.pandas_udf(compose, "string")(text)


def repaired(text: Column) -> Column:
    """Composed, without ligatures and soft hyphens, in this order."""
    return T.remove_soft_hyphens(T.expand_ligatures(nfc(text)))


def word_boundaries(items: DataFrame, page: list[str]) -> DataFrame:
    """The page's columns, after, gap_start, gap_end: white space after the item of index `after` (-1: before the first); neighbours are one.

    items: the page's columns, idx, str, x, width. Empty strings are neither items nor white space.
    """
    w = Window.partitionBy(*page).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    real = ~T.whitespace_only(F.col("str"))
    marked = items.where("str <> ''").withColumn("after", F.coalesce(F.last(F.when(real, F.col("idx")), ignorenulls=True).over(w), F.lit(-1)))
    return marked.where(~real).groupBy(*page, "after").agg(F.min_by("x", "idx").alias("gap_start"), F.max(F.col("x") + F.col("width")).alias("gap_end"))


def with_boundary_counts(items: DataFrame, page: list[str]) -> DataFrame:
    """The items that are no white space, with breaks: how many stretches of it come before each on its page.

    Between two items there is a boundary if the later one's count is larger; none is between an item and one emitted before it.
    """
    w = Window.partitionBy(*page).orderBy("idx")
    blank = T.whitespace_only(F.col("str"))
    marked = items.where("str <> ''").withColumn("_blank", blank).withColumn("_new", F.col("_blank") & ~F.coalesce(F.lag("_blank").over(w), F.lit(False)))
    return marked.withColumn("breaks", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("NOT _blank").drop("_blank", "_new")


def drop_duplicates(items: DataFrame, page: list[str]) -> DataFrame:
    """items without repeats among the next three of their page, with bold: whether a copy shifted by under half a point was one.

    In order of idx, an item takes the first of the next three that no other has taken and that equals it in str and
    matrix (a..f), or in all but a shift; one taken is gone and takes none. Pages go to tasks whole.
    """
    items = items.drop("bold")
    schema, names = with_field(items, "bold", "boolean"), items.columns

    def work(t: dict[str, list]) -> list[tuple]:
        text, where = t["str"], list(zip(*(t[c] for c in "abcd"), strict=True))
        x, y, n = t["e"], t["f"], len(t["str"])
        gone, bold = set(), [False] * n
        for i in range(n):
            if i in gone:
                continue
            for j in range(i + 1, min(n, i + K.DUPLICATE_LOOKAHEAD + 1)):
                if j not in gone and text[j] == text[i] and where[j] == where[i]:
                    far = math.hypot(x[j] - x[i], y[j] - y[i])
                    if far < K.BOLD_MAX_SHIFT:
                        gone.add(j)
                        bold[i] = far > 0
                        break
        rows = zip(*(t[c] for c in names), bold, strict=True)
        return [r for k, r in enumerate(rows) if k not in gone]

    return per_page(items, page, ["idx"], schema, work)


def clean(items: DataFrame, page: list[str]) -> DataFrame:
    """The items that stay, with breaks, bold and their repaired str."""
    return drop_duplicates(with_boundary_counts(items, page), page).withColumn("str", repaired(F.col("str")))


def page_metrics(cleaned: DataFrame, page: list[str]) -> DataFrame:
    """The page's columns, items, bold_items, fragmentation (share of items of one or two characters), chars."""
    n = F.length(T.trimmed(F.col("str")))
    return cleaned.groupBy(*page).agg(
        F.count("*").alias("items"), F.count_if("bold").alias("bold_items"), F.avg(n.between(1, 2).cast("double")).alias("fragmentation"), F.sum(F.length("str")).alias("chars"),
    )
