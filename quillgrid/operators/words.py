"""Items that continue a word, and rows that fall into columns."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def baseline_tolerance(size: Column) -> Column:
    return F.greatest(F.lit(1.0), size * K.BASELINE_RATIO)


def merge_decisions(items: DataFrame, page: list[str], profiles: DataFrame) -> DataFrame:
    """items with decision: why each does or doesn't continue the item before it; null for a page's first.

    items: the page's columns (with the angle, if there are several), idx, along, cross, width, size, font_key and
    boundary (white space stands before the item). profiles: font_key, reliable, intra; a font without one is
    unreliable. Items are taken by baselines from the top, then along them; ties by idx. Overlapping items stay apart.
    """
    x = items.join(profiles.select("font_key", "reliable", "intra"), "font_key", "left")
    w = Window.partitionBy(*page).orderBy(F.desc("_row"), "along", "idx")
    x = x.withColumn("_row", F.floor(F.col("cross") / baseline_tolerance(F.col("size")) + 0.5))
    prev = F.lag(F.struct("font_key", "cross", "size", (F.col("along") + F.col("width")).alias("end"), "reliable", "intra")).over(w)
    x = x.withColumn("_p", prev)
    p, gap = (lambda c: F.col(f"_p.{c}")), F.col("along") - F.col("_p.end")
    decision = (
        F.when(F.col("_p").isNull(), None).when(~p("font_key").eqNullSafe(F.col("font_key")), "different-font").when(F.col("boundary"), "word-boundary")
        .when(F.abs(p("cross") - F.col("cross")) > baseline_tolerance(p("size")), "different-baseline")
        .when(~F.coalesce(p("reliable"), F.lit(False)), "unreliable-profile").when(gap < 0, "overlapping")
        .when(gap < p("intra"), "merged").otherwise("gap-too-large")
    )
    return x.withColumn("decision", decision).drop("_p", "reliable", "intra")


def merge_words(items: DataFrame, page: list[str], profiles: DataFrame) -> DataFrame:
    """The page's columns, token, str, along, cross, width, font_key, items, merged: runs of items that continue each other.

    token counts a page's tokens from 1 in the order of merge_decisions.
    """
    w = Window.partitionBy(*page).orderBy(F.desc("_row"), "along", "idx").rowsBetween(Window.unboundedPreceding, 0)
    marked = merge_decisions(items, page, profiles).withColumn("token", F.sum(F.when(F.col("decision") == "merged", 0).otherwise(1)).over(w))
    end = F.max_by(F.col("along") + F.col("width"), F.struct("along", "idx"))
    parts = F.array_sort(F.collect_list(F.struct("along", "idx", "str")))
    return marked.groupBy(*page, "token").agg(
        F.array_join(F.transform(parts, lambda p: p["str"]), "").alias("str"), F.min("along").alias("along"), F.min_by("cross", F.struct("along", "idx")).alias("cross"),
        (end - F.min("along")).alias("width"), F.first("font_key").alias("font_key"), F.count("*").alias("items"), (F.count("*") > 1).alias("merged"),
    )


def row_segments(rows: DataFrame, row: list[str], x: str, width: str, key: str) -> DataFrame:
    """rows with gap and segment (from 1): a row is split where the gap is above 4 medians of its positive gaps and above 24 points; with fewer than two such gaps, above 24.

    Rows are ordered by x, key and width; rows equal in all three are alike.
    """
    w = Window.partitionBy(*row).orderBy(x, key, width)
    rows = rows.withColumn("gap", F.col(x) - F.lag(F.col(x) + F.col(width)).over(w))
    positive = F.when(F.col("gap") > 0, F.col("gap"))
    whole = Window.partitionBy(*row)
    limit = F.when(F.count(positive).over(whole) >= 2, F.greatest(F.percentile(positive, 0.5).over(whole) * K.ROW_GAP_MEDIANS, F.lit(float(K.ROW_GAP_LEAST)))).otherwise(F.lit(float(K.ROW_GAP_LEAST)))
    rows = rows.withColumn("_new", F.coalesce(F.col("gap") > limit, F.lit(True)).cast("int"))
    return rows.withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
