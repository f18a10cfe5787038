"""Ranges between anchors, entries, ordinals; nearest and covered rectangles."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def anchor_ranges(rows: DataFrame, group: str, order: str, anchor: str, stop: str | None = None) -> DataFrame:
    """group, candidate (from 1), start, end: row numbers (from 0, end excluded) from each anchor to the next one, or to the first
    row after the anchor where `stop` holds. Rows before a group's first anchor belong to none."""
    w = Window.partitionBy(group).orderBy(order)
    x = rows.withColumn("_a", F.coalesce(F.expr(anchor), F.lit(False))).withColumn("_s", F.coalesce(F.expr(stop), F.lit(False)) if stop else F.lit(False))
    x = x.withColumn("_i", F.row_number().over(w) - 1).withColumn("candidate", F.sum(F.col("_a").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.when(F.col("_s") & ~F.col("_a"), F.col("_i")))
    return x.where("candidate > 0").groupBy(group, "candidate").agg(F.min("_i").alias("start"), F.coalesce(first, F.max("_i") + 1).alias("end"))


def boundary_entries(rows: DataFrame, group: str, order: str, boundary: str) -> DataFrame:
    """rows with entry (from 1): each row where `boundary` holds begins one."""
    w = Window.partitionBy(group).orderBy(order)
    new = ((F.row_number().over(w) == 1) | F.coalesce(F.expr(boundary), F.lit(False))).cast("int")
    return rows.withColumn("_n", new).withColumn("entry", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")


def delimiter_entries(rows: DataFrame, group: str, order: str, delimiter: str) -> DataFrame:
    """The rows between those where `delimiter` holds, with entry (from 1); empty entries don't count."""
    w = Window.partitionBy(group).orderBy(order)
    x = rows.withColumn("_d", F.coalesce(F.expr(delimiter), F.lit(False))).withColumn("_g", F.sum(F.col("_d").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.where("NOT _d").withColumn("entry", F.dense_rank().over(Window.partitionBy(group).orderBy("_g"))).drop("_d", "_g")


def ordinal_keys(rows: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """rows with key: the name in lower case with single blanks (entry-N where it has none), `#` and how many of that name came before."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(name), F.lit(""))), r"\s+", " "))
    x = rows.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)
    x = x.withColumn("_b", F.when(plain == "", F.concat(F.lit("entry-"), "_i")).otherwise(plain))
    n = F.row_number().over(Window.partitionBy(group, "_b").orderBy("_i")) - 1
    return x.withColumn("key", F.concat("_b", F.lit("#"), n)).drop("_i", "_b")


def coverage(boxes: DataFrame, texts: DataFrame, page: str, key: str) -> DataFrame:
    """page, key, coverage: the areas a box (column r) shares with the page's texts (column r), summed, over its own; at most 1."""
    x = boxes.select(page, key, "r").join(texts.select(page, F.col("r").alias("_t")), page, "left")
    sums = x.groupBy(page, key, "r").agg(F.sum(F.coalesce(G.area(G.intersection(F.col("r"), F.col("_t"))), F.lit(0.0))).alias("_c"))
    own = G.area(F.col("r"))
    return sums.select(page, key, F.when(own > 0, F.least(F.lit(1.0), F.col("_c") / own)).otherwise(0.0).alias("coverage"))


def nearest(regions: DataFrame, images: DataFrame, page: str, key: str, image: str) -> DataFrame:
    """page, key, nearest, gap: the page's image of least distance between edges; of equal ones the first; null without any."""
    x = regions.select(page, key, F.col("r").alias("_a")).join(images.select(page, F.col(image).alias("_n"), F.col("r").alias("_b")), page, "left")
    gap = F.when(F.col("_b").isNotNull(), G.gap_distance(F.col("_a"), F.col("_b")))
    best = F.min(F.when(gap.isNotNull(), F.struct(gap.alias("gap"), F.col("_n").alias("nearest"))))
    return x.groupBy(page, key).agg(best.alias("b")).select(page, key, "b.nearest", "b.gap")
