"""Joins by place on a page, and what is counted over pages and books."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geometry as G


def with_role(items: DataFrame, roles: DataFrame, book: list[str]) -> DataFrame:
    """items with the role of their font (roles: book, font_key, role); unknown where there is none."""
    return items.join(roles.select(*book, "font_key", "role"), [*book, "font_key"], "left").withColumn("role", F.coalesce("role", F.lit("unknown")))


def first_region(lines: DataFrame, regions: DataFrame, page: list[str]) -> DataFrame:
    """lines (the page's columns, line, bbox) with region: the seq of the first of the page's regions (seq, area) that they overlap; null: none."""
    pairs = lines.select(*page, "line", "bbox").join(regions.select(*page, "seq", "area"), page).where(G.overlaps(F.col("bbox"), F.col("area")))
    return lines.join(pairs.groupBy(*page, "line").agg(F.min("seq").alias("region")), [*page, "line"], "left")


def near_pictures(blocks: DataFrame, pictures: DataFrame, page: list[str], margin: float = K.NEAR_IMAGE_MARGIN) -> DataFrame:
    """blocks (the page's columns, bbox) with near: a picture (the page's columns, area) of the page overlaps them, widened by `margin`."""
    b = F.col("bbox")
    wide = G.rect(b["minX"] - margin, b["minY"] - margin, b["maxX"] + margin, b["maxY"] + margin)
    areas = pictures.groupBy(*page).agg(F.collect_list("area").alias("_areas"))  # a page's pictures
    return blocks.join(areas, page, "left").withColumn("near", F.coalesce(F.exists("_areas", lambda a: G.overlaps(wide, a)), F.lit(False))).drop("_areas")


def beside_columns(blocks: DataFrame, columns: DataFrame, page: list[str]) -> DataFrame:
    """blocks with beside: they overlap none of the page's columns (min_x, max_x) sideways; false on a page without columns."""
    cols = columns.groupBy(*page).agg(F.collect_list(F.struct("min_x", "max_x")).alias("_cols"))
    b = F.col("bbox")
    touch = F.exists("_cols", lambda c: (b["minX"] < c["max_x"]) & (c["min_x"] < b["maxX"]))
    return blocks.join(cols, page, "left").withColumn("beside", F.coalesce(~touch, F.lit(False))).drop("_cols")


def spread_pairs(pictures: DataFrame, boxes: DataFrame, book: list[str]) -> DataFrame:
    """The book's columns, left, right: ids of pictures that are halves of one, each in one pair.

    First on one page: the right one begins right of the left one, at most 1.5 points behind its end and 6 before. Then
    over facing pages: the left one reaches its page's right edge and the right one the next page's left, to 4 points. Both
    to 4 points of one height and place. In order of id, a left one takes the first right one that is free. Pictures with a
    possible partner go to one task a book. pictures: the book's columns, page, id, bbox; boxes: the book's columns, page, box.
    """
    x = pictures.join(boxes, [*book, "page"], "left")
    a = x.select(*book, F.col("page").alias("p"), F.col("id").alias("left"), F.col("bbox").alias("a"), F.col("box").alias("pa"), F.explode(F.array(F.col("page"), F.col("page") + 1)).alias("page"))
    b = x.select(*book, "page", F.col("id").alias("right"), F.col("bbox").alias("b"), F.col("box").alias("pb"))
    level = (F.abs(F.col("a.minY") - F.col("b.minY")) <= 4) & (F.abs(F.col("a.maxY") - F.col("b.maxY")) <= 4)
    seam = (F.col("p") == F.col("page")) & (F.col("b.minX") > F.col("a.minX")) & (F.col("b.minX") - F.col("a.maxX") <= 1.5) & (F.col("a.maxX") - F.col("b.minX") <= 6)
    facing = (F.col("p") < F.col("page")) & (F.col("a.maxX") >= F.col("pa.maxX") - 4) & (F.col("b.minX") <= F.col("pb.minX") + 4)
    pairs = a.join(b, [*book, "page"]).where((F.col("left") != F.col("right")) & level & (seam | facing)).select(*book, F.when(seam, 0).otherwise(1).alias("round"), "left", "right")

    def greedy(t: pd.DataFrame) -> pd.DataFrame:
        taken, keep = set(), []
        for _, left, right in sorted(zip(t["round"], t["left"], t["right"], strict=True)):
            if left not in taken and right not in taken:
                taken |= {left, right}
                keep.append((left, right))
        out = pd.DataFrame(keep, columns=["left", "right"])
        for c in book:
            out[c] = t[c].iloc[0]
        return out[[*book, "left", "right"]]

    return pairs.groupBy(*book).applyInPandas(greedy, pairs.select(*book, "left", "right").schema)


def same_size_share(boxes: DataFrame, group: list[str]) -> DataFrame:
    """The group's columns and share: of its boxes, those of the commonest size (each side to a point)."""
    side = lambda lo, hi: F.floor(F.col(f"bbox.{hi}") - F.col(f"bbox.{lo}") + 0.5)
    sizes = boxes.groupBy(*group, side("minX", "maxX").alias("w"), side("minY", "maxY").alias("h")).agg(F.count("*").alias("n"))
    return sizes.groupBy(*group).agg((F.max("n") / F.sum("n")).alias("share"))


def repeated_looks(panels: DataFrame, book: list[str], others: int = 5) -> DataFrame:
    """panels (the book's columns, id, spread, saturation, mean) with repeated: at least `others` other panels differ by at most 5, 7 and 9 in these.

    Looks in cells as wide as these limits meet only those of neighbour cells, and equal looks are counted once.
    """
    limits = {"spread": 5, "saturation": 7, "mean": 9}
    looks = panels.groupBy(*book, *limits).agg(F.count("*").alias("n"))
    cell = lambda c, w: F.floor(F.col(c) / w)
    here = looks.select("*", *[cell(c, w).alias(f"_{c}") for c, w in limits.items()])
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    wide = looks.select(*book, *[F.col(c).alias(f"o_{c}") for c in limits], F.col("n").alias("o"), *[cell(c, w).alias(f"_{c}") for c, w in limits.items()])
    for c in limits:
        wide = wide.withColumn("_k", F.explode(near)).withColumn(f"_{c}", F.col(f"_{c}") + F.col("_k")).drop("_k")
    close = F.lit(True)
    for c, w in limits.items():
        close = close & (F.abs(F.col(c) - F.col(f"o_{c}")) <= w)
    counts = here.join(wide, [*book, *[f"_{c}" for c in limits]]).where(close).groupBy(*book, *limits).agg(F.sum("o").alias("_all"))
    return panels.join(counts, [*book, *limits]).withColumn("repeated", F.col("_all") - 1 >= others).drop("_all")


def repeated_keys(panels: DataFrame, book: list[str], key: str) -> DataFrame:
    """The book's columns and key: those that two panels or more have."""
    return panels.where(F.col(key).isNotNull()).groupBy(*book, key).agg(F.count("*").alias("_n")).where("_n >= 2").drop("_n")


def credit_logos(pictures: DataFrame, book: list[str]) -> DataFrame:
    """pictures (the book's columns, page, share, opaque) with logo: small ones (0.03 of the page at most) of the first six pages, five or more on a page, half of them cut out (opaque under 0.97; null: whole)."""
    small = (F.col("page") <= 6) & (F.col("share") <= 0.03)
    w = Window.partitionBy(*book, "page")
    n = F.count_if(small).over(w)
    cut = F.count_if(small & (F.coalesce("opaque", F.lit(1.0)) < 0.97)).over(w)
    return pictures.withColumn("logo", small & (n >= 5) & (cut >= 0.5 * n))


def row_gutters(spans: DataFrame, page: list[str]) -> DataFrame:
    """The page's columns, min_x, max_x: strips of 6 points or more, inside the page's text, that at most a twentieth of its rows (three at least) reach into.

    spans: the page's columns, row, min_x, max_x. Bins are 2 points wide; a row counts once in each. A row's first and last
    bin are all that is spread out: running sums give the rest, after the row's spans are merged.
    """
    w = Window.partitionBy(*page)
    x = spans.withColumn("_lo", F.min("min_x").over(w)).withColumn("_hi", F.max("max_x").over(w))
    bins = F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo")) / 2)).cast("long")
    x = x.withColumn("bins", bins).where("_hi > _lo").withColumn("s", F.floor((F.col("min_x") - F.col("_lo")) / 2)).withColumn("e", F.least(F.col("bins") - 1, F.floor((F.col("max_x") - F.col("_lo")) / 2)))
    r = Window.partitionBy(*page, "row").orderBy("s", "e")
    x = x.withColumn("_new", F.coalesce(F.col("s") > F.max("e").over(r.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")).withColumn("_part", F.sum("_new").over(r.rowsBetween(Window.unboundedPreceding, 0)))
    parts = x.groupBy(*page, "_lo", "bins", "row", "_part").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    rows = spans.groupBy(*page).agg(F.countDistinct("row").alias("rows")).where(F.col("rows") >= 3)
    steps = parts.select(*page, "_lo", "bins", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct((F.col("e") + 1).alias("at"), F.lit(-1).alias("d")))).alias("x")).select(*page, "_lo", "bins", "x.*")
    steps = steps.groupBy(*page, "_lo", "bins", "at").agg(F.sum("d").alias("d"))
    o = Window.partitionBy(*page).orderBy("at")
    level = steps.withColumn("n", F.sum("d").over(o.rowsBetween(Window.unboundedPreceding, 0))).withColumn("end", F.lead("at").over(o)).join(rows, page)
    low = level.withColumn("low", F.col("n") <= F.floor(F.col("rows") * 0.05)).where("end IS NOT NULL AND at < bins")
    turn = F.coalesce(F.lag("low").over(o) != F.col("low"), F.lit(True)).cast("int")
    runs = low.withColumn("_t", turn).withColumn("_run", F.sum("_t").over(o.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*page, "_run", "low", "_lo", "bins").agg(F.min("at").alias("a"), F.max("end").alias("z"))
    found = runs.where("low AND a > 0 AND z < bins AND z - a >= 3")
    return found.select(*page, (F.col("_lo") + F.col("a") * 2).alias("min_x"), (F.col("_lo") + F.col("z") * 2).alias("max_x"))


def match_labels(found: DataFrame, labels: DataFrame, least: float = 0.6) -> DataFrame:
    """found (page, id, hash, bbox) with label and changed: by hash and page first, then, of what is left on the page, the label (page, label, hash, area) of the largest
    intersection over union, `least` at least (the last of equal ones); each label once, found ones in order of id. A page's leftovers are one task's."""
    a, b = Window.partitionBy("page", "hash").orderBy("id"), Window.partitionBy("page", "hash").orderBy("label")
    x = found.withColumn("_n", F.row_number().over(a))
    same = labels.select("page", "hash", "label", F.row_number().over(b).alias("_n"))
    sure = x.join(same, ["page", "hash", "_n"], "left").drop("_n")
    rest = sure.where("label IS NULL").drop("label")
    free = labels.join(sure.where("label IS NOT NULL").select("page", "label"), ["page", "label"], "left_anti")
    pairs = rest.join(free.select("page", "label", "area"), "page").withColumn("o", G.iou(F.col("area"), F.col("bbox"))).where(F.col("o") >= least).select("page", "id", "label", "o")

    def greedy(t: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for i, g in t.sort_values(["id", "o", "label"]).groupby("id", sort=True):
            free = [lab for lab in g["label"] if lab not in used]
            if free:
                used.add(free[-1])
                out.append((t["page"].iloc[0], i, free[-1]))
        return pd.DataFrame(out, columns=["page", "id", "label"])

    near = pairs.groupBy("page").applyInPandas(greedy, pairs.select("page", "id", "label").schema)
    late = rest.join(near, ["page", "id"], "left").withColumn("changed", F.col("label").isNotNull())
    return sure.where("label IS NOT NULL").withColumn("changed", F.lit(False)).unionByName(late)


def sample_pages(count: Column) -> Column:
    """The first page, those at a quarter, a half and three quarters, and the last, ascending; none of an empty document."""
    at = [F.greatest(F.lit(1), F.floor(count * s + 0.5).cast("int")) for s in (0.25, 0.5, 0.75)]
    return F.when(count <= 0, F.array().cast("array<int>")).otherwise(F.array_sort(F.array_distinct(F.array(F.lit(1), *at, count.cast("int")))))


def capped(shapes: DataFrame, page: list[str], most: int = 20_000) -> DataFrame:
    """The shapes of pages that have at most `most`; of others none."""
    return shapes.withColumn("_n", F.count("*").over(Window.partitionBy(*page))).where(F.col("_n") <= most).drop("_n")
