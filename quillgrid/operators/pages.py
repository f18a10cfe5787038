"""Spanning lines, columns, reading order and blocks. Lines have minX, minY, maxX, maxY and a key that orders ties.

A page holds a bounded number of lines, so windows and groups by page stay small however many pages there are.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def mid_y() -> Column:
    return (F.col("minY") + F.col("maxY")) / 2


def mark_spanning(lines: DataFrame, page: list[str], height: str | None = None) -> DataFrame:
    """lines with spanning: those in the head and foot bands of a page of `height`, and those at least 70 % as wide as the other
    lines' block, unless more than half of these would be."""
    at = mid_y() / F.col(height) if height else F.lit(0.5)
    margin = F.coalesce((at > K.HEADER_BAND) | (at < K.FOOTER_BAND), F.lit(False)) if height else F.lit(False)
    if height:
        margin = margin & (F.col(height) > 0)
    w = Window.partitionBy(*page)
    x = lines.withColumn("_m", margin)
    x = x.withColumn("_width", F.max(F.when(~F.col("_m"), F.col("maxX"))).over(w) - F.min(F.when(~F.col("_m"), F.col("minX"))).over(w))
    x = x.withColumn("_wide", ~F.col("_m") & (F.col("_width") > 0) & (F.col("maxX") - F.col("minX") >= F.col("_width") * K.SPANNING_WIDTH_RATIO))
    few = F.count_if(F.col("_wide")).over(w) <= F.count_if(~F.col("_m")).over(w) / 2
    return x.withColumn("spanning", F.col("_m") | (F.col("_wide") & few)).drop("_m", "_width", "_wide")


def gutters(lines: DataFrame, page: list[str]) -> DataFrame:
    """page, gutter_min, gutter_max, empty: vertical strips between columns of columnar lines.

    Lines are counted in bins of 2 points; a strip is a run of at least 5 bins with at most 5 % of the highest count, off
    the edges, with at least 70 % of the height free. Each line adds two rows: a count up where it begins, down after it.
    """
    box = lines.groupBy(*page).agg(F.min("minX").alias("x0"), F.max("maxX").alias("x1"), F.min("minY").alias("y0"), F.max("maxY").alias("y1")).where("x1 > x0")
    box = box.withColumn("bins", F.greatest(F.lit(1), F.ceil((F.col("x1") - F.col("x0")) / K.COLUMN_BIN)).cast("int"))
    at = lambda c: F.floor((F.col(c) - F.col("x0")) / K.COLUMN_BIN).cast("int")
    ends = F.array(F.struct(at("minX").alias("bin"), F.lit(1).alias("d")), F.struct((F.least(F.col("bins") - 1, at("maxX")) + 1).alias("bin"), F.lit(-1).alias("d")))
    steps = lines.join(box, page).select(*page, "bins", F.inline(ends))
    steps = steps.unionByName(box.select(*page, "bins", F.explode(F.sequence(F.lit(0), F.col("bins"))).alias("bin"), F.lit(0).alias("d")))
    order, whole = Window.partitionBy(*page).orderBy("bin"), Window.partitionBy(*page)
    hist = steps.groupBy(*page, "bins", "bin").agg(F.sum("d").alias("d")).withColumn("n", F.sum("d").over(order)).where("bin < bins")
    hist = hist.withColumn("_low", F.col("n") <= F.max("n").over(whole) * K.MAX_VALLEY_DENSITY).withColumn("_run", F.sum(F.when(F.col("_low"), 0).otherwise(1)).over(order))
    runs = hist.where("_low").groupBy(*page, "bins", "_run").agg(F.min("bin").alias("a"), F.max("bin").alias("z"))
    runs = runs.where((F.col("a") > 0) & (F.col("z") < F.col("bins") - 1) & (F.col("z") - F.col("a") + 1 >= -(-K.MIN_VALLEY_WIDTH // K.COLUMN_BIN)))
    runs = runs.join(box.drop("bins"), page).select(*page, (F.col("x0") + F.col("a") * K.COLUMN_BIN).alias("gutter_min"), (F.col("x0") + (F.col("z") + 1) * K.COLUMN_BIN).alias("gutter_max"), (F.col("y1") - F.col("y0")).alias("_h"))
    over = lines.select(*[F.col(c).alias(f"_{c}") for c in page], "minX", "maxX", (F.col("maxY") - F.col("minY")).alias("_tall"))
    crossing = [F.col(c) == F.col(f"_{c}") for c in page] + [F.col("minX") < F.col("gutter_max"), F.col("gutter_min") < F.col("maxX")]
    full = runs.join(over, crossing, "left").groupBy(*page, "gutter_min", "gutter_max", "_h").agg(F.coalesce(F.sum("_tall"), F.lit(0)).alias("_covered"))
    empty = F.when(F.col("_h") > 0, 1 - F.least(F.lit(1.0), F.col("_covered") / F.col("_h"))).otherwise(1.0)
    return full.withColumn("empty", empty).where(F.col("empty") >= K.MIN_VERTICAL_EMPTY).drop("_h", "_covered")


def columns(lines: DataFrame, page: list[str]) -> DataFrame:
    """page, columns (minX, maxX from the left), confidence of columnar lines; a page without gutters has one column, at 1."""
    cuts = gutters(lines, page).groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("gutter_min", "gutter_max"))).alias("g"), F.min("empty").alias("confidence"))
    box = lines.groupBy(*page).agg(F.min("minX").alias("x0"), F.max("maxX").alias("x1"))
    g = F.coalesce(F.col("g"), F.expr("CAST(array() AS array<struct<gutter_min:double,gutter_max:double>>)"))
    both = F.arrays_zip(F.concat(F.array("x0"), F.transform(g, lambda c: c["gutter_max"].cast("double"))).alias("minX"), F.concat(F.transform(g, lambda c: c["gutter_min"].cast("double")), F.array("x1")).alias("maxX"))
    box = box.withColumn("x0", F.col("x0").cast("double")).withColumn("x1", F.col("x1").cast("double"))
    return box.join(cuts, page, "left").select(*page, both.alias("columns"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def drop_sparse(cols: DataFrame, lines: DataFrame, page: list[str]) -> DataFrame:
    """cols without those whose lines reach over less than half of the page's height: the first such column goes, lines are dealt
    anew, and so on while there are two. A step depends on the one before, so a page is one Pandas group."""
    slim = lines.select(*[F.col(c).alias(f"_{c}") for c in page], *[F.col(c).cast("double").alias(c) for c in ("minX", "minY", "maxX", "maxY")])
    least = K.MIN_COLUMN_SPAN

    def shrink(c, rows):
        import numpy as np

        if len(c) == 0:
            return c
        kept = [(s["minX"], s["maxX"]) for s in c["columns"].iloc[0]]
        x0, x1, y0, y1 = (rows[k].to_numpy() for k in ("minX", "maxX", "minY", "maxY"))
        high = y1.max() - y0.min() if len(rows) else 0
        while len(kept) > 1:
            best = np.argmax(np.stack([np.minimum(b, x1) - np.maximum(a, x0) for a, b in kept]), axis=0)
            spans = [(y1[best == i].max() - y0[best == i].min()) / high if high > 0 and (best == i).any() else 0.0 for i in range(len(kept))]
            thin = next((i for i, s in enumerate(spans) if s < least), None)
            if thin is None:
                break
            del kept[thin]
        out = c.copy()
        out["columns"] = [[{"minX": a, "maxX": b} for a, b in kept]]
        return out

    return cols.groupBy(*page).cogroup(slim.groupBy(*[f"_{c}" for c in page])).applyInPandas(shrink, cols.schema)


def assign_columns(lines: DataFrame, cols: DataFrame, page: list[str]) -> DataFrame:
    """lines with col: the column (from 0) of largest overlap along x, however negative; of equal ones the first; -1 without columns."""
    overlap = F.transform("columns", lambda c, i: F.struct((F.least(c["maxX"], F.col("maxX")) - F.greatest(c["minX"], F.col("minX"))).alias("o"), (-i).alias("i")))
    return lines.join(cols.select(*page, "columns"), page, "left").withColumn("col", F.coalesce(-F.array_max(overlap)["i"], F.lit(-1))).drop("columns")


def reading_order(lines: DataFrame, page: list[str], key: str, rotation: int = 0) -> DataFrame:
    """lines with band and position (from 0): spanning lines cut a page into bands, which are read column by column.

    lines have spanning and col; pages turned by 180 degrees are read from the last column.
    """
    down = Window.partitionBy(*page).orderBy(mid_y().desc(), F.desc("spanning"), key)
    x = lines.withColumn("band", F.sum(F.col("spanning").cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    side = F.col("col") if rotation != 180 else -F.col("col")
    order = Window.partitionBy(*page).orderBy("band", F.desc("spanning"), F.when(~F.col("spanning"), side), mid_y().desc(), key)
    return x.withColumn("position", F.row_number().over(order) - 1)


def blocks(lines: DataFrame, page: list[str]) -> DataFrame:
    """page, block (from 1), col, font_key, n_lines, text, minX.., typical, isolated, short_lines: runs of lines in reading order.

    lines have position, col, font_key, cross and text. A block ends at another column or font, a line distance above 1.8
    medians of the page (from 3 distances on), or an indent that differs by more than 8 points. A block of one line is
    isolated if its neighbours in the column are more than 1.5 medians off, or missing.
    """
    w, whole = Window.partitionBy(*page).orderBy("position"), Window.partitionBy(*page)
    x = lines.withColumn("_p", F.lag(F.struct("col", "font_key", "cross", "minX")).over(w))
    p = lambda c: F.col(f"_p.{c}")
    x = x.withColumn("_gap", F.abs(F.col("cross") - p("cross"))).withColumn("_same", F.when(p("col") == F.col("col"), F.col("_gap")))
    typical = F.when(F.count("_same").over(whole) >= K.MIN_MEDIAN_SAMPLES, F.percentile("_same", 0.5).over(whole)).otherwise(0.0)
    x = x.withColumn("typical", typical)
    new = (
        F.col("_p").isNull() | (p("col") != F.col("col")) | (p("font_key") != F.col("font_key"))
        | ((F.col("typical") > 0) & (F.col("_gap") > F.col("typical") * K.LINE_GAP_BREAK)) | (F.abs(F.col("minX") - p("minX")) > K.INDENT_BREAK)
    )
    x = x.withColumn("block", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda t: t["text"]), "\n")
    out = x.groupBy(*page, "block").agg(
        F.first("col").alias("col"), F.first("font_key").alias("font_key"), F.count("*").alias("n_lines"), text.alias("text"), F.first("typical").alias("typical"),
        F.min("minX").alias("minX"), F.min("minY").alias("minY"), F.max("maxX").alias("maxX"), F.max("maxY").alias("maxY"),
        F.min_by("cross", "position").alias("_head"), F.max_by("cross", "position").alias("_tail"), F.count_if(F.length(F.trim("text")).between(1, K.MAX_TABLE_LINE)).alias("short_lines"),
    )
    c = Window.partitionBy(*page, "col").orderBy("block")
    far = lambda d: d.isNull() | (F.col("typical") <= 0) | (F.abs(d) > F.col("typical") * K.ISOLATION_GAP)
    alone = (F.col("n_lines") == 1) & far(F.col("_head") - F.lag("_tail").over(c)) & far(F.lead("_head").over(c) - F.col("_tail"))
    return out.withColumn("isolated", alone).drop("_head", "_tail")


def classify(found: DataFrame, running: Column | None = None, angle: Column | None = None, aside: Column | None = None, filled: Column | None = None, near_image: Column | None = None) -> DataFrame:
    """blocks (with role) and their kind, confidence and rule: the first rule that holds.

    running: header or footer, or null. aside: the block overlaps none of the page's columns, of which there is one at
    least. filled: it overlaps a filled region on a page with columns in use. What isn't given doesn't hold.
    """
    no = F.lit(False)
    running, angle = F.lit(None).cast("string") if running is None else running, F.lit(0) if angle is None else angle
    aside, filled, near = no if aside is None else aside, no if filled is None else filled, no if near_image is None else near_image
    role, n = F.coalesce(F.col("role"), F.lit("unknown")), F.col("n_lines")
    rules = [
        (running.isNotNull(), running, 0.95, "running"),
        (angle != 0, "marginalia", 0.85, "angle"),
        (filled & aside, "sidebar", 0.7, "fill"),
        (F.col("text").rlike("[.·]{5,}"), "table", 0.6, "dot-leader"),
        ((n >= 4) & (F.col("short_lines") / n >= 0.8), "table", 0.4, "short-lines"),
        ((role == "caption") & near, "caption", 0.65, "near-image"),
        ((role == "accent") & near, "caption", 0.55, "near-image"),
        ((role == "heading") & (n <= 2), "heading", 0.75, "heading-role"),
        ((role == "accent") & (n == 1) & F.col("isolated"), "heading", 0.55, "isolated-accent"),
        ((role == "accent") & (n >= 2) & ~aside, "body", 0.5, "accent-lines"),
        (role == "body", "body", 0.8, "body-role"),
        (F.lit(True), "unknown", 0.3, "none"),
    ]
    pick = F.coalesce(*[F.when(c, F.struct((k if isinstance(k, Column) else F.lit(k)).alias("kind"), F.lit(s).alias("confidence"), F.lit(r).alias("rule"))) for c, k, s, r in rules])
    return found.withColumn("_c", pick).select("*", "_c.kind", "_c.confidence", "_c.rule").drop("_c")
