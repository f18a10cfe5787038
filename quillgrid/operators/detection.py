"""Records in documents by a profile: anchors, candidates, regions, fields.

A line is a row with the document's column, page, column (from 0), pos (reading order in the document), text, font_size, bold and bbox.
"""

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geometry as G
from ..functions import text as T
from ..functions.patterns import problem_of


def nearest_column(elements: DataFrame, columns: DataFrame, page: list[str]) -> DataFrame:
    """elements (with bbox) with column: the one (the page's columns, column, min_x, max_x) whose edges are nearest to the element's middle, 0 inside; the first on a tie. 0 on a page without columns."""
    x = (F.col("bbox.minX") + F.col("bbox.maxX")) / 2
    cols = columns.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("column", "min_x", "max_x"))).alias("_cols"))  # a page has a few
    off = lambda c: F.greatest(c["min_x"] - x, x - c["max_x"], F.lit(0.0))
    best = F.array_min(F.transform("_cols", lambda c: F.struct(off(c).alias("d"), c["column"].alias("column"))))["column"]
    return elements.join(cols, page, "left").withColumn("column", F.coalesce(best, F.lit(0))).drop("_cols")


def matches_text(text: Column, pattern: str, regex: bool = False) -> Column:
    """The whole trimmed text is the pattern, or has a match of it (in its first 2000 characters); a refused pattern matches nothing."""
    if not regex:
        return T.trimmed(text) == pattern
    return F.lit(False) if problem_of(pattern) else F.substring(T.trimmed(text), 1, K.MAX_TEXT_LENGTH).rlike(pattern)


def is_anchor(lines: DataFrame, page: list[str], *, pattern: str | None = None, regex: bool = False, heading: dict | None = None) -> DataFrame:
    """lines with anchor. Without heading: the text has the pattern. With heading (min_size, max_size, bold, largest): its style fits, and its text is the pattern, if any."""
    text = F.col("text")
    if heading is None:
        fits = F.lit(False) if not pattern or (not regex and not pattern.strip()) else matches_text(text, pattern, True) if regex else F.contains(text, F.lit(pattern.strip()))
        return lines.withColumn("anchor", fits)
    most = F.max("font_size").over(Window.partitionBy(*page))
    fits = F.lit(True)
    for name, test in (("min_size", lambda v: F.col("font_size") >= v), ("max_size", lambda v: F.col("font_size") <= v), ("bold", lambda v: F.col("bold") == v), ("largest", lambda v: (F.abs(F.col("font_size") - most) <= 0.01) | F.lit(not v))):
        fits = fits & test(heading[name]) if name in heading else fits
    return lines.withColumn("anchor", fits & matches_text(text, pattern, regex) if pattern is not None else fits)


def candidates(lines: DataFrame, doc: str, *, boundary: str = "nextAnchor", gap: float = 0.0, label: str = "", regex: bool = False) -> DataFrame:
    """The lines (with anchor) that belong to candidates, with candidate (from 0). One runs from its anchor to the next, or ends before the first line that
    endOfColumnOrPage: is in another column than its anchor; verticalGap: lies more than `gap` below the line before in its column; endLabel: matches `label`."""
    w = Window.partitionBy(doc).orderBy("pos")
    x = lines.withColumn("candidate", F.sum(F.col("anchor").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).where("candidate >= 0")
    inside = Window.partitionBy(doc, "candidate").orderBy("pos")
    if boundary == "endOfColumnOrPage":
        head = F.first(F.struct("page", "column")).over(inside)
        stop = head != F.struct("page", "column")
    elif boundary == "verticalGap":
        prev = F.lag(F.struct("page", "column", F.col("bbox.minY").alias("low"))).over(inside)
        stop = F.coalesce((prev["page"] == F.col("page")) & (prev["column"] == F.col("column")) & (prev["low"] - F.col("bbox.maxY") > gap), F.lit(False))
    elif boundary == "endLabel":
        stop = matches_text(F.col("text"), label, regex) & ~F.col("anchor")
    else:
        stop = F.lit(False)
    x = x.withColumn("_stop", stop.cast("int"))
    return x.withColumn("_gone", F.max("_stop").over(inside.rowsBetween(Window.unboundedPreceding, 0))).where("_gone = 0").drop("_stop", "_gone")


def regions(found: DataFrame, doc: str) -> DataFrame:
    """doc, candidate, region (from 0), page, bbox, lines: stretches of a candidate in one column."""
    w = Window.partitionBy(doc, "candidate").orderBy("pos")
    turn = F.coalesce(F.lag(F.struct("page", "column")).over(w) != F.struct("page", "column"), F.lit(True)).cast("int")
    x = found.withColumn("_t", turn).withColumn("region", F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    b = "bbox"
    return x.groupBy(doc, "candidate", "region").agg(F.first("page").alias("page"), G.rect(F.min(f"{b}.minX"), F.min(f"{b}.minY"), F.max(f"{b}.maxX"), F.max(f"{b}.maxY")).alias("bbox"), F.count("*").alias("lines"))


def in_line(label: str, regex: bool = False) -> str | None:
    """The pattern of a label in a line: as words of their own, with or without a colon; null: refused."""
    pattern = label if regex else r"(?:^|\s)" + re.escape(label.strip().removesuffix(":").rstrip()).replace(r"\ ", " ") + r"\s*:?(?=\s|$)"
    return None if problem_of(pattern) else pattern


def label_value(text: Column, label: str, others: tuple[str, ...] = (), regex: bool = False) -> Column:
    """What stands after a label in its line, up to the first of the other labels; null where the line doesn't have it."""
    pattern = in_line(label, regex)
    if pattern is None:
        return F.lit(None).cast("string")
    cut = F.substring(text, 1, K.MAX_TEXT_LENGTH)
    hit = F.regexp_substr(cut, F.lit(pattern))
    rest = F.substring(text, F.regexp_instr(cut, F.lit(pattern)) + F.length(hit), F.length(text))
    stops = [F.nullif(F.regexp_instr(rest, F.lit(p)), F.lit(0)) for o in others if o != label and (p := in_line(o))]
    if stops:
        end = F.least(*stops) if len(stops) > 1 else stops[0]
        rest = F.when(end.isNotNull(), F.substring(rest, F.lit(1), end - 1)).otherwise(rest)
    return F.when(hit.isNotNull(), T.trimmed(rest))


def label_fields(found: DataFrame, doc: str, fields: dict[str, str]) -> DataFrame:
    """doc, candidate and a column a field (name -> label): the value of the first line of the candidate that has the label; null: not found."""
    first = lambda v: F.min_by(v, F.when(v.isNotNull(), F.col("pos")))
    return found.groupBy(doc, "candidate").agg(*[first(label_value(F.col("text"), label, tuple(fields.values()))).alias(name) for name, label in fields.items()])


def confidence(values: DataFrame, required: list[str], fields: list[str]) -> DataFrame:
    """values with confidence (share of required labels and fields that were found; 1 where there are none), missing (required ones) and complete."""
    n = len(required) + len(fields)
    hits = sum((F.col(c).isNotNull().cast("int") for c in [*required, *fields]), F.lit(0))
    missing = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.col(c).isNull(), c) for c in required]))
    return values.withColumn("confidence", hits / n if n else F.lit(1.0)).withColumn("missing", missing).withColumn("complete", F.size("missing") == 0)


def styled(elements: DataFrame, block: list[str], *, min_size: float | None = None, bold: bool | None = None, largest: bool = False) -> DataFrame:
    """The elements of a style; of those, the largest of their block if so asked."""
    x = elements.where(F.col("font_size") >= min_size) if min_size is not None else elements
    x = x.where(F.col("bold") == bold) if bold is not None else x
    if not largest:
        return x
    return x.withColumn("_most", F.max("font_size").over(Window.partitionBy(*block))).where("abs(font_size - _most) <= 0.01").drop("_most")


def in_region(elements: DataFrame, blocks: DataFrame, block: list[str], part: tuple[float, float, float, float]) -> DataFrame:
    """The elements (with bbox) whose middle lies in a part (shares of the block's rectangle, its edges included) of their block (the block's columns, area)."""
    a = F.col("area")
    w, h = a["maxX"] - a["minX"], a["maxY"] - a["minY"]
    wanted = G.rect(a["minX"] + w * part[0], a["minY"] + h * part[1], a["minX"] + w * part[2], a["minY"] + h * part[3])
    return elements.join(blocks, block).where(G.center_inside(F.col("bbox"), wanted)).drop("area")


def shares_of(rect: Column, block: Column) -> Column:
    """A rectangle as shares of its block's; null for a block without extent."""
    w, h = block["maxX"] - block["minX"], block["maxY"] - block["minY"]
    return F.when((w > 0) & (h > 0), G.rect((rect["minX"] - block["minX"]) / w, (rect["minY"] - block["minY"]) / h, (rect["maxX"] - block["minX"]) / w, (rect["maxY"] - block["minY"]) / h))


def token_fonts(tokens: DataFrame) -> DataFrame:
    """tokens (min_x, max_x, runs: array of font_key, size, min_x, max_x of their line; line_font, line_size) with font_key and font_size: of the line's first run that spans the token, else the line's."""
    run = F.get(F.filter("runs", lambda r: (r["min_x"] <= F.col("min_x")) & (r["max_x"] >= F.col("max_x"))), F.lit(0))
    return tokens.withColumn("_r", run).withColumn("font_key", F.coalesce("_r.font_key", "line_font")).withColumn("font_size", F.coalesce("_r.size", "line_size")).drop("_r")


def leaf_fields(schema, prefix: str = "") -> list[tuple[str, str]]:
    """(dotted path, type) of every field of a Spark schema that isn't a struct, in order."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        out += leaf_fields(f.dataType, f"{path}.") if hasattr(f.dataType, "fields") else [(path, f.dataType.simpleString())]
    return out
