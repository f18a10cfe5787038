"""Readers: the driver's tables, and plain text as positioned items."""

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import SPACE

ONLY_SPACE = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", SPACE) + "+")
ODD_SPACE = re.compile(ONLY_SPACE.pattern.replace(" ", "", 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_items(docs: DataFrame) -> DataFrame:
    """documents as positioned words: 6 points a character, lines 12 points apart, 60 lines a page.

    doc_id, page, line_no, word_no (from 0), str, x, y, width, height, font_key. The characters before a
    word are summed over its line, so work grows with a line's words and no more.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = lines.select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("word_no", "str"))
    line = Window.partitionBy("doc_id", "line_no").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    words = words.withColumn("before", F.coalesce(F.sum(F.length("str") + 1).over(line), F.lit(0))).where("str <> ''")
    return words.select(
        "doc_id", (F.floor(F.col("line_no") / 60) + 1).alias("page"), "line_no", "word_no", "str",
        (72 + 6 * F.col("before")).cast("double").alias("x"), (792 - 12 * (F.col("line_no") % 60)).cast("double").alias("y"),
        (6 * F.length("str")).cast("double").alias("width"), F.lit(10.0).alias("height"),
        F.when(F.col("line_no") == 0, "Head@14").otherwise("Body@10").alias("font_key"),
    )


def emitted_items(docs: DataFrame) -> DataFrame:
    """text_items as a page description may emit them: a blank item after each word but a line's last, each seventh word again a quarter
    of a point to the right, and each eleventh again where it is. doc_id, page, idx, str, x, width, a..f (the matrix), line_no, word_no."""
    words = text_items(docs)
    last = F.max("word_no").over(Window.partitionBy("doc_id", "line_no"))
    kinds = F.array_compact(F.array(F.lit(0), F.when(F.col("word_no") % 7 == 3, 1), F.when(F.col("word_no") % 11 == 5, 2), F.when(F.col("word_no") < last, 3)))
    x = words.withColumn("kinds", kinds).withColumn("kind", F.explode("kinds"))
    place = F.when(F.col("kind") == 3, F.col("x") + F.col("width")).otherwise(F.col("x") + F.when(F.col("kind") == 1, 0.25).otherwise(0.0))
    page = Window.partitionBy("doc_id", "page").orderBy("line_no", "word_no", "kind")
    size = F.regexp_extract("font_key", "@([0-9.]+)$", 1).cast("double")
    return x.select(
        "doc_id", "page", (F.row_number().over(page) - 1).alias("idx"), F.when(F.col("kind") == 3, " ").otherwise(F.col("str")).alias("str"), place.alias("x"),
        F.when(F.col("kind") == 3, 6.0).otherwise(F.col("width")).alias("width"), size.alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), size.alias("d"), place.alias("e"), F.col("y").alias("f"), "line_no", "word_no",
    )


def page_lines(docs: DataFrame) -> DataFrame:
    """documents as lines of pages, the ones of text_items: doc_id, page, line_no, line."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", (F.floor(F.col("line_no") / 60) + 1).alias("page"), "line_no", "line")


def page_tokens(line_nos: list[int], lines: list[str]) -> dict:
    """The words of a page's lines (in order of line_no) as columns: str, along, cross, size, width, height, font_key, breaks, last_breaks.

    They are the first items of each word in emitted_items that are no white space, with breaks as hygiene.with_boundary_counts counts them.
    """
    parts = [x.split(" ") for x in lines]
    text = [w for p in parts for w in p]
    n = np.fromiter(map(len, text), np.int64, len(text))
    counts = np.array([len(p) for p in parts])
    line = np.repeat(np.arange(len(parts)), counts)
    before = np.cumsum(n + 1) - n - 1
    before -= np.repeat(before[np.cumsum(counts) - counts], counts)
    kept = np.flatnonzero(n)
    line, before, n, text = line[kept], before[kept], n[kept], [w for w in text if w]
    real = np.ones(len(text), dtype=bool)
    if any(map(ODD_SPACE.search, lines)):
        real = np.array([not ONLY_SPACE.fullmatch(w) for w in text], dtype=bool)
        text = [w for w, r in zip(text, real.tolist(), strict=True) if r]
    open_ = np.append(line[1:] == line[:-1], False)  # a blank item comes behind each word but a line's last
    at = np.flatnonzero(real)
    parted = np.append(False, open_)[at] | (np.diff(at, prepend=-1) > 1)
    line, before, n, breaks = line[at], before[at], n[at], np.cumsum(parted)
    no = np.array(line_nos, dtype=np.int64)[line]
    size = np.where(no == 0, 14.0, 10.0)
    return {
        "str": text, "along": 72.0 + 6 * before, "cross": 792.0 - 12 * (no % 60), "size": size, "width": 6.0 * n, "height": np.full(len(text), 10.0),
        "font_key": ["Body@10" if x else "Head@14" for x in no.tolist()], "breaks": breaks, "last_breaks": breaks,
    }
