"""Column builders over font names."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(font: Column) -> Column:
    """Without the six capitals and plus sign that mark a subset."""
    return F.regexp_replace(font, r"(?s)\A[A-Z]{6}\+(?=.)", "")


def font_key(font: Column, size: Column) -> Column:
    """Name and size, to half a point: Name@10 or Name@10.5."""
    half = F.floor(size * 2 + 0.5)
    return F.concat(base_name(font), F.lit("@"), (half / 2).cast("long").cast("string"), F.when(half % 2 != 0, ".5").otherwise(""))


def style(key: Column) -> Column:
    """struct(bold, italic) as the part of a key before @ says."""
    name = F.lower(F.split_part(key, F.lit("@"), F.lit(1)))
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(name, w))
    return F.struct(any_of(["bold", "black", "heavy"]).alias("bold"), any_of(["italic", "oblique"]).alias("italic"))
