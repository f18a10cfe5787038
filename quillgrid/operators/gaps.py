"""Gap statistics: samples, histograms, and profiles from their valleys.

`keys` name what a profile is for: the document and the font, say.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def gap_samples(items: DataFrame, row: list[str], along: str, font: str, width: str | None = None, tie: str | None = None) -> DataFrame:
    """font, gap (and the row's columns): distance to the previous item of the row, given to that item's font; negative ones are dropped."""
    w = Window.partitionBy(*row).orderBy(*[along, *([tie] if tie else [])])
    end = F.col(along) + (F.col(width) if width else F.lit(0.0))
    return items.withColumn("_end", F.lag(end).over(w)).withColumn("_font", F.lag(font).over(w)).select(*row, F.col("_font").alias("font"), (F.col(along) - F.col("_end")).alias("gap")).where("gap >= 0")


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined with b by the keys, a null key equal to a null one."""
    b = b.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(b, on, how).drop(*[f"_{k}" for k in keys])


def histogram(samples: DataFrame, keys: list[str], bins: int = K.HISTOGRAM_BINS) -> DataFrame:
    """The keys, bin, width, n, total, smooth: bins up to the largest gap, every bin present; 3 bins' mean. Keys whose gaps are all 0 have none."""
    most = samples.groupBy(*keys).agg(F.max("gap").alias("most"), F.count("*").alias("total")).where("most > 0").withColumn("width", F.col("most") / bins)
    counts = same_keys(samples.select(*keys, "gap"), most, keys).groupBy(*keys, F.least(F.lit(bins - 1), F.floor(F.col("gap") / F.col("width"))).alias("bin")).agg(F.count("*").alias("n"))
    dense = most.select(*keys, "total", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    near = Window.partitionBy(*keys).orderBy("bin").rowsBetween(-1, 1)  # at most `bins` rows each
    full = same_keys(dense, counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("smooth", F.sum("n").over(near) / F.count("n").over(near))


def valleys(hist: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, total, threshold, separation: the lowest bin between the highest peak and the highest other one at least 3 bins away."""
    w = Window.partitionBy(*keys).orderBy("bin")
    peak = (F.col("smooth") > 0) & (F.col("smooth") >= F.coalesce(F.lag("smooth").over(w), F.lit(-1.0))) & (F.col("smooth") >= F.coalesce(F.lead("smooth").over(w), F.lit(-1.0)))
    best = lambda cond: F.max(F.when(cond, F.struct(F.col("smooth").alias("h"), (-F.col("bin")).alias("b"))))
    marked = hist.withColumn("peak", peak)
    whole = Window.partitionBy(*keys)
    marked = marked.withColumn("p1", best(F.col("peak")).over(whole))
    marked = marked.withColumn("p2", best(F.col("peak") & (F.abs(F.col("bin") + F.col("p1.b")) >= K.MIN_PEAK_SEPARATION_BINS)).over(whole))
    inside = F.col("bin").between(F.least(-F.col("p1.b"), -F.col("p2.b")), F.greatest(-F.col("p1.b"), -F.col("p2.b")))
    low = F.min(F.when(inside, F.struct(F.col("smooth").alias("h"), F.col("bin").alias("b"))))
    out = marked.groupBy(*keys).agg(F.first("total").alias("total"), F.first("width").alias("width"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), low.alias("low"))
    none = F.col("p2").isNull()
    height = F.least("p1.h", "p2.h")
    return out.select(
        *keys, "total",
        F.when(none, F.col("width") * K.HISTOGRAM_BINS / 2).otherwise((F.col("low.b") + 0.5) * F.col("width")).alias("threshold"),
        F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("low.h") / height))).alias("separation"),
    )


def profiles(samples: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, total, separation, reliable, intra, inter of all keys in samples or sizes (keys, size).

    Reliable where there are samples and depth enough: thresholds on either side of the valley. Else shares of the font's
    size (1 where it isn't known), with separation 0 under 50 samples.
    """
    seen = samples.groupBy(*keys).agg(F.count("*").alias("total"))
    every = seen.select(*keys).union(sizes.select(*keys)).distinct()
    x = same_keys(same_keys(same_keys(every, seen, keys, "left"), valleys(histogram(samples, keys), keys).drop("total"), keys, "left"), sizes.select(*keys, "size"), keys, "left")
    total = F.coalesce("total", F.lit(0))
    enough = total >= K.MIN_SAMPLE_COUNT
    depth = F.when(enough, F.coalesce("separation", F.lit(0.0))).otherwise(0.0)
    good = enough & (depth >= K.MIN_SEPARATION)
    size = F.coalesce("size", F.lit(1.0))
    return x.select(
        *keys, total.alias("total"), depth.alias("separation"), good.alias("reliable"),
        F.when(good, F.col("threshold") * (1 - K.VALLEY_MARGIN_RATIO)).otherwise(size * K.FALLBACK_INTRA).alias("intra"),
        F.when(good, F.col("threshold") * (1 + K.VALLEY_MARGIN_RATIO)).otherwise(size * K.FALLBACK_INTER).alias("inter"),
    )


def two_level_profiles(samples: DataFrame, sizes: DataFrame, keys: list[str], page: str) -> DataFrame:
    """Profiles at level `document` (all keys) and `page` (keys and page of 20 samples or more): level, keys, page and those of profiles.

    A null page is a page like others; level tells it from the document.
    """
    both = samples.select("*", F.explode(F.array(F.lit("document"), F.lit("page"))).alias("level")).withColumn(page, F.when(F.col("level") == "page", F.col(page)))
    every = ["level", *keys, page]
    few = both.where("level = 'page'").groupBy(*every).agg(F.count("*").alias("_n")).where(F.col("_n") < K.MIN_PAGE_SAMPLE_COUNT)
    both = same_keys(both, few.drop("_n"), every, "left_anti")
    sized = same_keys(both.select(*every).distinct(), sizes.select(*keys, "size"), keys, "left").where("size IS NOT NULL")
    alone = sizes.select(F.lit("document").alias("level"), *keys, F.lit(None).cast(dict(samples.dtypes)[page]).alias(page), "size")
    return profiles(both, sized.unionByName(alone).distinct(), every)


def effective_profiles(levels: DataFrame, pages: DataFrame, keys: list[str], page: str) -> DataFrame:
    """What holds on each page of `pages` (keys, page): the document's profile where the page has none, the page's where the
    document's isn't reliable, else the lesser of both, reliable, with the page's count."""
    doc = levels.where("level = 'document'").drop("level", page)
    own = levels.where("level = 'page'").drop("level")
    named = lambda df, p: df.select(*[c for c in df.columns if c in (*keys, page)], F.struct("total", "separation", "reliable", "intra", "inter").alias(p))
    x = same_keys(same_keys(pages.select(*keys, page).distinct(), named(doc, "d"), keys), named(own, "p"), [*keys, page], "left")
    both = F.col("d.reliable") & F.col("p").isNotNull()
    pick = lambda c: F.when(both, F.least(F.col(f"d.{c}"), F.col(f"p.{c}"))).otherwise(F.coalesce(F.col(f"p.{c}"), F.col(f"d.{c}"))).alias(c)
    one = F.coalesce("p", "d")
    return x.select(*keys, page, one["total"].alias("total"), pick("separation"), F.when(both, True).otherwise(one["reliable"]).alias("reliable"), pick("intra"), pick("inter"))


def reliable_coverage(fonts: DataFrame, levels: DataFrame, book: list[str], font: str) -> DataFrame:
    """The book's columns and coverage: share of glyphs (fonts: book, font, glyph_count) in fonts whose document profile is reliable; 0 for none."""
    good = levels.where("level = 'document' AND reliable").select(*book, font).withColumn("_good", F.lit(True))
    x = same_keys(fonts, good, [*book, font], "left")
    share = F.sum(F.when(F.col("_good"), F.col("glyph_count"))) / F.nullif(F.sum("glyph_count"), F.lit(0))
    return x.groupBy(*book).agg(F.coalesce(share, F.lit(0.0)).alias("coverage"))
