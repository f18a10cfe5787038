"""Text quality by group: counts, confidence, verdict, fragmentation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def quality_by(docs: DataFrame, key: str) -> DataFrame:
    """One row a key; counts are summed on each task before the shuffle."""
    s = T.signals(F.col("text"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \n]"), lambda w: w != "")
    counts = docs.select(key, *[c.alias(k) for k, c in s.items()], F.size(words).alias("words"), F.size(F.filter(words, lambda w: F.length(w) <= 2)).alias("fragments"))
    total = counts.groupBy(key).agg(*[F.sum(k).alias(k) for k in [*s, "words", "fragments"]])
    corrupt = sum((F.col(k) for k in T.CORRUPT[1:]), F.col(T.CORRUPT[0]))
    return total.withColumn("confidence", F.round(T.confidence(F.col("total_chars"), F.col("outside"), corrupt), 9)).withColumn("suspected_scan", F.col("total_chars") == 0)
