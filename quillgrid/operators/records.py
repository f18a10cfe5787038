"""Joins and reports over records: invariants, forward as-of, upserts, labels, value maps."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def invariant(name: str, child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """name, checked, missing, ratio: rows of child whose key isn't in parent."""
    known = parent.select(F.col(parent_key).alias("_k")).distinct().withColumn("_hit", F.lit(1))
    return child.join(known, F.col(key) == F.col("_k"), "left").agg(F.count("*").alias("checked"), F.sum(F.when(F.col("_hit").isNull(), 1).otherwise(0)).alias("missing")).select(F.lit(name).alias("name"), "checked", "missing", (F.col("missing") / F.greatest("checked", F.lit(1))).alias("ratio"))


def next_match(rows: DataFrame, group: str, order: str, match: str, key: str) -> DataFrame:
    """The rows with next_key: the key of the first row at or after them, in the group's order, that matches; null if none."""
    w = Window.partitionBy(group).orderBy(order, key).rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("next_key", F.first(F.when(F.expr(match), F.col(key)), ignorenulls=True).over(w))


def upsert_plan(records: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """key, status: create, update (one match) or skip (several)."""
    known = target.groupBy(key).agg(F.count("*").alias("_n"))
    return records.join(known, key, "left").select(key, F.when(F.col("_n").isNull(), "create").when(F.col("_n") == 1, "update").otherwise("skip").alias("status"))


def precision_recall(rows: DataFrame, said: str, truth: str) -> DataFrame:
    """found, right, wanted, precision, recall of a rule against labels."""
    s = rows.agg(F.count_if(F.expr(said)).alias("found"), F.count_if(F.expr(f"({said}) AND ({truth})")).alias("right"), F.count_if(F.expr(truth)).alias("wanted"))
    return s.withColumn("precision", F.round(F.col("right") / F.nullif(F.col("found"), F.lit(0)), 9)).withColumn("recall", F.round(F.col("right") / F.nullif(F.col("wanted"), F.lit(0)), 9))


def value_map(rows: DataFrame, col: str, entries: DataFrame, *, ignore_case: bool = True, fuzzy: bool = False) -> DataFrame:
    """rows with mapped and match: the value of the first entry (key, value, seq) that is equal without outer blanks and case (exact).

    If fuzzy, one that is equal in its letters and digits alone (normalized), else the first of the nearest within
    max(1, a quarter of the length) edits of these (near). The first two are joins by key; only values that neither
    finds meet all entries, which are a profile's table.
    """
    plain = lambda c: F.lower(c) if ignore_case else c
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    values = rows.select(F.col(col).alias("_v")).where("_v IS NOT NULL").distinct().withColumn("_t", T.trimmed(F.col("_v")))
    first = lambda k: entries.groupBy(k.alias("_k")).agg(F.min_by("value", "seq").alias("mapped"))
    exact = values.join(first(plain(F.col("key"))), plain(F.col("_t")) == F.col("_k"), "left").drop("_k")
    out = exact.withColumn("match", F.when(F.col("mapped").isNotNull(), "exact"))
    if fuzzy:
        rest = out.where("match IS NULL").drop("mapped", "match")
        like = rest.join(first(bare(F.col("key"))), bare(F.col("_t")) == F.col("_k"), "left").drop("_k").withColumn("match", F.when(F.col("mapped").isNotNull(), "normalized"))
        table = entries.select(F.array_agg(F.struct("seq", bare(F.col("key")).alias("k"), "value")).alias("all"))
        near = like.where("match IS NULL").drop("mapped", "match").crossJoin(F.broadcast(table))  # one row: the profile's table
        best = F.array_min(F.transform("all", lambda e: F.struct(F.levenshtein(bare(F.col("_t")), e["k"]).alias("d"), e["seq"].alias("seq"), e["value"].alias("value"))))
        near = near.withColumn("b", best).withColumn("ok", F.col("b.d") <= F.greatest(F.lit(1), F.floor(F.length(bare(F.col("_t"))) * 0.25)))
        near = near.select("_v", "_t", F.when(F.col("ok"), F.col("b.value")).alias("mapped"), F.when(F.col("ok"), "near").alias("match"))
        out = out.where("match IS NOT NULL").unionByName(like.where("match IS NOT NULL")).unionByName(near)
    return rows.join(out.drop("_t"), F.col(col) == F.col("_v"), "left").drop("_v")


def top_n(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group, with their place as rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)
