import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillgrid.functions import geometry as G
from quillgrid.functions import text as T
from quillgrid.operators import layout, records
from quillgrid.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def plain(v):
    if pd.isna(v):
        return None
    try:
        return round(float(v), 6)
    except ValueError:
        return str(v)


def rows(frame):
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_planted_signals(spark):
    planted = "ab�ﬁx­ é\nЖ\U0001f600ﬆ"
    s = T.signals(F.col("t"))
    got = spark.createDataFrame([("a", planted), ("b", ""), ("c", "plain"), ("d", None)], "id string, t string").select("id", *[c.alias(k) for k, c in s.items()]).collect()
    assert [tuple(r) for r in got] == [("a", 14, 7, 1, 1, 2, 1, 1), ("b", *[0] * 7), ("c", 5, *[0] * 6), ("d", *[0] * 7)]


def test_numbers_and_repair(spark):
    df = spark.createDataFrame([("−3½ cups",), ("x 2.5, 7",), ("¼",), ("none",), (None,)], "t string")
    got = df.select(T.parse_number(F.col("t")), T.nth_number(F.col("t"), 2)).collect()
    assert [tuple(r) for r in got] == [(-3.5, None), (2.5, "7"), (0.25, None), (None, None), (None, None)]
    df = spark.createDataFrame([("ﬁsh  \t x \n y<&>",)], "t string")
    assert tuple(df.select(T.normalize_whitespace(T.expand_ligatures(F.col("t"))), T.escape_html(F.col("t"))).first()) == ("fish x\ny<&>", "ﬁsh  \t x \n y&lt;&amp;&gt;")


def test_rectangles(spark):
    a, b = (G.rect(*[F.lit(float(v)) for v in x]) for x in ((0, 0, 4, 4), (2, 2, 6, 6)))
    touch = G.rect(*[F.lit(float(v)) for v in (4, 0, 6, 4)])
    r = spark.range(1).select(G.overlap_ratio(a, b), G.area(G.union(a, b)), G.overlaps(a, touch), G.intersection(a, touch).isNull(), G.gap_distance(a, touch), G.area(G.shrink_to_center(a))).first()
    assert r[0] == 0.25 and r[1] == 36 and r[2] is False and r[3] is True and r[4] == 0 and abs(r[5] - 8) < 1e-9


def test_clusters_and_upserts(spark):
    spans = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 4, 9), (1, 3, 9, 12), (1, 4, 8, 10)], "g int, k int, a int, z int")
    got = {r["k"]: r["cluster"] for r in layout.overlap_clusters(spans, "g", "a", "z", "k").collect()}
    assert got == {1: 1, 2: 1, 4: 1, 3: 1}
    plan = records.upsert_plan(spark.createDataFrame([("n",), ("u",), ("s",)], "k string"), spark.createDataFrame([("u",), ("s",), ("s",)], "k string"), "k")
    assert {tuple(r) for r in plan.collect()} == {("n", "create"), ("u", "update"), ("s", "skip")}
