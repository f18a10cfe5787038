"""Cases of rules that SQL over the driver's tables doesn't reach."""

import itertools
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import geometry as G
from quillgrid.functions import text as T
from quillgrid.functions.patterns import problem_of
from quillgrid.operators import detection, gaps, hygiene, imports, layout, lines, places, records
from quillgrid.plans.text import text_lines
from quillgrid.sources import tables


def test_patterns():
    assert problem_of("(a+)+") == "nested-repeat" and problem_of("(ab|ac)*") is None
    assert problem_of("(?:ab|a.)+") == "overlap" and problem_of(r"\d+\d+\d+x") == "backtracking" and problem_of(r"\d+\s+\w+") is None
    assert problem_of("(") == "invalid" and problem_of("a" * 301) == "too-long" and problem_of(r"^AC:\s*(\d+)") is None


def test_duplicates_take_one_each(spark):
    """Brute force over chains of copies, near copies and others within three places."""
    rng = random.Random(2)
    rows = []
    for page in range(30):
        for k in range(40):
            rows.append((page, k, rng.choice("ab"), 10.0, 0.0, 0.0, 10.0, rng.choice([0.0, 0.2, 0.4, 5.0]), 7.0))
    df = spark.createDataFrame(rows, "page int, idx int, str string, a double, b double, c double, d double, e double, f double")
    got = {(r["page"], r["idx"]): r["bold"] for r in hygiene.drop_duplicates(df, ["page"]).collect()}
    want = {}
    for _, group in itertools.groupby(rows, key=lambda r: r[0]):
        group, gone = list(group), set()
        for i, r in enumerate(group):
            if i in gone:
                continue
            bold = False
            for j in range(i + 1, min(len(group), i + 4)):
                o = group[j]
                if j in gone or o[2] != r[2] or abs(o[7] - r[7]) >= 0.5:
                    continue
                gone.add(j)
                bold = o[7] != r[7]
                break
            want[r[0], r[1]] = bold
    assert got == want


def test_boundaries_and_composition(spark):
    rows = [(1, 0, " ", 0.0, 5.0), (1, 1, "é­", 5.0, 9.0), (1, 2, "", 9.0, 1.0), (1, 3, " ", 14.0, 3.0), (1, 4, "\t", 16.0, 4.0), (1, 5, "ﬁx", 30.0, 6.0)]
    df = spark.createDataFrame(rows, "page int, idx int, str string, x double, width double")
    assert {tuple(r)[1:] for r in hygiene.word_boundaries(df, ["page"]).collect()} == {(-1, 0.0, 5.0), (1, 14.0, 20.0)}
    kept = hygiene.with_boundary_counts(df, ["page"]).select("idx", "breaks", hygiene.repaired(F.col("str")).alias("s")).collect()
    assert {tuple(r) for r in kept} == {(1, 1, "é"), (5, 2, "fix")}


def test_lines_with_subscripts_gaps_and_hyphens(spark):
    def token(i, text, x, y, size=10.0, breaks=0, font="F"):
        return (1, i, text, float(x), float(y), size, 6.0 * len(text), size, font, breaks, breaks)

    rows = [token(0, "H", 0, 100), token(1, "2", 6, 96, 6.0), token(2, "O", 12, 100), token(3, "far", 90, 100), token(4, "split-", 0, 80, breaks=1), token(5, "ting", 0, 60, breaks=2), token(6, "on", 40, 60, breaks=3)]
    schema = "page int, idx int, str string, along double, cross double, size double, width double, height double, font_key string, breaks int, last_breaks int"
    got = [(r["line"], r["text"]) for r in lines.cluster_lines(spark.createDataFrame(rows, schema), ["page"]).orderBy("cross", ascending=False).collect()]
    assert sorted(t for _, t in got) == ["H2Ofar", "on", "splitting"]  # a small token joins all larger ones beside it


def test_running_elements_change_their_text(spark):
    rows = [(1, p, p, "F", 50.0 + p % 2, 86.0 + p % 3, 780.0, 790.0) for p in range(1, 6)] + [(1, p, 100 + p, "F", 50.0, 400.0, 300.0, 310.0) for p in range(1, 6)] + [(1, 1, 200, "F", 300.0, 400.0, 2.0, 8.0)]
    df = spark.createDataFrame(rows, "book int, page int, line int, font_key string, min_x double, max_x double, min_y double, max_y double")
    pages = df.select("book", "page").distinct().withColumn("page_height", F.lit(800.0))
    got = {(r["line"], r["kind"]) for r in layout.running_elements(df, ["book"], "page", pages).collect()}
    assert got == {(p, "header") for p in range(1, 6)}
    single = df.where("page = 1")
    assert {r["kind"] for r in layout.running_elements(single, ["book"], "page", pages.where("page = 1")).collect()} == {"header", "footer"}


def test_gap_profiles_fall_back_on_the_size(spark):
    rows = [("few", 1.0)] * 10 + [("none", 0.0)] * 80 + [("two", 1.0)] * 60 + [("two", 9.0)] * 60 + [("flat", 3.0)] * 60
    got = {r["font"]: r for r in gaps.profiles(spark.createDataFrame(rows, "font string, gap double"), spark.createDataFrame([("few", 10.0), ("none", 10.0), ("unseen", 20.0)], "font string, size double"), ["font"]).collect()}
    assert got["few"]["intra"] == 2.5 and got["few"]["separation"] == 0 and got["unseen"]["inter"] == 12 and got["unseen"]["total"] == 0
    assert got["none"]["total"] == 80 and not got["none"]["reliable"] and got["none"]["intra"] == 2.5 and got["flat"]["intra"] == 0.25
    assert got["two"]["reliable"] and 1 < got["two"]["intra"] < got["two"]["inter"] < 9


def test_value_map_tiers(spark):
    entries = spark.createDataFrame([("half-orc", "H", 0), ("Elf", "E", 1), ("elv", "V", 2)], "key string, value string, seq int")
    rows = spark.createDataFrame([("HALF   ORC",), (" elf ",), ("elx",), ("zzz",), (None,)], "r string")
    got = {r["r"]: (r["mapped"], r["match"]) for r in records.value_map(rows, "r", entries, fuzzy=True).collect()}
    assert got == {"HALF   ORC": ("H", "normalized"), " elf ": ("E", "exact"), "elx": ("E", "near"), "zzz": (None, None), None: (None, None)}
    plain = {r["r"]: r["mapped"] for r in records.value_map(rows, "r", entries).collect()}
    assert plain == {"HALF   ORC": None, " elf ": "E", "elx": None, "zzz": None, None: None}


def test_transforms(spark):
    df = spark.createDataFrame([("a wra-\nped line\n\nend-\nX‐\nyz",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.join_wrapped(F.col("t"))).collect()] == ["a wraped line end- Xyz", "", None]
    one = spark.createDataFrame([("2 D 6+3 KG.",)], "t string")
    t = F.col("t")
    got = one.select(T.dice_notation(t), T.strip_units(t, "kg."), T.regex_replace(t, "[0-9]", "<$0>", once=True), T.regex_extract(t, "(x)?D", 2)["problem"], T.regex_extract(t, "(a+)+")["problem"], T.split_text(t, "+"), T.run_chain(t, [{"kind": "regexExtract", "pattern": "zz"}, {"kind": "defaultValue", "value": "d"}])).first()
    assert tuple(got)[:5] == ("2d6 + 3KG.", "2 D 6+3", "<2> D 6+3 KG.", "group-missing", "refused") and got[5] == ["2 D 6", "3 KG."] and got[6] == "d"
    cast = one.select(T.cast_and_validate(t, "number", most=1, integer=True).alias("c")).first()["c"]
    assert cast["value"] == "2.0" and cast["problems"] == ["above-max"]
    assert one.select(T.cast_and_validate(t, "boolean").alias("c")).first()["c"]["problems"] == ["not-boolean"]


def test_spreads_pair_once(spark):
    def pic(page, i, x0, x1, y0=0.0, y1=100.0):
        return (1, page, i, (float(x0), y0, float(x1), y1))

    rows = [pic(1, 1, 300, 600), pic(2, 2, 0, 200), pic(2, 3, 1, 200), pic(3, 4, 0, 100), pic(3, 5, 100.5, 200), pic(5, 6, 400, 599, 5.0, 100.0), pic(6, 7, 0, 300)]
    box = "struct<minX:double,minY:double,maxX:double,maxY:double>"
    p = spark.createDataFrame(rows, f"book int, page int, id int, bbox {box}")
    pages = spark.createDataFrame([(1, k, (0.0, 0.0, 600.0, 800.0)) for k in range(1, 8)], f"book int, page int, box {box}")
    assert {(r["left"], r["right"]) for r in places.spread_pairs(p, pages, ["book"]).collect()} == {(4, 5), (1, 2)}


def test_labels_match_once(spark):
    box = "struct<minX:double,minY:double,maxX:double,maxY:double>"
    found = spark.createDataFrame([(1, 1, "a", (0.0, 0.0, 10.0, 10.0)), (1, 2, "b", (0.0, 0.0, 10.0, 9.0)), (1, 3, "c", (50.0, 0.0, 60.0, 10.0)), (2, 4, "a", (0.0, 0.0, 10.0, 10.0))], f"page int, id int, hash string, bbox {box}")
    labels = spark.createDataFrame([(1, 10, "a", (90.0, 0.0, 99.0, 9.0)), (1, 11, "x", (0.0, 0.0, 10.0, 10.0)), (1, 12, "y", (0.0, 0.0, 5.0, 5.0))], f"page int, label int, hash string, area {box}")
    got = {r["id"]: (r["label"], r["changed"]) for r in places.match_labels(found, labels).collect()}
    assert got == {1: (10, False), 2: (11, True), 3: (None, False), 4: (None, False)}


def test_names_and_hashes(spark):
    df = spark.createDataFrame([("Zażółć gęślą!",), ("__",), ("Пример 1",), ("a" * 80,), (None,)], "t string")
    got = [r[0] for r in df.select(imports.base_name(F.col("t"))).collect()]
    assert got == ["Zazolc_gesla", "image", "Пример_1", "a" * 60, None]
    fields = spark.createDataFrame([("s", "b", "number", True, 0.0, None, None), ("s", "a", "string", False, None, None, ["x", "y"])], "schema string, path string, type string, integer boolean, least double, most double, choices array<string>")
    one, two = imports.schema_fingerprint(fields, ["schema"]).first(), imports.schema_fingerprint(fields.where("path = 'a'"), ["schema"]).first()
    assert one["fingerprint"] != two["fingerprint"] and int(one["fingerprint"], 16) < 1 << 53


def test_polygons_and_shares(spark):
    square = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))])
    assert tuple(spark.range(1).select(G.inside_polygon(F.lit(2.0), F.lit(2.0), square), G.inside_polygon(F.lit(5.0), F.lit(2.0), square), G.inside_polygon(F.lit(1.0), F.lit(1.0), F.slice(square, 1, 2))).first()) == (True, False, False)
    r = detection.shares_of(G.rect(*[F.lit(float(v)) for v in (1, 1, 3, 2)]), G.rect(*[F.lit(float(v)) for v in (0, 0, 4, 4)]))
    assert tuple(spark.range(1).select(r.alias("r")).first()["r"]) == pytest.approx((0.25, 0.25, 0.75, 0.5))


def test_labels_in_lines(spark):
    df = spark.createDataFrame([("Armor HP: 12 (2d8) AC 15",), ("XHP 3",), ("HP",)], "t string")
    got = [r[0] for r in df.select(detection.label_value(F.col("t"), "HP:", ("HP:", "AC"))).collect()]
    assert got == ["12 (2d8)", None, ""]


def test_walk_keeps_and_restores_state(spark):
    from quillgrid.operators import painting

    i = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    rows = [
        ("restore",), ("state", None, 0.5, "Multiply"), ("group", None, None, None, "Luminosity"), ("state", None, 0.5), ("transform", [2.0, 0.0, 0.0, 3.0, 5.0, 7.0]), ("image", None, None, None, None, "a"), ("group_end",),
        ("image", None, None, None, None, "b"), ("form", [1.0, 0.0, 0.0, 1.0, 1.0, 1.0]), ("font", None, None, None, None, "F", 4.0), ("form_end",), ("state", None, 1.0, "Normal"), ("mask", None, None, None, None, "c"),
    ]
    ops = spark.createDataFrame([(1, k, *r, *[None] * (7 - len(r))) for k, r in enumerate(rows)], "page int, idx int, op string, matrix array<double>, alpha double, blend string, subtype string, obj_id string, size double")
    got = {r["obj_id"] or r["event"]: r for r in painting.walk(ops, ["page"]).collect()}
    m = [2.0, 0.0, 0.0, 3.0, 5.0, 7.0]
    assert got["a"]["opacity"] == 0.25 and got["a"]["blended"] and got["a"]["subtype"] == "Luminosity" and got["a"]["ctm"] == m
    assert got["b"]["opacity"] == 0.5 and got["b"]["subtype"] is None and got["b"]["ctm"] == m != i
    assert got["F"]["size"] == 8.0 and got["c"]["opacity"] is None and not got["c"]["blended"] and got["group_end"]["subtype"] == "Luminosity"


def test_rows_by_height(spark):
    from quillgrid.operators import painting

    e = spark.createDataFrame([(1, 0, 50.0, 10.0, 5.0, 10.0), (1, 1, 0.0, 18.0, 5.0, 10.0), (1, 2, 90.0, 0.0, 5.0, 5.0), (1, 3, 20.0, 5.0, 5.0, 14.0)], "page int, idx int, x double, y double, w double, h double")
    assert {r["idx"]: r["row"] for r in painting.rows_of(e, ["page"]).collect()} == {0: 0, 1: 0, 3: 0, 2: 1}


def test_groups_places_and_parts(spark):
    from quillgrid.operators import images

    box = "struct<minX:double,minY:double,maxX:double,maxY:double>"
    b = spark.createDataFrame([(1, 0, (0.0, 0.0, 10.0, 10.0)), (1, 1, (50.0, 0.0, 60.0, 10.0)), (1, 2, (11.0, 0.0, 20.0, 10.0)), (1, 3, (21.5, 0.0, 49.0, 10.0))], f"k int, seq int, bbox {box}")
    assert tuple(images.first_place(b, ["k"]).first()["place"]) == (0.0, 0.0, 60.0, 10.0)
    f = spark.createDataFrame([(1, 0, [0, 0]), (1, 1, None), (1, 2, [100, 100]), (1, 3, [10, 14]), (1, 4, [95, 120])], "g int, seq int, fingerprint array<int>")
    assert {r["seq"]: r["part"] for r in images.split_by_content(f, ["g"]).collect()} == {0: 0, 1: 0, 2: 1, 3: 0, 4: 2}


def test_leaves_of_a_schema(spark):
    schema = spark.createDataFrame([], "a int, b struct<c:string,d:struct<e:array<int>>>").schema
    assert detection.leaf_fields(schema) == [("a", "int"), ("b.c", "string"), ("b.d.e", "array<int>")]


def test_lines_against_all_pairs():
    rng = random.Random(4)
    for case in range(400):
        t: dict[str, list] = {c: [] for c in ("str", "along", "cross", "size", "width", "height", "font_key", "breaks", "last_breaks")}
        n, breaks = rng.choice([1, 2, 5, 12, 40]), 0
        for _ in range(n):
            breaks = breaks + (rng.random() < 0.3) if case % 2 else rng.randrange(3)
            size = rng.choice([10.0, 10.0, 6.0])
            token = (rng.choice(["a", "bc"]), float(rng.randrange(300)), float(rng.choice([0, 1, 3.5, 12, 24])), size, 12.0, size, rng.choice("FG"), int(breaks), int(breaks) + (rng.random() < 0.2))
            for c, v in zip(t, token, strict=True):
                t[c].append(v)
        root = list(range(n))
        for i, j in itertools.combinations(sorted(range(n), key=t["cross"].__getitem__), 2):
            big, small, off = max(t["size"][i], t["size"][j]), min(t["size"][i], t["size"][j]), t["cross"][j] - t["cross"][i]
            p, q = (i, j) if t["along"][i] <= t["along"][j] else (j, i)
            near = t["along"][q] - t["along"][p] - t["width"][p] <= big or t["breaks"][q] > t["last_breaks"][p]
            if near if off <= max(1, big * 0.3) else small / big <= 0.8 and off < big * 1.35:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
        got = sorted((x[8], x[3], x[5]) for x in lines._page_lines(t, 1, False))
        want = [[k for k in range(n) if root[k] == r] for r in sorted(set(root))]
        assert got == sorted((len(w), min(t["along"][k] for k in w), max(t["along"][k] + 12 for k in w)) for w in want)


def test_a_long_line_needs_no_pairs():
    t = tables.page_tokens([0, 1], ["w " * 20_000, "x " * 20_000])
    tracemalloc.start()
    (line,) = lines._page_lines(t, -1, True)  # a heading takes the smaller line below it
    assert line[8] == 40_000 and tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_lines_of_text_shuffle_no_words(spark):
    texts = ["Head  of it\nsecond \t line\n\n a  b\nc-\nd e", "", None, "\n" * 59 + "last\nnext page", "\t\nx \t", " one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = hygiene.with_boundary_counts(tables.emitted_items(docs), ["doc_id", "page"])
    items = items.groupBy("doc_id", "page", "line_no", "word_no").agg(F.min_by(F.struct("idx", "str", "x", "width", "a", "f", "breaks"), "idx").alias("i")).select("doc_id", "page", "i.*")
    font = F.when(F.col("a") == 14, "Head@14").otherwise("Body@10")
    tokens = items.select("doc_id", "page", "idx", "str", F.col("x").alias("along"), F.col("f").alias("cross"), F.col("a").alias("size"), "width", F.lit(10.0).alias("height"), font.alias("font_key"), "breaks", F.col("breaks").alias("last_breaks"))
    got = lines.cluster_text(tables.page_lines(docs), ["doc_id", "page"])
    assert sorted(got.collect()) == sorted(lines.cluster_lines(tokens, ["doc_id", "page"]).collect())
    plan = text_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Window" not in plan and plan.count("Generate") == 1  # words were made by Spark, and shuffled twice
