"""Pictures on pages: predicates, entries, mask evidence, correlation, units, strategy, kinds.

An occurrence is a row with page, idx (the order of painting on the page), obj_id and bbox.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geometry as G
from .perpage import per_page, with_field


def _overhangs(r: Column, page: Column) -> list[Column]:
    return [page["minX"] - r["minX"], page["minY"] - r["minY"], r["maxX"] - page["maxX"], r["maxY"] - page["maxY"]]


def bleeds(r: Column, page: Column) -> Column:
    """More than a point past an edge of the page."""
    return F.greatest(*_overhangs(r, page)) > K.BLEED_TOLERANCE


def flush(r: Column, page: Column) -> Column:
    """Under 0.7 of the page, past two edges at most, and by two points at most."""
    over = _overhangs(r, page)
    n = sum((F.when(o > K.BLEED_TOLERANCE, 1).otherwise(0) for o in over), F.lit(0))
    return (G.relative_area(r, page) < K.FLUSH_MAX_AREA) & (n <= 2) & (F.greatest(*over) <= K.FLUSH_MAX_OVERHANG)


def extreme_aspect(r: Column) -> Column:
    w, h = r["maxX"] - r["minX"], r["maxY"] - r["minY"]
    return (w > 0) & (h > 0) & F.coalesce(F.greatest(w, h) / F.nullif(F.least(w, h), F.lit(0.0)) >= K.EXTREME_ASPECT, F.lit(False))


def large(r: Column) -> Column:
    return F.greatest(r["maxX"] - r["minX"], r["maxY"] - r["minY"]) >= K.LARGE_SIDE


def mask_evidence(occ: DataFrame, page: list[str]) -> DataFrame:
    """occ with evidence and masks: whether a painting masks another, and the object it does.

    A luminosity group (group) or a mask painting (opcode) masks the first of the next five paintings of another object
    that it covers by 0.95; others that cover one of the three paintings before, at most three places earlier, by as much
    are masks by geometry: of the nearest. occ: the page's columns, idx, obj_id, bbox, luminosity, mask_painting. Look-backs
    and look-aheads are windows of fixed reach.
    """
    w = Window.partitionBy(*page).orderBy("idx")
    covers = lambda o: G.overlap_ratio(F.col("bbox"), o["bbox"]) >= K.MASK_OVERLAP
    near = F.struct("idx", "obj_id", "bbox")
    x = occ.withColumn("_back", F.array(*[F.lag(near, k).over(w) for k in range(1, K.MASK_LOOK_BACK + 1)])).withColumn("_next", F.array(*[F.lead(near, k).over(w) for k in range(1, K.MASK_LOOK_AHEAD + 1)]))
    ahead = F.get(F.filter("_next", lambda o: o.isNotNull() & ~o["obj_id"].eqNullSafe(F.col("obj_id")) & covers(o)), F.lit(0))
    back = F.get(F.filter("_back", lambda o: o.isNotNull() & (F.col("idx") - o["idx"] <= K.MASK_LOOK_BACK) & covers(o)), F.lit(0))
    hard = F.when(F.col("luminosity"), "group").when(F.col("mask_painting"), "opcode")
    x = x.withColumn("_hard", hard).withColumn("_ahead", ahead).withColumn("_behind", back)
    return x.withColumn("evidence", F.coalesce("_hard", F.when(F.col("_behind").isNotNull(), "geometry"))).withColumn("masks", F.when(F.col("_hard").isNotNull(), F.col("_ahead.obj_id")).otherwise(F.col("_behind.obj_id"))).drop("_back", "_next", "_hard", "_ahead", "_behind")


def entries(occ: DataFrame, pages: DataFrame, book: list[str]) -> DataFrame:
    """A row an object of the book: occurrences, pages (ascending), max_area (share of a page), evidence and masks of the strongest evidence
    (the first of equal ones), width and height (the first that are known), max_opacity (only if all paintings have one). Inline pictures
    (null obj_id) are each their own.

    occ: the book's columns, page, seq (order in the book), obj_id, bbox, width, height, opacity, evidence, masks. pages: the book's columns, page, box.
    """
    x = occ.join(pages, [*book, "page"], "left").withColumn("inline", F.when(F.col("obj_id").isNull(), F.col("seq")))
    share = F.when(F.col("box").isNotNull(), G.relative_area(F.col("bbox"), F.col("box"))).otherwise(0.0)
    strength = F.when(F.col("evidence") == "group", 3).when(F.col("evidence") == "opcode", 2).when(F.col("evidence") == "geometry", 1)
    best = F.max(F.when(strength.isNotNull(), F.struct(strength.alias("s"), (-F.col("seq")).alias("k"), "evidence", "masks")))
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("seq")))
    return x.groupBy(*book, "obj_id", "inline").agg(
        F.count("*").alias("occurrences"), F.array_sort(F.collect_set("page")).alias("pages"), F.max(share).alias("max_area"), best.alias("_best"), first("width").alias("width"), first("height").alias("height"),
        F.when(F.count("opacity") == F.count("*"), F.max("opacity")).alias("max_opacity"),
    ).select("*", F.col("_best.evidence").alias("evidence"), F.col("_best.masks").alias("masks"), F.coalesce(F.col("_best.evidence").isin("group", "opcode"), F.lit(False)).alias("is_mask")).drop("_best")


def masked_objects(entries: DataFrame, book: list[str]) -> DataFrame:
    """entries with is_masked: a mask by group or opcode masks them."""
    hard = entries.where("is_mask AND masks IS NOT NULL").select(*[F.col(c).alias(f"_{c}") for c in book], F.col("masks").alias("_m")).distinct().withColumn("_hit", F.lit(True))
    on = F.col("obj_id") == F.col("_m")
    for c in book:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return entries.join(hard, on, "left").withColumn("is_masked", F.coalesce("_hit", F.lit(False))).drop("_hit", "_m", *[f"_{c}" for c in book])


def member_counts(rows: DataFrame, cluster: str) -> DataFrame:
    """rows with members: how many share their cluster; 1 without one."""
    w = Window.partitionBy(cluster)
    return rows.withColumn("members", F.when(F.col(cluster).isNull(), 1).otherwise(F.count("*").over(w)))


def strategy() -> Column:
    """struct(strategy, reason) of a unit, from columns vector_only, text_over, co_share, inline, fits, is_masked, members, crosses, mostly_visible; the first rule that fits."""
    raw = ~F.col("inline") & F.col("fits") & (F.col("is_masked") | (F.col("members") > 1))
    visible = F.col("is_masked") & F.col("mostly_visible")
    rules = [
        (F.col("vector_only"), "region-render", "Z2-vector-only-no-image"), (F.col("text_over"), "region-render", "Z2-text-over-picture-is-content"),
        (raw & (F.col("co_share") >= K.CO_MEMBER_SHARE) & (F.col("crosses") | visible), "region-render", "Z2-cluster-has-significant-members"),
        (F.col("crosses") & raw, "direct", "Z2-text-crosses-region-prefer-raw-resource"), (visible & raw, "direct", "Z2-masked-raw-resource-fits-placement"),
        (F.col("is_masked"), "region-render", "Z2-masked-direct-would-omit-mask"), (F.col("members") > 1, "region-render", "Z2-cluster-composition-is-content"), (F.lit(True), "direct", "Z2-single-clean-image"),
    ]
    return F.coalesce(*[F.when(when, F.struct(F.lit(how).alias("strategy"), F.lit(why).alias("reason"))) for when, how, why in rules])


def target_edge(intrinsic: Column, area: Column, default: Column, most: Column) -> Column:
    """Long edge in pixels to render at: what the pictures (intrinsic: array of their long edges) have and a margin, not under their kind's least; without pictures the default, not under the least of a known area."""
    least = F.when(area >= K.SCENE_AREA, K.SCENE_EDGE).when(area >= K.HANDOUT_AREA, K.HANDOUT_EDGE).when(area.isNotNull(), K.PORTRAIT_EDGE)
    have = F.array_max(intrinsic) * K.EDGE_MARGIN
    wanted = F.when(F.size(intrinsic) > 0, F.greatest(have, F.coalesce(least, F.lit(K.PORTRAIT_EDGE)))).otherwise(F.greatest(default, F.coalesce(least, default)))
    return F.least(wanted, most)


def target_kind(content: Column, width: Column, height: Column, near: Column) -> Column:
    """portrait, scene, handout or unknown."""
    edge, aspect = F.greatest(width, height), width / height
    return F.when(~content, "unknown").when(near & (edge <= 400) & aspect.between(0.6, 1.1), "portrait").when((edge >= 1200) & aspect.between(0.5, 2.2), "scene").when(edge >= 400, "handout").otherwise("unknown")


def painted_over(occ: DataFrame, page: list[str], share: float = 0.75) -> DataFrame:
    """occ with covered: whether one later painting of the page covers `share` of its area."""
    later = occ.select(*page, F.col("idx").alias("_i"), F.col("bbox").alias("_b"))
    pairs = occ.select(*page, "idx", "bbox").join(later, page).where((F.col("_i") > F.col("idx")) & G.overlaps(F.col("bbox"), F.col("_b")))
    hit = pairs.where(G.area(G.intersection(F.col("bbox"), F.col("_b"))) >= share * G.area(F.col("bbox"))).select(*page, "idx").distinct().withColumn("covered", F.lit(True))
    return occ.join(hit, [*page, "idx"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def top_painting(occ: DataFrame, page: list[str]) -> DataFrame:
    """The page's columns, idx, obj_id of its last painting."""
    return occ.groupBy(*page).agg(F.max_by(F.struct("idx", "obj_id"), "idx").alias("t")).select(*page, "t.*")


def correlate(entries: DataFrame, book: list[str]) -> DataFrame:
    """entries (the book's columns, obj_id, occurrences, bbox, width, height) with canonical: of those with one bbox (to half a point)
    and pixel size that of most occurrences, ties: the least id. Inline ones stay alone."""
    q = lambda v: F.floor(v / 0.5 + 0.5)
    key = [*book, *[q(F.col(f"bbox.{c}")) for c in ("minX", "minY", "maxX", "maxY")], "width", "height"]
    w = Window.partitionBy(*key)
    return entries.withColumn("_r", -F.dense_rank().over(w.orderBy("obj_id"))).withColumn("canonical", F.when(F.col("obj_id").isNull(), None).otherwise(F.max(F.when(F.col("obj_id").isNotNull(), F.struct("occurrences", "_r", "obj_id"))).over(w)["obj_id"])).drop("_r")


def correlated_pages(entries: DataFrame, book: list[str]) -> DataFrame:
    """entries (with pages and canonical) with shared_pages: distinct pages of all that share the canonical one; an inline picture's own."""
    every = entries.where("canonical IS NOT NULL").select(*book, "canonical", F.explode("pages").alias("p")).groupBy(*book, "canonical").agg(F.countDistinct("p").alias("shared_pages"))
    return entries.join(every, [*book, "canonical"], "left").withColumn("shared_pages", F.coalesce("shared_pages", F.size("pages").cast("long")))


def common_background(occ: DataFrame, pages: DataFrame, book: list[str]) -> DataFrame:
    """The book's columns and common: whether pictures shared by 5 pages or more (shared_pages) cover 0.9 of at least half of its pages."""
    x = occ.where("shared_pages >= 5").join(pages, [*book, "page"])
    full = G.area(G.intersection(F.col("bbox"), F.col("box"))) / F.nullif(G.area(F.col("box")), F.lit(0.0)) >= 0.9
    got = x.where(full).groupBy(*book).agg(F.countDistinct("page").alias("n"))
    return pages.groupBy(*book).agg(F.count("*").alias("total")).join(got, book, "left").select(*book, (F.coalesce("n", F.lit(0)) >= 0.5 * F.col("total")).alias("common"))


def hue_neighbours(pictures: DataFrame, book: list[str], tolerance: float = 15, least: int = 6) -> DataFrame:
    """pictures (the book's columns, id, hue in degrees) with near and ornament: how many of the book, itself too, lie within `tolerance` on the circle; at least `least` make ornaments.

    Counts by hue are compared, not pictures: as many cells as the book has different hues.
    """
    hues = pictures.groupBy(*book, "hue").agg(F.count("*").alias("n"))
    other = hues.select(*book, F.col("hue").alias("_h"), F.col("n").alias("_n"))
    near = hues.join(other, book).where(G.hue_distance(F.col("hue"), F.col("_h")) <= tolerance).groupBy(*book, "hue").agg(F.sum("_n").alias("near"))
    return pictures.join(near, [*book, "hue"]).withColumn("ornament", F.col("near") >= least)


def first_class(background: bool = False) -> Column:
    """struct(kind, reason): a picture's class before others are looked at; the first rule that fits.

    Columns: obj_id, evidence, max_area, max_opacity, width, height (pixels), shared_pages, is_masked, blended, mirrored (painted in two
    orientations on one page), bleeds, is_flush, extreme, is_large (300 points), text (coverage by text, the most of its places) and center_text
    (of its middle half), word_text and center_words (by words; null: not known), common_background, painted_over. background: pictures that bleed are taken for content.
    """
    c, lit = F.col, F.lit
    area, alpha = c("max_area"), c("max_opacity")
    opaque = alpha.isNull() | (alpha >= 0.95)
    clear = F.coalesce(alpha <= 0.65, lit(False))
    backdrop = F.coalesce(alpha <= F.when((area >= 0.1) & c("blended"), 0.35).otherwise(0.25), lit(False))
    known = (c("width") > 0) & (c("height") > 0)
    edge = F.when(known, F.greatest("width", "height"))
    aspect = F.when(known, edge / F.least("width", "height"))
    masked = c("obj_id").isNotNull() & c("is_masked")
    sure = lambda x: F.coalesce(x, lit(False))
    text_on = F.when(c("word_text").isNotNull(), c("word_text") >= 0.15).otherwise(c("center_text") >= 0.15)
    covered = c("center_text") >= F.when(c("is_flush"), 0.4).otherwise(0.15)
    big = area >= 0.4
    often, bleeds_, geometry = c("shared_pages") >= 5, c("bleeds"), sure(c("evidence") == "geometry")
    over = (c("text") >= 0.15) & ~c("is_large")
    rules = [
        (c("evidence") == "group", "mask", "Z1-mask-evidence-group"), (c("evidence") == "opcode", "mask", "Z1-mask-evidence-opcode"),
        ((area < 0.05) & c("mirrored"), "decoration", "Z25-repeated-on-page"),
        (often & bleeds_, "decoration", "Z1-multi-page-correlated"), (often & c("extreme"), "decoration", "Z14-repeated-extreme-aspect-ratio"), (often, "undecided", "Z11-repeated-no-bleed-evidence"),
        (bleeds_ & lit(not background) & c("common_background") & (c("shared_pages") == 1) & (area >= 0.9) & opaque & ~c("blended") & text_on & ~c("painted_over"), "undecided", "Z1-full-page-document"),
        (bleeds_ & covered, *(("content", "Z1-full-bleed-forced-content") if background else ("decoration", "Z1-full-bleed-background"))),
        (bleeds_ & masked & (area >= 0.3) & (area < 0.75) & ~clear & ~(~opaque & c("blended")), "undecided", "Z12-bleeding-masked-large-picture"), (bleeds_ & masked, "decoration", "Z12-bleeding-masked-cutout"),
        (bleeds_ & clear & (area >= 0.3) & ~backdrop, "undecided", "Z12-bleeding-translucent-panel"), (bleeds_ & clear, "decoration", "Z12-bleeding-translucent-overlay"),
        (bleeds_ & sure(aspect >= 3) & (area < 0.1), "decoration", "Z24-small-bleeding-strip"), (bleeds_ & c("is_flush"), "undecided", "Z12-flush-no-center-text-evidence"), (bleeds_, "undecided", "Z12-bleeding-no-center-text-evidence"),
        (geometry & big & c("is_large"), "content", "Z2-strong-content-overrides-weak-geometry-evidence"), (geometry & big, "undecided", "Z1-conflicting-geometry-mask-vs-large-area"), (geometry, "undecided", "Z1-weak-geometry-mask-evidence"),
        (over & (area >= 0.03) & opaque & c("blended"), "undecided", "Z9-text-beside-blended-picture"), (over & area.between(0.02, 0.1) & opaque, "undecided", "Z9-text-over-small-picture"),
        (over & (area >= 0.02) & opaque & sure(c("center_words") <= 0.03), "undecided", "Z9-text-wraps-around-picture"), (over, "decoration", "Z9-high-body-text-coverage"),
        (c("center_text") >= 0.15, "undecided", "Z10-high-center-text-coverage"), (big, "content", "Z1-large-relative-area"), (c("evidence").isNull() & (area >= 0.09), "content", "Z2-moderate-area-no-mask-evidence"),
        (masked & backdrop & sure(edge <= 300) & (area < 0.06), "decoration", "Z20-small-translucent-masked-raster"), (masked & sure(alpha <= 0.5) & sure(aspect >= 3) & (area < 0.06), "decoration", "Z25-translucent-masked-strip"),
        (masked & sure(aspect >= 5) & (area < 0.15), "decoration", "Z23-masked-strip"), (masked & sure(edge <= 300) & sure(aspect >= 2) & (area < 0.03), "decoration", "Z15-small-masked-raster"),
        (c("extreme"), "undecided", "Z13-extreme-aspect-ratio-undecided"), (lit(True), "undecided", "Z1-no-strong-signal"),
    ]
    return F.coalesce(*[F.when(when, F.struct(lit(kind).alias("kind"), lit(why).alias("reason"))) for when, kind, why in rules])


def keep_one_of_equal(pictures: DataFrame, book: list[str]) -> DataFrame:
    """pictures (the book's columns, id, hash, occurrences, area, pixels) with canonical and copies: of those of one hash that of most occurrences, ties: the least id. From 0.05 of the page on the pixels' hash must be equal too."""
    key = F.when(F.col("area") >= 0.05, F.concat_ws("|", "hash", "pixels")).otherwise(F.col("hash"))
    w = Window.partitionBy(*book, "_key").orderBy(F.desc("occurrences"), "id")
    x = pictures.withColumn("_key", key)
    return x.withColumn("canonical", F.first("id").over(w)).withColumn("copies", F.count("*").over(Window.partitionBy(*book, "_key"))).drop("_key")


def components(rows, links) -> list[int]:
    """The least index that links lead to, of each of so many rows."""
    root = list(range(rows))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(rows)]


def _boxes(boxes) -> np.ndarray:
    return np.array([[b["minX"], b["minY"], b["maxX"], b["maxY"]] for b in boxes], float).reshape(-1, 4)


def _touching(boxes: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of boxes that overlap, by `least` of the smaller one at least; found from left to right, so that far ones never meet."""
    out = []
    order = np.argsort(boxes[:, 0], kind="stable")
    x0, y0, x1, y1 = boxes[order].T
    area = (x1 - x0) * (y1 - y0)
    for i in range(len(order)):
        j = np.arange(i + 1, np.searchsorted(x0, x1[i]))
        w = np.minimum(x1[i], x1[j]) - x0[j]
        h = np.minimum(y1[i], y1[j]) - np.maximum(y0[i], y0[j])
        small = np.minimum(area[i], area[j])
        hit = (w > 0) & (h > 0) & (x0[i] < x1[j]) & ((least <= 0) | ((small > 0) & (w * h >= least * small)))
        out += [(int(order[i]), int(order[k])) for k in j[hit]]
    return out


def overlap_clusters(items: DataFrame, page: list[str], least: float = 0.0) -> DataFrame:
    """items (the page's columns, idx, bbox) with cluster, from 0 in order of each page's first items: linked by overlap (of `least` of the smaller area), however many between. Pages go to tasks whole."""

    items = items.drop("cluster")
    names = items.columns

    def work(t: dict[str, list]) -> list[tuple]:
        numbers: dict[int, int] = {}
        found = [numbers.setdefault(r, len(numbers)) for r in components(len(t["idx"]), _touching(_boxes(t["bbox"]), least))]
        return list(zip(*(t[c] for c in names), found, strict=True))

    return per_page(items, page, ["idx"], with_field(items, "cluster", "long"), work)


def candidate_groups(items: DataFrame, page: list[str]) -> DataFrame:
    """items (the page's columns, idx, bbox, kind: alone, anchor or rest) with group, from 0: those that stand alone are each one; anchors are linked where they overlap
    by 0.2 of the smaller one; another joins the anchor it shares most area with (the first of equal ones), if that is as much; what is left is linked by any overlap."""

    items = items.drop("group")
    names = items.columns

    def work(t: dict[str, list]) -> list[tuple]:
        boxes, kind = _boxes(t["bbox"]), t["kind"]
        anchors, group = [k for k, x in enumerate(kind) if x == "anchor"], {}
        of = {anchors[i]: ("a", anchors[r]) for i, r in enumerate(components(len(anchors), _touching(boxes[anchors], K.GROUP_OVERLAP)))}
        left = []
        for k, x in enumerate(kind):
            if x == "alone":
                of[k] = ("s", k)
            elif x == "rest":
                w = np.minimum(boxes[k, 2], boxes[anchors, 2]) - np.maximum(boxes[k, 0], boxes[anchors, 0])
                h = np.minimum(boxes[k, 3], boxes[anchors, 3]) - np.maximum(boxes[k, 1], boxes[anchors, 1])
                shared = np.where((w > 0) & (h > 0), w * h, 0.0)
                best = int(shared.argmax()) if len(anchors) else -1
                size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
                if best >= 0 and shared[best] > 0 and shared[best] >= K.GROUP_OVERLAP * min(size(boxes[k]), size(boxes[anchors[best]])):
                    of[k] = of[anchors[best]]
                else:
                    left.append(k)
        of |= {left[i]: ("r", left[r]) for i, r in enumerate(components(len(left), _touching(boxes[left], 0.0)))}
        found = [group.setdefault(of[k], len(group)) for k in range(len(kind))]
        return list(zip(*(t[c] for c in names), found, strict=True))

    return per_page(items, page, ["idx"], with_field(items, "group", "long"), work)


def units(items: DataFrame, page: list[str]) -> DataFrame:
    """The page's columns, group, representative (idx), bbox, members, kind, reason of groups of items (with area, class, reason, translucent, is_masked; a page's box).

    The largest member stands for the unit (the first of equal ones); an undecided translucent one gives way to the largest solid masked
    one of 0.05 of the page or more. Several members that together cover more than 0.85 of the page are undecided, without a signal.
    """
    size = F.struct("area", (-F.col("idx")).alias("k"), "idx", "class", "reason", "translucent")
    solid = ~F.col("translucent") & F.col("is_masked") & (F.col("area") >= K.CO_MEMBER_SHARE)
    g = items.groupBy(*page, "group").agg(
        F.max(size).alias("most"), F.max(F.when(solid, size)).alias("photo"), F.count("*").alias("members"), F.first("box").alias("box"),
        G.rect(F.min("bbox.minX"), F.min("bbox.minY"), F.max("bbox.maxX"), F.max("bbox.maxY")).alias("bbox"),
    )
    mark = F.col("most.translucent") & (F.col("most.class") == "undecided") & F.col("photo").isNotNull()
    g = g.withColumn("best", F.when(mark, F.col("photo")).otherwise(F.col("most")))
    wide = (F.col("members") > 1) & (G.relative_area(F.col("bbox"), F.col("box")) > 0.85)
    return g.select(*page, "group", F.col("best.idx").alias("representative"), "bbox", "members", F.when(wide, "undecided").otherwise(F.col("best.class")).alias("kind"), F.when(wide, "Z1-no-strong-signal").otherwise(F.col("best.reason")).alias("reason"))


def split_by_content(entries: DataFrame, group: list[str], most: float = 12) -> DataFrame:
    """entries (the group's columns, seq, fingerprint) with part, from 0: in order of seq, each joins the first part whose first member's fingerprint differs by at most `most` on average, or begins one; those without a fingerprint are of the first."""

    def work(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("seq", kind="stable").reset_index(drop=True)
        heads, out = [], []
        for f in t["fingerprint"]:
            if f is None:
                out.append(0)
                continue
            f = np.asarray(f, float)
            k = next((k for k, h in enumerate(heads) if np.abs(h - f).mean() <= most), len(heads))
            if k == len(heads):
                heads.append(f)
            out.append(k)
        t["part"] = out
        return t

    return entries.groupBy(*group).applyInPandas(work, with_field(entries.drop("part"), "part", "long"))


def first_place(boxes: DataFrame, key: list[str], gap: float = 2.0) -> DataFrame:
    """The key's columns and place: a picture's first box (in order of seq) united with all that lie on it or within `gap` points, and again, until none does."""

    def work(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("seq", kind="stable")
        rest = _boxes(t["bbox"])
        at, rest = rest[0].copy(), rest[1:]
        while len(rest):
            near = (rest[:, 0] <= at[2] + gap) & (rest[:, 2] >= at[0] - gap) & (rest[:, 1] <= at[3] + gap) & (rest[:, 3] >= at[1] - gap)
            if not near.any():
                break
            at = np.concatenate([np.minimum(at[:2], rest[near, :2].min(0)), np.maximum(at[2:], rest[near, 2:].max(0))])
            rest = rest[~near]
        return pd.DataFrame([{**{c: t[c].iloc[0] for c in key}, "minX": at[0], "minY": at[1], "maxX": at[2], "maxY": at[3]}])

    kinds = dict(boxes.dtypes)
    out = boxes.groupBy(*key).applyInPandas(work, ", ".join([*(f"`{c}` {kinds[c]}" for c in key), "minX double, minY double, maxX double, maxY double"]))
    return out.select(*key, F.struct("minX", "minY", "maxX", "maxY").alias("place"))


def second_class(pictures: DataFrame, book: list[str], tiny: bool = True) -> DataFrame:
    """pictures with kind and reason as others of their page change them; the first rule that fits.

    pictures: the book's columns, page, idx (painting order), id, bbox, area (share of the page), kind, reason, opacity (null: solid), blended, is_masked, backdrop,
    width, height. Lettering on a cover or title page, fasteners over an edge, translucent grounds under a picture, elements and backgrounds of form pages, tiny
    ones, page backgrounds under content, and translucent copies become decoration. Pairs are of pictures of one page whose boxes meet.
    """
    c = F.col
    picture = c("kind").isin("content", "undecided")
    page = Window.partitionBy(*book, "page")
    x = pictures.withColumn("_shown", picture & (c("area") >= 0.03))
    small = c("area") < 0.06
    x = x.withColumns({
        "_tiny": F.count_if((c("kind") == "undecided") & (c("area") < 0.005)).over(page), "_small": F.count_if(small & (c("kind") != "mask")).over(page), "_all_small": F.count_if(small).over(page),
        "_plain": F.count_if(c("reason") == "Z1-no-strong-signal").over(page), "_size": G.area(c("bbox")),
    })
    other = x.where("_shown").select(*book, "page", c("idx").alias("o_idx"), c("bbox").alias("o_bbox"), c("area").alias("o_area"), c("kind").alias("o_kind"), c("opacity").alias("o_opacity"), c("backdrop").alias("o_backdrop"), c("_size").alias("o_size"))
    p = x.where("_size > 0").join(other, [*book, "page"]).where((c("idx") != c("o_idx")) & G.overlaps(c("bbox"), c("o_bbox")))
    shared = G.area(G.intersection(c("bbox"), c("o_bbox")))
    on, later = shared / c("_size"), c("o_idx") > c("idx")
    flags = p.groupBy(*book, "page", "idx").agg(
        F.bool_or(~later & (c("o_area") >= 0.9) & (c("page") == 1) & (on >= 0.9)).alias("_cover"),
        F.bool_or(~later & (c("o_kind") == "content") & (c("_size") <= 0.125 * c("o_size")) & on.between(0.2, 0.95)).alias("_edge"),
        F.bool_or(later & ~c("o_backdrop") & c("o_opacity").isNull() & (shared >= 0.8 * c("o_size")) & (on >= 0.25)).alias("_over"),
        F.bool_or(later & (c("o_kind") == "content") & (c("o_area") >= 0.05)).alias("_content"),
        F.bool_or(~later & (on >= 0.9) & (shared >= 0.6 * c("o_size"))).alias("_copy"),
    )
    x = x.join(flags, [*book, "page", "idx"], "left")
    yes = lambda n: F.coalesce(c(n), F.lit(False))
    fastener = yes("_edge") & ~c("blended") & c("reason").isin("Z1-no-strong-signal", "Z12-flush-no-center-text-evidence") & (c("area") <= 0.02)
    x = x.withColumn("_f", fastener).withColumn("_fn", F.count_if("_f").over(page))
    spots = x.where("_f AND _fn <= 2").groupBy(*book).agg(F.countDistinct("page").alias("_pages"))
    x = x.join(spots, book, "left")
    wide = lambda by: F.coalesce(c("width") >= by * c("height"), F.lit(False))
    title = (c("page") <= 3) & (c("reason") == "Z1-no-strong-signal") & wide(1.6) & (c("_plain") <= 2)
    cover = yes("_cover") & (c("area") < 0.9) & wide(1.5)
    form = F.lit(tiny) & ((c("_tiny") >= 15) | (c("_all_small") >= 20))
    undecided = c("kind") == "undecided"
    rules = [
        (picture & (cover | title), "Z33-lettering-over-cover"), (c("_f") & (c("_fn") <= 2) & (F.coalesce("_pages", F.lit(0)) >= 3), "Z31-fastener-over-picture-edge"),
        (picture & c("is_masked") & c("backdrop") & (c("area") <= 0.15) & yes("_over"), "Z34-translucent-ground-under-picture"),
        (form & undecided & (c("reason") != "Z9-text-over-small-picture") & (c("area") >= 0.005) & (c("area") < 0.06), "Z18-form-page-element"),
        (F.lit(tiny) & undecided & (c("area") >= 0.95) & (c("_small") >= 15), "Z18-form-page-background"), (F.lit(tiny) & undecided & (c("area") < 0.005), "Z16-tiny-undecided"),
        (c("_shown") & (c("page") > 1) & undecided & (c("area") >= 0.95) & yes("_content"), "Z22-page-background-under-content"),
        (c("_shown") & F.coalesce(c("opacity") <= 0.65, F.lit(False)) & yes("_copy"), "Z19-translucent-copy-of-picture"),
    ]
    why = F.coalesce(*[F.when(when, name) for when, name in rules])
    return x.withColumn("_why", why).select(*[c(n) for n in pictures.columns if n not in ("kind", "reason")], F.when(c("_why").isNotNull(), "decoration").otherwise(c("kind")).alias("kind"), F.coalesce("_why", "reason").alias("reason"))
