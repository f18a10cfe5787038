"""Operator 6: mixing sources to target weights by entropy balancing.

Each document gets a rate q, how often the mix takes it. Of all rates that meet the token constraints (for each
source, the sum of size * q is its target) and q <= cap, those nearest to 1 in relative entropy over documents are
q = min(cap, exp(lambda * size / mean size)), with a multiplier lambda a source: documents are tilted exponentially
by their sizes, upwards where the source must grow and downwards where it must shrink. The multipliers solve a convex
dual; a Newton step sums its gradient and curvature in Spark, over a table of how many documents have each size.
Rates become copies: floor(q), and one more with a chance of its fraction, by a hash; the chances of a source are
shifted together, by a distributed search over sums of sizes, so that its words come as near to the target
as whole documents allow; what is left then is filled up by smaller documents in the same way.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WORD = r"[^\x20\x09-\x0D]+"
CELLS = 1 << 12


def key_of(col: str):
    """A source as a string key: ascending by code point, null last."""
    return F.when(F.col(col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(col)))


def source_targets(sizes: dict[str, int], *, weights: tuple[int, ...], total: float, cap: float) -> dict[str, float]:
    """Targets in proportion to the weights, which repeat over the sorted keys, none above cap times its size; the excess is reshared by weight."""
    w = {k: weights[i % len(weights)] for i, k in enumerate(sorted(sizes))}
    fixed: dict[str, float] = {}
    while True:
        free = [k for k in w if k not in fixed]
        left, sum_w = total - sum(fixed.values()), sum(w[k] for k in free)
        share = {k: left * w[k] / sum_w for k in free} if free else {}
        over = [k for k in free if share[k] > cap * sizes[k]]
        if not over:
            return fixed | share
        fixed |= {k: float(cap * sizes[k]) for k in over}


def rate_of(cap: float) -> Column:
    """A document's rate, from columns size, mean and lam: its source's multiplier; null: every rate is the cap, or 0 where the target is none."""
    tilt = F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0))
    return F.when(F.col("target") <= 0, F.lit(0.0)).when(F.col("lam").isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(tilt)))


def solve(hist: DataFrame, state: dict[str, dict], *, cap: float, steps: int = 80) -> None:
    """Put the multiplier `lam` of every source into state: key -> target, size, mean. hist: key, size and n, how many documents have that size.

    Newton's method on the dual, a Spark aggregation a step. Multipliers of sources are independent, so the curvature
    is diagonal. The gradient ascends in the multiplier: its sign bounds the root, and a step that leaves the bounds
    (where all but few rates are capped, the curvature tells little) halves them instead. Sums are of decimals, so
    that reruns agree. A source whose target is cap times its size or more, or none, has no multiplier.
    """
    for s in state.values():
        s["lam"] = None if s["target"] >= cap * s["size"] * (1 - 1e-12) or s["target"] <= 0 else math.log(s["target"] / s["size"])
        s["low"], s["high"] = -60.0 * s["mean"], 1.01 * math.log(cap) * s["mean"]  # a document of one word: rate 0, or the cap
    open_ = [k for k, s in state.items() if s["lam"] is not None]
    hist = hist.where("size > 0")
    for _ in range(steps):
        if not open_:
            return
        table = C.broadcast_if_small(hist.sparkSession.createDataFrame([(k, state[k]["lam"], state[k]["mean"], state[k]["target"]) for k in open_], "key string, lam double, mean double, target double"), len(open_))
        q = rate_of(cap)
        mass = F.col("n") * F.col("size") * q
        sums = [F.sum(x.cast("decimal(30,6)")).cast("double").alias(name) for x, name in ((mass, "mass"), (F.when(q < cap, mass * F.col("size") / F.col("mean")).otherwise(0.0), "curve"))]
        for r in hist.join(table, "key").groupBy("key").agg(*sums).collect():  # a row a source
            s = state[r["key"]]
            gradient = r["mass"] - s["target"]
            if abs(gradient) <= 1e-6 + 1e-9 * s["target"] or s["high"] - s["low"] < 1e-12 * s["mean"]:
                open_.remove(r["key"])
                continue
            s["low" if gradient < 0 else "high"] = s["lam"]
            step = s["lam"] - gradient / r["curve"] if r["curve"] > 0 else math.inf
            s["lam"] = step if s["low"] < step < s["high"] else (s["low"] + s["high"]) / 2


def _search(slim: DataFrame, want: dict[str, float]) -> dict[str, tuple[int, float]]:
    """By key: the largest threshold h of the number u (36 bits) such that the sizes of rows below it sum to at most `want`, and that sum.

    slim: key, size, u. Three aggregations over 4,096 cells a source, each within one cell of the last; a row a source comes back.
    """
    spark = slim.sparkSession
    at = {k: (0, 0) for k in want}
    for level in range(3):
        shift = CELLS ** (2 - level)
        table = C.broadcast_if_small(spark.createDataFrame([(k, h, float(want[k] - below)) for k, (h, below) in at.items()], "key string, h long, room double"), len(at))
        near = slim.join(table, "key").where((F.col("u") >= F.col("h")) & (F.col("u") < F.col("h") + shift * CELLS))
        cells = near.groupBy("key", "room", F.floor((F.col("u") - F.col("h")) / shift).alias("cell")).agg(F.sum("size").alias("size"))
        cells = cells.withColumn("upto", F.sum("size").over(Window.partitionBy("key").orderBy("cell")))  # at most 4,096 rows a source
        over = F.col("upto") > F.col("room")
        got = cells.groupBy("key").agg(F.min(F.when(over, F.col("cell"))).alias("cell"), F.max(F.when(~over, F.col("upto"))).alias("below"))
        rows = {r["key"]: (r["cell"], r["below"]) for r in got.collect()}
        for k, (h, below) in at.items():
            cell, more = rows.get(k, (None, None))
            at[k] = (h + shift * (CELLS if cell is None else cell), below + (more or 0))
    return at


def _nearest(rest: DataFrame, left: dict[str, float]) -> dict[str, tuple[int, int]]:
    """By key: (hash, size) of the row whose size is nearest to what is left, if taking it comes nearer."""
    table = C.broadcast_if_small(rest.sparkSession.createDataFrame(list(left.items()), "key string, want double"), len(left))
    near = rest.join(table, "key").where("size < 2 * want").groupBy("key").agg(F.min(F.struct(F.abs(F.col("size") - F.col("want")).alias("off"), "u0", "size")).alias("m"))
    return {r["key"]: (r["m"]["u0"], r["m"]["size"]) for r in near.collect()}


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), scale: float = 1.5, cap: int = 2, source: str = "source", key: str = "doc_id", rounds: int = 3) -> DataFrame:
    """key, size, source_size, target, taken, copies, rate and u0 of every row of docs (key, text, source).

    size: the words of the text, null: 0. A source's target and its size count all its rows; null is a
    source of its own, last in order. Rows of one source with equal key and text are taken alike (u0 is
    their hash). A document is taken whole, copies times (0 to cap); one without words as often as its rate says.
    An empty table gives none.
    """
    spark = docs.sparkSession
    salted = [F.pmod(F.xxhash64(F.lit(k), F.col(key).cast("string"), F.xxhash64("text")), F.lit(CELLS**3)).alias(f"u{k}") for k in range(rounds)]
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    slim = C.cut(docs.select(F.col(key).alias("id"), key_of(source).alias("key"), words.alias("size"), *salted), "mix")
    hist = C.cut(slim.groupBy("key", "size").agg(F.count("*").alias("n")), "mix-sizes")
    state = {r["key"]: {"size": int(r["size"]), "mean": r["size"] / max(1, r["docs"] or 0)} for r in hist.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("docs")).collect()}  # a row a source
    if not state:
        return spark.createDataFrame([], f"`{key}` {dict(docs.dtypes)[key]}, size long, source_size long, target double, taken long, copies int, rate double, u0 long")
    targets = source_targets({k: s["size"] for k, s in state.items()}, weights=weights, total=scale * sum(s["size"] for s in state.values()), cap=cap)
    for k, s in state.items():
        s["target"] = float(targets[k])
    solve(hist, state, cap=cap)
    rows = [(k, s["size"], s["target"], s["mean"], s["lam"]) for k, s in state.items()]
    table = C.broadcast_if_small(spark.createDataFrame(rows, "key string, source_size long, target double, mean double, lam double"), len(rows))
    rated = slim.join(table, "key").withColumn("rate", rate_of(cap)).withColumn("base", F.floor(F.col("rate") + 1e-9).cast("int"))
    # v orders documents by how much their chance must be raised for one more copy: 1 is the chance itself.
    v = F.col("u0") / float(CELLS**3) / (F.col("rate") - F.col("base"))
    rated = rated.withColumn("v0", F.when(F.col("rate") - F.col("base") > 1e-9, F.least(F.floor(v / (1 + v) * CELLS**3), F.lit(CELLS**3 - 1))))
    slim = C.cut(rated.drop("mean", "lam"), "mix-rates")
    sure = {r["key"]: int(r["size"] or 0) for r in slim.groupBy("key").agg(F.sum(F.col("size") * F.col("base")).alias("size")).collect()}
    left = {k: max(0.0, s["target"] - sure[k]) for k, s in state.items()}

    taken, rest = F.lit(False), slim  # what has its extra copy, and the others
    for k in range(rounds):
        # The first round takes documents of any size that fits, by their chances; later ones fill what is left with those of half of it at most.
        open_ = {x: v for x, v in left.items() if v >= 1}
        if not open_:
            break
        most = {x: v if k == 0 else v / 2 for x, v in open_.items()}
        table = C.broadcast_if_small(spark.createDataFrame(list(most.items()), "key string, most double"), len(most))
        u = F.col("v0") if k == 0 else F.col(f"u{k}")
        pool = rest.join(table, "key").where((F.col("size") <= F.col("most")) & (F.col("size") > 0) & (F.col("base") < cap) & u.isNotNull()).select("key", "size", u.alias("u"))
        found = _search(pool, open_)
        rows = [(x, h, most[x]) for x, (h, _) in found.items()]
        marks = C.broadcast_if_small(spark.createDataFrame(rows, f"key string, h{k} long, most{k} double"), len(rows))
        slim = slim.join(marks, "key", "left")
        taken = taken | F.coalesce((u < F.col(f"h{k}")) & (F.col("size") <= F.col(f"most{k}")) & (F.col("size") > 0) & (F.col("base") < cap), F.lit(False))
        rest = slim.where(~taken)
        left |= {x: left[x] - size for x, (_, size) in found.items()}
    last = _nearest(rest.where(F.col("base") < cap), {x: v for x, v in left.items() if v >= 1}) if any(v >= 1 for v in left.values()) else {}
    marks = C.broadcast_if_small(spark.createDataFrame([(x, *z) for x, z in last.items()], "key string, last_u long, last_size long"), len(last))
    slim = slim.join(marks, "key", "left")
    taken = taken | F.coalesce((F.col("u0") == F.col("last_u")) & (F.col("size") == F.col("last_size")), F.lit(False))
    copies = F.least(F.col("base") + taken.cast("int"), F.lit(cap))
    return slim.select(F.col("id").alias(key), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "rate", "u0")


def resample(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as the mix takes it: a copied row stands several times, one not taken is left out."""
    key = how.get("key", "doc_id")
    plan = mix(docs, **how).where("copies <> 1").select(F.col(key).alias("id"), F.col("u0").alias("pu"), F.col("copies").alias("n")).distinct()
    plan = C.cut(plan, "mix-plan")
    u = F.pmod(F.xxhash64(F.lit(0), F.col(key).cast("string"), F.xxhash64("text")), F.lit(CELLS**3))
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("k"), u.alias("u"))
    kept = kept.join(C.broadcast_if_small(plan, plan.count()), F.col("k").eqNullSafe(F.col("id")) & (F.col("u") == F.col("pu")), "left").withColumn("n", F.coalesce("n", F.lit(1)))
    return kept.where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
