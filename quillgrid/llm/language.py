"""Operator 3: language of whole texts, by sparse multinomial logistic regression.

Features are TF-IDF weights of character runs of 1 to 3 (letters in small form, all else one blank),
hashed into 65,536 columns: 1 + ln(count) times ln((1 + documents) / (1 + documents with it)) + 1, scaled
to length 1. Document counts cover all learning rows. Weights are fitted by follow-the-regularised-leader
with elastic-net penalties on at most `per_lang` different texts a language, and a temperature is fitted on
those of that sample which the weights have not seen.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

D = 1 << 16
UNDETERMINED = "und"


def letters() -> np.ndarray:
    state = C.worker_state()
    if "letters" not in state:
        import regex

        table = np.zeros(0x110000, bool)
        every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
        for m in regex.finditer(r"\p{L}+", every):
            table[[ord(x) for x in m[0]]] = True
        state["letters"] = table
    return state["letters"]


def features(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(columns, 1 + ln(count)); None if the text has no letter."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[np.minimum(cp, 0x10FFFF)]
    if not is_letter.any():
        return None
    cp = np.where(is_letter, cp, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    blank = np.array([32], np.uint32)
    x = np.concatenate([blank, cp[keep], blank])
    with np.errstate(over="ignore"):
        a = x * np.uint32(0x9E3779B1)
        b = (a[:-1] ^ (a[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + x[1:] * np.uint32(0xC2B2AE3D)
        c = (b[:-1] ^ (b[:-1] >> np.uint32(13))) * np.uint32(0x27D4EB2F) + x[2:] * np.uint32(0x165667B1)
        h = np.concatenate([a, b, c])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    counts = np.bincount(h >> np.uint32(16), minlength=D)
    at = np.flatnonzero(counts)
    return at, 1 + np.log(counts[at])


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray):
        self.langs, self.idf, self.t = langs, idf.astype(np.float32), 1.0
        self.w = np.zeros((D, len(langs)), np.float32)

    def scaled(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        v = tf * self.idf[at]
        return v / max(math.sqrt(float(v @ v)), 1e-12)

    def chances(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        z = self.scaled(at, tf) @ self.w[at] / self.t
        z = np.exp(z - z.max())
        return z / z.sum()

    def fit(self, rows: list[tuple[int, np.ndarray, np.ndarray]], *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.0005, epochs: int = 3) -> None:
        """Follow the regularised leader, a row at a time, every learning rate a weight's own; every fifth row is for the temperature."""
        learn, calibrate = [r for k, r in enumerate(rows) if k % 5 != 4], [r for k, r in enumerate(rows) if k % 5 == 4]
        z, n = np.zeros((D, len(self.langs))), np.zeros((D, len(self.langs)))

        def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
            return np.where(np.abs(zs) <= l1, 0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(learn)):
                y, at, tf = learn[k]
                x, zs, ns = self.scaled(at, tf), z[at], n[at]
                w = weights(zs, ns)
                p = x @ w
                p = np.exp(p - p.max())
                p /= p.sum()
                p[y] -= 1
                g = x[:, None] * p
                z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w
                n[at] = ns + g * g
        self.w = weights(z, n).astype(np.float32)
        logits = [(y, self.scaled(at, tf) @ self.w[at]) for y, at, tf in calibrate]

        eps = 1 / (len(logits) + 2)  # smoothed targets, else rows that are all right would ask for certainty

        def loss(log_t: float) -> float:
            total = 0.0
            for y, v in logits:
                u = (v - v.max()) / math.exp(log_t)
                total += math.log(np.exp(u).sum()) - (1 - eps) * u[y] - eps * (u.sum() - u[y]) / (len(u) - 1)
            return total

        a, b = -5.0, 3.0  # golden section: the loss has one valley in log_t for practical purposes
        g = (math.sqrt(5) - 1) / 2
        while logits and b - a > 1e-3:
            p, q = b - g * (b - a), a + g * (b - a)
            a, b = (a, q) if loss(p) < loss(q) else (p, b)
        self.t = math.exp((a + b) / 2) if logits else 1.0


def learn(docs: DataFrame, *, per_lang: int = 600) -> Model:
    """A model of the rows of docs (text, lang; lang not null), at most per_lang sampled texts of each language, picked by a hash; copies of a text are one."""
    spark = docs.sparkSession
    C.small_batches(spark)
    docs = docs.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(D, np.int64), 0
        for batch in batches:
            for text in batch["text"].to_pylist():
                if (f := features(text)) is not None:
                    df[f[0]] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"c": pa.array([*at, D], pa.int32()), "n": pa.array([*df[at], n], pa.int64())})

    counts = docs.select("text").mapInArrow(C.tidied(document_counts, "letters"), "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()  # at most 65,537 rows
    df = np.zeros(D + 1)
    for r in counts:
        df[r["c"]] = r["n"]
    idf = np.log((1 + df[D]) / (1 + df[:D])) + 1
    # Copies of a text count once: its hash is picked, and then one of its rows.
    docs = docs.where(F.col("text").rlike(r"\p{L}")).withColumn("mark", F.xxhash64("text"))
    keys = C.cut(docs.select("lang", "mark").distinct(), "language-texts")
    sizes = {r["lang"]: r["n"] for r in keys.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = spark.createDataFrame([(k, min(1.0, 1.5 * per_lang / v + 20 / v)) for k, v in sizes.items()], "lang string, share double")
    some = keys.join(F.broadcast(share), "lang").where(F.pmod("mark", F.lit(1 << 30)) <= F.col("share") * (1 << 30))  # about 1.5 times per_lang a language
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("mark"), "mark"))).where(F.col("place") <= per_lang)
    picked = docs.join(F.broadcast(some.select("lang", "mark")), ["lang", "mark"]).groupBy("lang", "mark").agg(F.min("text").alias("text")).select("lang", "text")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(lang, f) for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True) if (f := features(text)) is not None]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got]), pa.array([g[1][0].astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g[1][1].astype(np.float32) for g in got], pa.list_(pa.float32()))], names=["lang", "at", "tf"])

    rows = picked.mapInArrow(C.tidied(featurise, "letters"), "lang string, at array<int>, tf array<float>").toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    model, every = Model(langs, idf), []
    for batch in rows.to_batches():
        at, tf = batch["at"], batch["tf"]
        ends, flat_at, flat_tf = at.offsets.to_numpy(), at.values.to_numpy(), tf.values.to_numpy()
        for k, lang in enumerate(batch["lang"].to_pylist()):
            every.append((lang, flat_at[ends[k] : ends[k + 1]], flat_tf[ends[k] : ends[k + 1]]))
    every.sort(key=lambda e: (e[0], len(e[1]), e[1].tobytes(), e[2].tobytes()))  # the order in which rows came doesn't matter
    examples = [(langs.index(every[k][0]), *every[k][1:]) for k in np.random.default_rng(7).permutation(len(every))]
    if len(langs) > 1:
        model.fit(examples)
    return model


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep`, lang_pred and score (its chance, after the temperature) of every row.

    Null text, or one without a letter (category L): `und`, 0.0. So it is for every row if nothing was learned.
    """
    C.small_batches(docs.sparkSession)
    used = np.flatnonzero(np.abs(model.w).sum(1))
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.idf, model.t, used, model.w[used]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, idf, t, used, w = sent.value
        m = Model(langs, idf)
        m.t = t
        m.w[used] = w
        for batch in batches:
            out = []
            for text in batch["text"].to_pylist():
                f = features(text) if text is not None and langs else None
                if f is None:
                    out.append((UNDETERMINED, 0.0))
                else:
                    p = m.chances(*f)
                    k = int(p.argmax())
                    out.append((langs[k], min(1.0, float(p[k]))))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], names=[*keep, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    return docs.select("text", *[c for c in keep if c != "text"]).mapInArrow(C.tidied(work, "letters"), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string", "score double"]))
