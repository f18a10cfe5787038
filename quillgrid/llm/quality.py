"""Operator 8: quality classifier by an interpolated modified Kneser-Ney model of byte 5-grams.

Counts of the 5-grams of all trusted text's UTF-8 bytes (by language) are summed in Spark. Continuation counts,
discounts, context totals and interpolated probabilities come from joins of the count tables, sharded
by language and n-gram. Trusted text falls into two halves by a hash of the text, each with its model, and every
text is scored by the model of the half it isn't in: no text meets its own n-grams, so the limits, which come from
trusted texts, hold for others too. The model is written as shards; a scoring task loads shards one at a time and
joins its n-grams with them in place, so neither broadcast nor shuffle grows with the scored text. A document
is kept if its perplexity a byte lies between quantiles of the trusted documents of its language and length.

An n-gram is its bytes in a long, the last one lowest; four bytes 2 stand before a text. Bytes need no folding of
rare characters, and an n-gram of any language keeps its name in every run.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ORDER = 5
BITS = 8
SHARD_ROWS = 4_000_000
UNSEEN = -1


def codes(text: str) -> np.ndarray:
    """The n-grams that end at each byte of the text."""
    data = np.frombuffer(b"\2" * (ORDER - 1) + text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data) - ORDER + 1
    out = data[:n].astype(np.int64)
    for k in range(1, ORDER):
        out <<= BITS
        out |= data[k : k + n]
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of docs (lang, text); tasks send each n-gram once for some MB of text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                for a in range(0, len(grams), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams[a : a + 100_000]), pa.string()), pa.array(grams[a : a + 100_000]), pa.array(n[a : a + 100_000].astype(np.int64))], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if text:
                    held.setdefault(lang, []).append(codes(text))
                    size += len(text)
                if size > 3_000_000:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select("lang", "text").mapInArrow(C.tidied(work), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """lang, kind, gram, value from n-gram counts: kind p1..p4 is the log probability of the n-gram's last
    byte, g1..g4 the log weight of the next lower order after a context. p1's gram -1 stands for any
    byte not seen. Every table is joined by language and n-gram or context."""
    out = None
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many bytes precede the n-gram
        tables[k] = tables[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << (BITS * k)) - 1)).alias("gram")).agg(F.count("*").alias("n"))
    lower = None
    for k in range(1, ORDER + 1):
        t = tables[k]
        c = t.groupBy("lang").agg(*[F.sum((F.col("n") == i).cast("double")).alias(f"t{i}") for i in range(1, 5)], F.count("*").alias("grams"))
        y = F.expr("IF(t1 + t2 > 0, t1 / (t1 + 2 * t2), 0.5D)")
        c = c.select("lang", "grams", *[
            F.greatest(F.lit(0.05), F.least(F.lit(float(i)), F.coalesce(F.when((F.col(f"t{i}") > 0) & (F.col("t1") > 0), i - (i + 1) * y * F.col(f"t{i + 1}") / F.col(f"t{i}")), F.lit(0.5 * i)))).alias(f"d{i}")
            for i in (1, 2, 3)
        ])
        t = t.join(F.broadcast(c), "lang").withColumn("ctx", F.shiftrightunsigned("gram", BITS))  # c: a row a language
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.withColumn("d", d)
        ctx = t.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.sum("d").alias("held"))
        t = t.join(ctx, ["lang", "ctx"])
        own, weight = (F.col("n") - F.col("d")) / F.col("total"), F.col("held") / F.col("total")
        if k == 1:
            p = t.select("lang", "gram", (own + weight / (F.col("grams") + 1)).alias("p"))
            unseen = t.groupBy("lang").agg(F.max(weight / (F.col("grams") + 1)).alias("p"))
            p = p.unionByName(unseen.select("lang", F.lit(UNSEEN).cast("long").alias("gram"), "p"))
        else:
            low = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("low"))
            t = t.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1)))
            p = t.join(low, ["lang", "suffix"]).select("lang", "gram", (own + weight * F.col("low")).alias("p"))
            g = ctx.select("lang", F.lit(f"g{k}").alias("kind"), F.col("ctx").alias("gram"), F.log(F.col("held") / F.col("total")).cast("float").alias("value"))
            out = out.unionByName(g)
        p = C.cut(p, f"kn{k}")
        rows = p.select("lang", F.lit(f"p{k}").alias("kind"), "gram", F.log("p").cast("float").alias("value"))
        out = rows if out is None else out.unionByName(rows)
        lower = p
    return out


class Shards:
    """The model's tables of one language, loaded shard by shard; a few shards stay in memory."""

    HELD = 4

    def __init__(self, uri: str, n: dict[str, int]):
        self.uri, self.n, self.held = uri, n, {}

    def load(self, kind: str, shard: int) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        key = kind, shard
        if key not in self.held:
            fs, path = C.open_fs(f"{self.uri}/kind={kind}/shard={shard}")
            files = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet")]
            tables = [pq.ParquetFile(fs.open_input_file(f)).read(columns=["gram", "value"]) for f in files]
            t = pa.concat_tables(tables)
            grams, values = t["gram"].to_numpy(), t["value"].to_numpy()
            order = np.argsort(grams)
            while sum(len(g) for g, _ in self.held.values()) + len(grams) > self.HELD * SHARD_ROWS and self.held:
                del self.held[next(iter(self.held))]
            self.held[key] = grams[order], values[order]
        return self.held[key]

    def find(self, kind: str, grams: np.ndarray) -> np.ndarray:
        """Values; NaN where the table has no such n-gram."""
        n = self.n.get(kind, 0)
        out = np.full(len(grams), np.nan)
        for shard in range(n):
            here = slice(None) if n == 1 else np.flatnonzero(np.mod(grams, n) == shard)
            want = grams[here]
            keys, values = self.load(kind, shard)
            at = np.searchsorted(keys, want)
            at[at == len(keys)] = 0
            out[here] = np.where(keys[at] == want, values[at], np.nan)
        return out

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        """Log probability of each n-gram's last byte; where an order lacks the n-gram, the next lower one, weighed."""
        out, at, add = np.zeros(len(grams)), np.arange(len(grams)), np.zeros(len(grams))
        for k in range(ORDER, 0, -1):
            v = self.find(f"p{k}", grams)
            miss = np.isnan(v)
            out[at[~miss]] = v[~miss] + add[~miss]
            grams, at, add = grams[miss], at[miss], add[miss]
            if not len(at):
                break
            if k > 1:
                add = add + np.nan_to_num(self.find(f"g{k}", grams >> BITS), nan=0.0)
                grams = grams & ((1 << (BITS * (k - 1))) - 1)
            else:
                out[at] = add + self.find("p1", np.full(1, UNSEEN))[0]
        return out


def train(docs: DataFrame) -> dict:
    """Model of all rows of docs (lang, text), written to the shared folder: its URI and shards a table by language."""
    spark = docs.sparkSession
    C.small_batches(spark)
    counts = C.cut(count_grams(docs), "kn-counts")
    model = C.cut(kneser_ney(counts), "kn-rows")
    sizes = model.groupBy("lang", "kind").agg(F.count("*").alias("n")).collect()  # a few rows a language
    langs = {lang: i for i, lang in enumerate(sorted({r["lang"] for r in sizes}, key=lambda x: (x is None, x)))}
    shards = {lang: {r["kind"]: -(-r["n"] // SHARD_ROWS) for r in sizes if r["lang"] == lang} for lang in langs}
    uri = C.shared_dir(spark, "kn-model")
    if langs:
        rows = [(lang, i, kind, n) for lang, i in langs.items() for kind, n in shards[lang].items()]
        index = F.broadcast(spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in rows], "l string, lang_no int, k string, shards int"))
        joined = model.join(index, F.col("lang").eqNullSafe(F.col("l")) & (F.col("kind") == F.col("k")))
        joined.select("lang_no", "kind", F.pmod("gram", "shards").cast("int").alias("shard"), "gram", "value").repartition("lang_no", "kind", "shard").write.partitionBy("lang_no", "kind", "shard").parquet(uri)
    return {"uri": uri, "langs": langs, "shards": shards}


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns `keep`, lang, n (bytes) and perplexity a byte of every row of docs (lang, text).

    Null: text that is null or empty, or a language of which there was no trusted text.
    """
    C.small_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict = {}
        for batch in batches:
            langs, texts = batch["lang"].to_pylist(), batch["text"].to_pylist()
            out, n = np.full(len(texts), np.nan), np.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], np.int64)
            for lang in set(langs):
                if lang not in model["langs"]:
                    continue
                if lang not in loaded:
                    loaded[lang] = Shards(f"{model['uri']}/lang_no={model['langs'][lang]}", model["shards"][lang])
                rows, size = [], 0
                mine = [k for k, x in enumerate(langs) if x == lang and texts[k]]
                for k in mine:
                    rows.append(k)
                    size += len(texts[k])
                    if size > 500_000 or k == mine[-1]:
                        grams = [codes(texts[i]) for i in rows]
                        sums = np.add.reduceat(loaded[lang].log_p(np.concatenate(grams)), np.concatenate([[0], np.cumsum([len(g) for g in grams])[:-1]]))
                        out[rows] = np.exp(-sums / n[rows])
                        rows, size = [], 0
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), batch["lang"], pa.array(n), pa.array(out, mask=np.isnan(out))], names=[*keep, "lang", "n", "perplexity"])

    columns = ["text", "lang", *[c for c in keep if c not in ("text", "lang")]]
    return docs.select(*columns).mapInArrow(C.tidied(work), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang string, n long, perplexity double"]))


NO_LANG = "\0"  # stands for null, which joins by equality would drop
BAND = "CAST(floor(log2(greatest(n, 1))) AS INT)"


def half_model(other: bool):
    """Name of the model (language and half) that a text helps to train, or of the other one, which scores it."""
    half = F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(2))
    return F.concat("lang", F.lit("\1"), (1 - half if other else half).cast("string"))


def merged(counts: dict[tuple[str, int], int], least: int) -> list[tuple[str, int, list[int]]]:
    """(lang, band, bands around it that hold `least` trusted rows, or all) of every band and language of counts: (lang, band) -> trusted rows."""
    out = []
    for lang in sorted({lang for lang, _ in counts}):
        own = {b: n for (x, b), n in counts.items() if x == lang}
        for to in range(32):
            width = next((w for w in range(32) if sum(n for b, n in own.items() if abs(b - to) <= w) >= least), 32)
            out.append((lang, to, sorted(b for b in own if abs(b - to) <= width)))
    return out


def classify(docs: DataFrame, labels: DataFrame, *, low: float = 0.002, high: float = 0.995, margin: float = 1.02, least: int = 100) -> DataFrame:
    """doc_id, row_key, lang, n (bytes), perplexity (a byte), trusted, low, high, keep of every row of docs (doc_id, text, lang).

    Trusted rows have a label of quality 1, none of quality 0 and none of toxic 1. The limits are the
    quantiles `low` and `high` of the trusted rows' perplexity in the row's language and length band (powers
    of two), widened by `margin`; a perplexity that equals a limit is kept. A band of under `least` trusted rows is
    merged with as many neighbours on both sides as hold so many. Rows without a perplexity (null or empty text, or no trusted text
    of the language in the other half) or limits are kept: nothing speaks against them. row_key hashes
    doc_id, text and lang. Rows of null lang are a language of their own. Equal texts score alike. No labels: every row is kept.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    good = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("label_id IS NOT NULL AND q = 1 AND t = 0").select("label_id")
    good = C.cut(good, "trusted")
    ids = C.broadcast_if_small(good, good.count())
    docs = docs.select("doc_id", "text", "lang", row_key().alias("row_key")).withColumn("lang", F.coalesce("lang", F.lit(NO_LANG)))
    trusted = docs.join(ids, docs["doc_id"] == ids["label_id"], "left_semi").where("text IS NOT NULL")
    model = train(trusted.select(half_model(False).alias("lang"), "text"))
    scored = score(docs.select("doc_id", "row_key", "text", F.col("lang").alias("real"), F.coalesce(half_model(True), "lang").alias("lang")), model, ["doc_id", "row_key", "real"])
    scored = scored.drop("lang").withColumnRenamed("real", "lang")
    scored = scored.join(ids, scored["doc_id"] == ids["label_id"], "left").withColumn("trusted", F.col("label_id").isNotNull()).drop("label_id").withColumn("band", F.expr(BAND))
    scored = C.cut(scored, "perplexity")
    known = scored.where("trusted AND perplexity IS NOT NULL")
    # Exact quantiles of rounded logarithms: few distinct values, and the same limits in every run.
    limit = [F.exp(F.percentile(F.round(F.log("perplexity"), 4), q)) for q in (low, high)]
    counts = {(r["lang"], r["band"]): r["rows"] for r in known.groupBy("lang", "band").agg(F.count("*").alias("rows")).collect()}  # some 20 rows a language
    near = spark.createDataFrame([(lang, to, b) for lang, to, found in merged(counts, least) for b in found], "l1 string, to int, of int")
    pooled = known.join(F.broadcast(near), (F.col("lang") == F.col("l1")) & (F.col("band") == F.col("of")))
    by_band = pooled.groupBy("l1", "to").agg(limit[0].alias("lo"), limit[1].alias("hi"))
    all_ = scored.join(F.broadcast(by_band), (F.col("lang") == F.col("l1")) & (F.col("band") == F.col("to")), "left")
    lo, hi = F.col("lo") / margin, F.col("hi") * margin
    fits = F.coalesce((F.col("perplexity") >= lo) & (F.col("perplexity") <= hi), F.lit(True))
    return all_.select("doc_id", "row_key", F.nullif(F.col("lang"), F.lit(NO_LANG)).alias("lang"), "n", "perplexity", "trusted", lo.alias("low"), hi.alias("high"), fits.alias("keep"))


def row_key():
    """A hash of doc_id, text and lang; nulls count, each in its place."""
    return F.xxhash64(*[x for c in ("doc_id", "text", "lang") for x in (F.isnull(c), F.col(c))])


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    bad = C.cut(classify(docs, labels, **how).where("NOT keep").select(F.col("row_key").alias("bad")).distinct(), "rejected")
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key().alias("key")).join(C.broadcast_if_small(bad, bad.count()), F.col("key") == F.col("bad"), "left_anti")
    return kept.select("row.*")
