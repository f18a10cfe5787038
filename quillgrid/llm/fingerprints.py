"""Operator 2: document fingerprints by consistent weighted sampling.

A text's weighted terms are its runs of five words (weight: how often) and its words (a quarter of how
often). For each term and each of the samples, hashing gives r and c of the gamma(2, 1) distribution and
a uniform b; with t = floor(ln(weight) / r + b) the term's value is ln(c) - r * (t - b + 1), and the
sample is the term of the least value, with its t. Two texts agree in a sample with the probability of
their generalised Jaccard similarity, sum(min) / sum(max) of the weights. r and ln(c) come from tables
of 65,536 quantiles, b has 31 bits; each from other bits of products of the term's hash.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WORD_WEIGHT = 0.25


def gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Midpoint quantiles of gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 64.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        low = 1 - (1 + mid) * np.exp(-mid) < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


class Sampler:
    BLOCK = 1024

    def __init__(self, samples: int):
        q = gamma_quantiles()
        self.k, self.r, self.lnc = samples, q.astype(np.float32), np.log(q).astype(np.float32)
        seeds = C.mix(np.arange(1, 2 * samples + 1, dtype=C.U64) * C.U64(0x9E3779B97F4A7C15)).view(np.uint32).reshape(4, samples, 1)
        self.odd = [x | np.uint32(1) for x in seeds]
        self.ints = [np.empty(samples * self.BLOCK, np.uint32) for _ in "abc"]
        self.floats = [np.empty(samples * self.BLOCK, np.float32) for _ in "abc"]

    def values(self, h: np.ndarray, lnw: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(value, t) of each sample and term; t is None where all weights are 1, as it is 0 then."""
        size = self.k * len(h)
        x, y, z = (buf[:size].reshape(self.k, -1) for buf in self.ints)
        r, lnc, b = (buf[:size].reshape(self.k, -1) for buf in self.floats)
        low, high = h.astype(np.uint32), (h >> C.U64(32)).astype(np.uint32)
        for out, one, two in ((x, 0, 1), (z, 2, 3)):
            np.multiply(low, self.odd[one], out=out)
            np.multiply(high, self.odd[two], out=y)
            out += y
            np.right_shift(out, np.uint32(15), out=y)
            out ^= y
            out *= np.uint32(0x2C1B3C6D)
        np.right_shift(x, np.uint32(16), out=y)
        self.r.take(y.view(np.int32), mode="clip", out=r)
        x &= np.uint32(0xFFFF)
        self.lnc.take(x.view(np.int32), mode="clip", out=lnc)
        z >>= np.uint32(1)
        np.multiply(z.view(np.int32), np.float32(2.0**-31), out=b, casting="unsafe", dtype=np.float32)
        t = None
        if lnw.any():
            np.minimum(b, np.float32(1 - 2.0**-24), out=b)
            t = np.floor(lnw.astype(np.float32)[None, :] / r + b)
            b -= t
        b -= 1
        r *= b
        lnc += r
        return lnc, t

    def two(self, groups: list[tuple[np.ndarray, np.ndarray, int, int]]) -> list[np.ndarray]:
        """Samples of two texts, each a row of 16-bit numbers. Groups of terms: (hashes, log weights, both, end);
        [0, end) are the first text's, [both, all) the second's. Weights of 1, which need no t, are a group apart."""
        best = [np.full(self.k, np.inf, np.float32) for _ in "ab"]
        ids = [np.zeros(self.k, C.U64) for _ in "ab"]
        rows = np.arange(self.k)
        for h, lnw, both, end in groups:
            for a in range(0, len(h), self.BLOCK):
                part = h[a : a + self.BLOCK]
                v, t = self.values(part, lnw[a : a + self.BLOCK])
                for side, (i, j) in enumerate(((0, min(end - a, len(part))), (max(both - a, 0), len(part)))):
                    if i < j:
                        at = v[:, i:j].argmin(1) + i
                        least, of = v[rows, at], part[at]
                        if t is not None:
                            with np.errstate(over="ignore"):
                                of = of + t[rows, at].astype(np.int64).astype(C.U64) * C.U64(0xD6E8FEB86659FD93)
                        less = least < best[side]
                        best[side][less], ids[side][less] = least[less], of[less]
        with np.errstate(over="ignore"):
            return [(C.mix(x + np.arange(1, self.k + 1, dtype=C.U64)) >> C.U64(48)).astype(np.uint16) for x in ids]


def terms(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, weights) of the terms of a text whose words have the hashes h; each kind's hashes ascending."""
    s, sn = np.unique(C.shingle_hashes(h), return_counts=True)
    w, wn = np.unique(h ^ C.U64(0xA5A5A5A5A5A5A5A5), return_counts=True)
    return np.concatenate([s, w]), np.concatenate([sn, wn * WORD_WEIGHT])


def pair(sampler: Sampler, one: np.ndarray, other: np.ndarray) -> list[np.ndarray]:
    """The samples of two texts, given as word hashes; terms that both have with one weight are valued once. No terms: empty."""
    (ha, wa), (hb, wb) = terms(one), terms(other)
    if not len(ha) and not len(hb):
        return [np.zeros(0, np.uint16)] * 2
    h, w = np.concatenate([ha, hb]), np.concatenate([wa, wb])
    order = np.argsort(h, kind="stable")  # a hash stands at most once on each side
    hs, ws = h[order], w[order]
    same = (hs[1:] == hs[:-1]) & (ws[1:] == ws[:-1])
    in_both = np.zeros(len(h), bool)
    in_both[order[:-1][same]] = in_both[order[1:][same]] = True
    place = np.where(in_both, 1, np.where(np.arange(len(h)) < len(ha), 0, 2))
    take = ~in_both | (np.arange(len(h)) < len(ha))
    groups = []
    for unit in (w == 1) & take, (w != 1) & take:
        at = np.flatnonzero(unit)
        at = at[np.argsort(place[at], kind="stable")]
        n = np.bincount(place[at], minlength=3)
        groups.append((h[at], np.log(w[at]), int(n[0]), int(n[0] + n[1])))
    out = sampler.two(groups)
    return [x if len(of) else np.zeros(0, np.uint16) for x, of in zip(out, (ha, hb), strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples; texts without words are like each other and unlike any other."""
    if len(a) != len(b):
        return 0.0
    return float((a == b).mean()) if len(a) else 1.0


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points, rounded down, gives way to the first as many of the other text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def edited_hashes(text: str, following: str, h: np.ndarray) -> np.ndarray:
    """Word hashes of the edited text; those of the words before the edit are taken from the text's own, h."""
    cut = len(text) // 4
    head = text[: len(text) - cut]
    words = head.split()
    last = words.pop() if words and not head[-1].isspace() else ""  # the edit may lengthen it
    return np.concatenate([h[: len(words)], C.word_hashes((last + following[:cut]).split())])


def fingerprint(docs: DataFrame, *, samples: int = 64, parts: int | None = None) -> DataFrame:
    """Per document: fingerprint, that of its text edited with the next one's head, and likenesses.

    Order: ascending doc_id, null first, equal ids by text; the last document is followed by the first
    (alone, by itself). Null text: as empty. A text without words has the fingerprint "". Texts are
    shuffled once, by ranges of doc_id; each range also gets the first document of the next one. Columns
    but doc_id and text are ignored. No rows: none.
    """
    import hashlib

    spark = docs.sparkSession
    C.small_batches(spark)
    parts = parts or C.parts_for(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bucket = F.expr(C.bucket_expr("doc_id", C.cuts_of(docs, "doc_id", 2 * parts)))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    firsts = sorted((x.r, x.first["doc_id"]) for x in docs.select(bucket.alias("r"), order.alias("o")).groupBy("r").agg(F.min("o").alias("first")).collect())  # one row a range
    before = [(x, firsts[k - 1][0]) for k, (_, x) in enumerate(firsts)]
    guests = F.broadcast(spark.createDataFrame(before, "first_id long, guest_of int"))
    dealt = (
        docs.withColumn("r", bucket)
        .join(guests, F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
        .withColumn("guest", F.explode(F.when(F.col("guest_of").isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
        .select(F.when(F.col("guest"), F.col("guest_of")).otherwise(F.col("r")).alias("r"), "guest", "doc_id", "text")
        .repartitionById(parts, F.col("r"))
        .sortWithinPartitions("r", "guest", "doc_id", "text")
    )
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, waiting, out = Sampler(samples), None, []

        def finish(row: tuple, following: str) -> tuple[tuple, np.ndarray]:
            doc_id, text = row
            edited = edited_text(text, following)
            h = C.word_hashes(text.split())
            mine, theirs = pair(sampler, h, edited_hashes(text, following, h))
            return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mine.astype(">u2").tobytes().hex(), theirs.astype(">u2").tobytes().hex(), likeness(mine, theirs)), mine

        held = None  # a finished row that lacks only its likeness to the next document
        for batch in batches:
            for r, guest, doc_id, text in zip(*(batch[c].to_pylist() for c in ("r", "guest", "doc_id", "text")), strict=True):
                if waiting is not None and waiting[0] == r:
                    row, mine = finish(waiting[1:], text)
                    if held is not None:
                        out.append((*held[0], likeness(held[1], mine)))
                    held = row, mine
                if guest:
                    if waiting is not None and held is not None:
                        out.append((*held[0], likeness(held[1], pair(sampler, C.word_hashes(text.split()), np.zeros(0, C.U64))[0])))
                    held = waiting = None
                else:
                    waiting = (r, doc_id, text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []

    return dealt.mapInArrow(C.tidied(work, "words"), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
