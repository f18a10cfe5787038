"""Operator 9: self-join of documents at Jaccard similarity >= t of their five-word runs, with Bayesian pruning.

1. A task turns each whole text into its set of run hashes, a key of the set, and the hashes of bands of
   MinHash values. Documents with equal sets are one class; only classes go on.
2. Classes that share a band are linked to the least class of the band (a row each, never all pairs);
   connected components of these links hold every candidate pair.
3. A component is cut into blocks; each pair of blocks is a task's group. Within it, sizes rule out pairs,
   then MinHash values (not those of the bands) are compared 16 at a time, and a pair is dropped once the
   posterior chance that its similarity reaches t, with a uniform prior, is below `tolerance`. What is
   left is verified by exact set intersection.
4. Groups return link counts and a spanning forest of the verified links; its components are the
   near-duplicate classes.
"""

from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graphs import components

BANDS, ROWS = 40, 6
STEP, CHECKS = 16, 128
BLOCK = 512


def seeds(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    s = C.mix((np.arange(1, 2 * n + 1, dtype=C.U64) + C.U64(salt << 32)) * C.U64(0x9E3779B97F4A7C15))
    return (s[:n] | C.U64(1))[:, None], s[n:][:, None]


def minhash(h: np.ndarray, odd: np.ndarray, xor: np.ndarray) -> np.ndarray:
    """The least of each of the hash functions over h, which isn't empty."""
    out = None
    with np.errstate(over="ignore"):
        for a in range(0, len(h), 1024):
            low = ((h[None, a : a + 1024] ^ xor) * odd).min(1)
            out = low if out is None else np.minimum(out, low)
    return out


def run_set(text: str) -> np.ndarray:
    """The ascending hashes of a text's runs of five words (small letters, parted by white space)."""
    return np.unique(C.shingle_hashes(C.word_hashes(text.lower().split())))


def least_matches(t: float, tolerance: float) -> np.ndarray:
    """For 0, 16, 32, ... compared values: the fewest matches at which P(similarity >= t) >= tolerance under Beta(1 + matches, 1 + others)."""
    out = []
    for n in range(0, CHECKS + 1, STEP):
        # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        below = np.cumsum([comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(n + 1)])
        out.append(int(np.argmax(below >= tolerance)))
    return np.array(out)


def sketch(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, set_key, bands of every row; null text: as empty. Texts without words are one class, with no bands."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd, xor = seeds(BANDS * ROWS, 1)
        band_salt = np.arange(1, BANDS + 1, dtype=C.U64) * C.U64(0xD6E8FEB86659FD93)
        for batch in batches:
            keys, bands = [], []
            for text in batch["text"].to_pylist():
                h = run_set(text)
                with np.errstate(over="ignore"):
                    keys.append(int(C.mix(np.array([h.sum(dtype=C.U64) + C.U64(len(h)) * C.U64(0xA0761D6478BD642F)]))[0] ^ C.mix(h ^ C.U64(0x5851F42D4C957F2D)).sum(dtype=C.U64)))
                    if len(h):
                        m = minhash(h, odd, xor).reshape(BANDS, ROWS)
                        x = band_salt.copy()
                        for k in range(ROWS):
                            x = C.mix(x ^ m[:, k]) * C.U64(0x9E3779B97F4A7C15)
                        bands.append(x.astype(np.int64))
                    else:
                        bands.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch["row_key"], batch["doc_id"], pa.array(np.array(keys, np.uint64).astype(np.int64)), pa.array(bands, pa.list_(pa.int64()))], names=["row_key", "doc_id", "set_key", "bands"])

    return docs.mapInArrow(C.tidied(work, "words"), "row_key long, doc_id long, set_key long, bands array<long>")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, of batches that are sorted by them; one run in memory at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        cols = [batch[k].to_numpy() for k in keys]
        change = np.zeros(max(0, len(cols[0]) - 1), bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1), len(cols[0])]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            key = tuple(c[a] for c in cols)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def verify_block(ids: np.ndarray, block: np.ndarray, mult: np.ndarray, ends: np.ndarray, flat: np.ndarray, cross: bool, t: float, floor: np.ndarray, odd: np.ndarray, xor: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """(weight of the links of each row, ends of a spanning forest); cross: pairs between two blocks only, else within one."""
    n = len(ids)
    sizes = np.diff(ends)
    sig = np.stack([minhash(flat[ends[i] : ends[i + 1]], odd, xor) for i in range(n)]).astype(np.uint32)
    words, local = np.unique(flat, return_inverse=True)
    links, root, one, other = np.zeros(n, np.int64), np.arange(n), [], []
    mark = np.zeros(len(words), bool)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    side = block == block.min()
    for x in range(n):
        if cross:
            if not side[x]:
                continue
            y = np.flatnonzero(~side)
        else:
            y = np.arange(x + 1, n)
        y = y[np.minimum(sizes[y], sizes[x]) >= t * np.maximum(sizes[y], sizes[x]) - 1e-9]
        matches = np.zeros(len(y), np.int64)
        for k in range(CHECKS // STEP):
            if not len(y):
                break
            z = slice(k * STEP, (k + 1) * STEP)
            matches += (sig[y, z] == sig[x, z]).sum(1)
            live = matches >= floor[k + 1]
            y, matches = y[live], matches[live]
        if not len(y):
            continue
        mark[local[ends[x] : ends[x + 1]]] = True
        index = np.repeat(ends[y] - np.concatenate([[0], np.cumsum(sizes[y])[:-1]]), sizes[y]) + np.arange(sizes[y].sum())
        common = np.add.reduceat(mark[local[index]], np.concatenate([[0], np.cumsum(sizes[y])[:-1]]), dtype=np.int64)
        mark[local[ends[x] : ends[x + 1]]] = False
        y = y[common >= t * (sizes[x] + sizes[y] - common) - 1e-9]
        links[x] += mult[y].sum()
        links[y] += mult[x]
        for v in y:
            a, b = find(x), find(int(v))
            if a != b:
                root[b] = a
                one.append(int(ids[x]))
                other.append(int(ids[v]))
    return links, one, other


def near_join(docs: DataFrame, *, threshold: float = 0.8, tolerance: float = 1e-7) -> DataFrame:
    """doc_id, row_key, label, class_id, class_size, n_links of every row of docs (doc_id, text).

    Two rows are linked if the Jaccard similarity of their sets of five-word runs (a text of fewer words
    is one run) is at least `threshold`; rows with equal sets are, texts without words (or null) among
    them. n_links counts all linked rows, copies too. label names the class. class_id is the least doc_id that links lead to,
    its own for a row without links; null ids come last. row_key hashes doc_id and text. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    rows = C.cut(sketch(docs), "sketch")
    classes = C.cut(rows.groupBy("set_key").agg(F.count("*").alias("mult"), F.min("row_key").alias("row_key"), F.min("doc_id").alias("first_id"), F.first("bands").alias("bands")), "sets")
    banded = classes.select(F.explode("bands").alias("band"), "set_key")
    least = banded.groupBy("band").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low <> high").select("band", "low")
    candidates = C.cut(banded.join(least, "band").where("set_key <> low").select(F.col("set_key").alias("a"), F.col("low").alias("b")).distinct(), "candidates")
    parts = components(candidates)
    sized = parts.join(parts.groupBy("label").agg(F.count("*").alias("members")), "label").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    members = C.cut(
        sized.join(classes.drop("bands"), sized["node"] == classes["set_key"]).select("set_key", "label", "blocks", F.pmod(F.xxhash64("set_key"), "blocks").cast("int").alias("block"), "mult", "row_key"), "members"
    )
    wanted = C.broadcast_if_small(members.select(F.col("row_key").alias("want")), members.count())
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(wanted, texts["row_key"] == wanted["want"], "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["row_key"], pa.array([run_set(x).astype(np.int64) for x in batch["text"].to_pylist()], pa.list_(pa.int64()))], names=["row_key", "runs"])

    runs = texts.mapInArrow(C.tidied(sets, "words"), "row_key long, runs array<long>")
    full = runs.join(C.broadcast_if_small(members, members.count()), "row_key")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (
        full.withColumn("other", other)
        .select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_key", "mult", "runs")
        .repartition(C.n_parts(spark), "label", "i", "j")
        .sortWithinPartitions("label", "i", "j", "set_key")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd, xor = seeds(CHECKS, 2)
        floor = least_matches(threshold, tolerance)
        for g in groups(batches, ["label", "i", "j"]):
            ids = g["set_key"].to_numpy()
            keep = np.concatenate([[True], ids[1:] != ids[:-1]])  # rows that were repeated in the input come once
            g = g.filter(pa.array(keep)).combine_chunks()
            ids, block, mult = g["set_key"].to_numpy(), g["block"].to_numpy(), g["mult"].to_numpy()
            cross = g["i"][0].as_py() != g["j"][0].as_py()
            lists = g["runs"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            flat = lists.flatten().to_numpy().view(np.uint64)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            links, one, two = verify_block(ids, block, mult, ends, flat, cross, threshold, floor, odd, xor)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), -1)), pa.array(links)], names=["a", "b", "links"])
            if one:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(one)), pa.array(np.array(two)), pa.array(np.full(len(one), -1))], names=["a", "b", "links"])

    found = C.cut(dealt.mapInArrow(C.tidied(verify), "a long, b long, links long"), "verified")
    counts = found.where("links > 0").groupBy(F.col("a").alias("set_key")).agg(F.sum("links").alias("links"))
    labels = components(found.where("links < 0").select("a", "b"))
    of = classes.select("set_key", "mult", "first_id").join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
    heads = of.groupBy("label").agg(F.min("first_id").alias("class_id"), F.sum("mult").alias("class_size"))
    final = C.cut(of.join(heads, "label").join(counts, "set_key", "left").select("set_key", "label", "class_id", "class_size", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    return rows.select("doc_id", "row_key", "set_key").join(final, "set_key").select("doc_id", "row_key", "label", "class_id", "class_size", "n_links")


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that stay: of each class the one of the least doc_id, with all columns.

    Rows with that doc_id in the class: the one of the least row_key; of wholly equal (doc_id, text), one.
    """
    joined = C.cut(near_join(docs, **how), "near")
    one = joined.where("class_size > 1").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("m")).select("label", F.col("m.row_key").alias("first"))
    gone = C.cut(joined.where("class_size > 1").join(one, "label").where("row_key <> first").select(F.col("row_key").alias("_gone")).distinct(), "gone")
    keyed = docs.withColumn("_near_key", F.xxhash64(F.col("doc_id"), F.col("text")))
    left = keyed.join(C.broadcast_if_small(gone, gone.count()), F.col("_near_key") == F.col("_gone"), "left_anti")
    twice = C.cut(joined.where("class_size > 1").groupBy("row_key").count().where("count > 1").select(F.col("row_key").alias("_twice")), "twice")
    n = twice.count()
    if n:
        twice = C.broadcast_if_small(twice, n)
        again = left.join(twice, F.col("_near_key") == F.col("_twice"), "left_semi").dropDuplicates(["_near_key"])
        left = left.join(twice, F.col("_near_key") == F.col("_twice"), "left_anti").unionByName(again)
    return left.drop("_near_key")
