"""Operator 4: benchmark decontamination with BM25 and block-max WAND, and a check of question and answer.

Test items form an inverted index: a posting list a term, in item order, with BM25 weights as shares of the item's
whole score, so that one threshold holds for all items. A list is cut at the same item ids into blocks, each with its
maximum. Every training passage (overlapping windows of words, the whole text) is a query. The maxima rule out
blocks of items that can't reach the threshold; in the others, cursors on the posting lists move to the pivot, the
first item that the lists' maxima allow to reach it, and skip what lies before. Every item above the
threshold is a candidate (none is dropped for rank). A candidate counts if the window also
has enough of the word runs of the item's question and of its answer. Windows are as long as the items' length
class (64 words or the next power of two), and each class has indexes of its own: what is found of an item
does not depend on the others but by the BM25 statistics, which are those of all items.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
BLOCK = 8
ITEMS = 1024
RUN = 3
WINDOWS = 4096
ANSWER = RUN + 1  # so many words, for half the runs of a shorter answer are gone with its last word


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words, parted before its last sentence or line, or before as many of these as hold ANSWER words; the last third of the words
    (ANSWER at least, and three at least before them) if that leaves no question."""
    parts = [w for p in re.split(r"(?<=[.?!])\s+|\n+", text) if (w := words(p))]
    k = len(parts) - 1
    while k > 0 and sum(map(len, parts[k:])) < ANSWER:
        k -= 1
    w = list(chain.from_iterable(parts))
    cut = sum(map(len, parts[:k])) if k > 0 else len(w) - max(len(w) // 3, min(ANSWER, len(w) - RUN))
    return w[:cut], w[cut:]


def runs(w: list[str], n: int = RUN) -> set[tuple[str, ...]]:
    n = min(n, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()


def length_class(n: int) -> int:
    """Words of the windows that items of n words are looked for in: half of such a window at least."""
    return max(64, 1 << max(0, n - 1).bit_length())


class Index:
    """An inverted index of at most ITEMS items. over: how many items there are in all, their mean length, and how many have a word; else those of `items`."""

    def __init__(self, items: list[tuple[int, str]], over: tuple[int, float, dict[str, int]] | None = None):
        self.ids = [i for i, _ in items]
        texts = [words(t) for _, t in items]
        self.parts = [tuple(map(runs, question_answer(t))) for _, t in items]
        self.size = length_class(max(map(len, texts), default=0))
        self.short = {k: t for k, t in enumerate(texts) if len(t) < 2 * RUN}  # these must stand word for word
        every, mean, df = over or (len(texts), sum(map(len, texts)) / max(1, len(texts)), Counter(chain.from_iterable(map(set, texts))))
        mean = max(1.0, mean)
        self.vocab = {w: k for k, w in enumerate(sorted(set(chain.from_iterable(texts))))}
        rows = []
        for k, t in enumerate(texts):
            own = [(self.vocab[w], k, math.log(1 + (every - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(t) / mean))) for w, tf in sorted(Counter(t).items())]
            total = max(sum(w for _, _, w in own), 1e-9)
            rows += [(term, item, w / total) for term, item, w in own]
        rows.sort()
        term, self.item, self.share = (np.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else ([], [], []), (np.int64, np.int64, np.float64), strict=True))
        self.first = np.searchsorted(term, np.arange(len(self.vocab) + 1))  # where a term's list begins
        self.place = term * len(items) + self.item  # ascending: a cursor of any term finds an item in it
        block = term * (len(items) // BLOCK + 1) + self.item // BLOCK
        heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
        self.blocks = (len(items) - 1) // BLOCK + 1
        self.block, self.block_most = self.item[heads] // BLOCK, np.maximum.reduceat(self.share, heads) if len(heads) else self.share
        self.first_block = np.searchsorted(heads, self.first)
        self.top = np.maximum.reduceat(self.share, self.first[:-1]) if len(self.vocab) else self.share

    def candidates(self, w: list[str], threshold: float) -> Iterator[tuple[int, int, int, float]]:
        """(item, from, to, share) of windows of the words w whose BM25 share of the item reaches the threshold."""
        size, unknown, least = self.size, len(self.vocab), threshold - 1e-5
        at = np.fromiter(map(self.vocab.get, w, repeat(unknown)), np.int64, len(w))
        known = np.flatnonzero(at != unknown)
        if not len(known):
            return
        # A window is two segments of `size` words, and begins where the last one's second segment does.
        segment = known // size
        n = max(1, -(-len(w) // size) - 1)
        both = np.concatenate([segment, segment - 1])
        pairs = np.unique((both * unknown + np.tile(at[known], 2))[(both >= 0) & (both < n)])
        window, term = pairs // unknown, pairs % unknown
        for a in range(0, n, WINDOWS):  # so many windows at a time, however long the text
            z = min(n, a + WINDOWS)
            part = slice(*np.searchsorted(window, (a, z)))
            here, terms = window[part] - a, term[part]
            live = (np.bincount(here, self.top[terms], minlength=z - a) >= least)[here]  # others have no pivot
            here, terms = here[live], terms[live]
            lists = self.first_block[terms + 1] - self.first_block[terms]
            of = np.repeat(self.first_block[terms] - (np.cumsum(lists) - lists), lists) + np.arange(lists.sum())
            bound = np.bincount(np.repeat(here, lists) * self.blocks + self.block[of], self.block_most[of], minlength=(z - a) * self.blocks).reshape(-1, self.blocks)
            hits = bound >= least
            for k in np.flatnonzero(hits.any(1)):
                query = terms[np.searchsorted(here, k) : np.searchsorted(here, k + 1)]
                for item, score in self.pivots(query, np.flatnonzero(hits[k]), least):
                    yield item, int((a + k) * size), min(len(w), int((a + k + 2) * size)), score

    def pivots(self, query: np.ndarray, blocks: np.ndarray, least: float) -> Iterator[tuple[int, float]]:
        """(item, share) of the items in `blocks` whose share from the terms `query` is at least `least`, in item order."""
        n, top, ends = len(self.ids), self.top[query], self.first[query + 1]
        cursor = np.searchsorted(self.place, query * n + blocks[0] * BLOCK)

        def items() -> np.ndarray:
            return np.where(cursor < ends, self.item[np.minimum(cursor, len(self.item) - 1)], n)

        now = items()
        while True:
            order = np.argsort(now, kind="stable")
            reach = np.cumsum(top[order])
            p = int(np.searchsorted(reach, least))
            if p == len(order) or now[order[p]] >= n:
                return
            pivot = int(now[order[p]])
            b = int(np.searchsorted(blocks, pivot // BLOCK))
            if b == len(blocks):
                return
            if blocks[b] != pivot // BLOCK:  # the block's maxima rule it out
                to = int(blocks[b]) * BLOCK
            elif now[order[0]] == pivot:
                here = now == pivot
                if (score := float(self.share[cursor[here]].sum())) >= least:
                    yield pivot, score
                to = pivot + 1
            else:
                to = pivot
            behind = now < to
            cursor[behind] = np.maximum(cursor[behind], np.searchsorted(self.place, query[behind] * n + to))
            now = items()

    def verify(self, item: int, window: list[str], least: float) -> tuple[float, float] | None:
        """(share of the question's word runs in the window, of the answer's) if both reach `least`."""
        if item in self.short:
            t = self.short[item]
            return (1.0, 1.0) if any(window[k : k + len(t)] == t for k in range(len(window) - len(t) + 1)) else None
        shares = []
        for want in self.parts[item]:
            n = len(next(iter(want))) if want else 0
            have = runs(window, n) if n and len(window) >= n else set()
            shares.append(len(want & have) / len(want) if want else 1.0)
        return (shares[0], shares[1]) if min(shares) >= least else None

    def leaks(self, w: list[str], threshold: float, least: float) -> dict[int, tuple[float, float, float]]:
        """item id -> its best (share, question, answer) over the text's windows."""
        found: dict[int, tuple[float, float, float]] = {}
        for item, a, z, share in self.candidates(w, threshold):
            if (v := self.verify(item, w[a:z], least)) is not None:
                got = (share, *v)
                found[self.ids[item]] = max(found.get(self.ids[item], got), got)
        return found


def indexes(items: DataFrame, most_bytes: int = 16 << 20) -> Iterator[list[Index]]:
    """Indexes over all items (item_id, text; null text: none), in groups of at most most_bytes of text, which bounds what is sent to executors.

    Item counts of words, the number of items and their mean length are those of all groups together."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").dropDuplicates()
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-n_bytes // most_bytes)
    if not n:
        return
    items = C.cut(items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")), "items")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, text in zip(batch["part"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if t := words(text):
                    rows += [(part, None, len(t)), *((part, w, 1) for w in set(t))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32(), pa.string(), pa.int64()], strict=True)], names=["part", "word", "n"])

    found = C.cut(items.select("part", "text").mapInArrow(C.tidied(work), "part int, word string, n long").groupBy("part", "word").agg(F.sum("n").alias("n"), F.count("*").alias("items")), "item-words")
    lengths = found.where("word IS NULL").agg(F.sum("items").alias("items"), F.sum("n").alias("n")).first()
    every = lengths["items"] or 0
    counts = C.cut(found.where("word IS NOT NULL").groupBy("word").agg(F.sum("items").alias("items")), "item-counts")
    for k in range(n):
        rows = items.where(F.col("part") == k).collect()  # within most_bytes, about
        rows = sorted(((r["item_id"], r["text"]) for r in rows if words(r["text"])), key=lambda r: (r[0] is None, r))
        df = {r["word"]: r["items"] for r in counts.join(found.where(F.col("part") == k).select("word"), "word", "left_semi").collect()}  # the words of these rows
        classes: dict[int, list] = {}
        for r in rows:
            classes.setdefault(length_class(len(words(r[1]))), []).append(r)
        yield [Index(of[a : a + ITEMS], (every, lengths["n"] / every, df)) for _, of in sorted(classes.items()) for a in range(0, len(of), ITEMS)]


def find_leaks(docs: DataFrame, items: DataFrame, *, threshold: float = 0.6, least: float = 0.5) -> DataFrame:
    """doc_id, item_id, score, question, answer: a row for each document that holds an item.

    score: the best window's share of the item's BM25 score; question and answer: shares of their runs of
    three words in it. Items of under six words count only word for word; an item or text without words
    is never found. Equal items count once, items of one id and different texts each; equal documents each have their rows. Null texts: none. No shuffle of documents: the index goes to them, in groups of bounded size.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    schema = "doc_id long, item_id long, score double, question double, answer double"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for group in indexes(items):
        sent = spark.sparkContext.broadcast(group)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    w = words(text) if text else []
                    for index in sent.value if w else ():
                        rows += [(doc_id, item, *v) for item, v in index.leaks(w, threshold, least).items()]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "score", "question", "answer"])

        part = docs.mapInArrow(C.tidied(work), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def remove_leaks(docs: DataFrame, items: DataFrame, *, threshold: float = 0.6, least: float = 0.5) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; rows go as they are found, without a join."""
    C.small_batches(docs.sparkSession)
    for group in indexes(items):
        sent = docs.sparkSession.sparkContext.broadcast(group)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not (w := words(text) if text else []) or not any(index.leaks(w, threshold, least) for index in sent.value) for text in batch["text"].to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(C.tidied(work), docs.schema)
    return docs
