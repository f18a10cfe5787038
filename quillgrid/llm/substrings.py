"""Operator 7: removal of repeated byte strings, by bucket-pointer refinement.

Two positions of the corpus start an equal string of `length` bytes if their suffixes are in one bucket
after refinement to that depth. Buckets have 64-bit names instead of ranks (no order is needed): the name
of a suffix's bucket at depth 8 is its first bytes; at each step the bucket is refined by the bucket of a
later offset, depth 8 -> 16 -> 32 -> 64 -> length, names of one step being the input of the next.

Refining every position against all others would shuffle the corpus many times, so positions stand for
each other. Among the depth-32 buckets of a string of `length` bytes, the first least one is its anchor.
Equal strings have equal anchors at equal offsets, so only positions with one anchor bucket can meet. The
strings of one anchor are consecutive: a block.
1. Blocks (anchor bucket, bucket of the whole block) are brought together by anchor bucket. A block equal to
   an earlier one repeats it whole. A string that two blocks share reaches some way to the anchor's left and the
   rest of `length` to its right; for STEPS shares of that reach, blocks carry a 16-bit name of the bytes any such
   string must cover. Of different blocks with one anchor bucket, those that agree in one of them are undecided.
2. Undecided blocks are refined to their strings, which are brought together by their bucket; all but the
   first of a bucket are repeats.
3. Covered bytes are cut out of each text.
Chunks of texts are written to the shared folder once, and count once the manifest of their names is committed,
so that no step shuffles text and a repeated task meets the same chunks. A chunk sends one row for each block or
string it has, however often: a string that very many documents share costs each chunk a row.
Anchor buckets that a sample shows to be frequent are refined to strings at once, which keeps any bucket
small; the sample decides only the way, not the result.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

GRAM = 32
CHUNK = 3 << 20
#: Anchor buckets of more rows than this, as a sample has it, don't come to one task.
LARGE = 50_000
STEPS = 4


def paired(x: np.ndarray, y: np.ndarray, salt: int) -> np.ndarray:
    """Names of the buckets that have the names x, refined by those of a later offset, y."""
    with np.errstate(over="ignore"):
        x = x * C.U64(0x9E3779B97F4A7C15 + 2 * salt)
        x ^= x >> C.U64(32)
        x += y
        x *= C.U64(0xBF58476D1CE4E5B9)
        x ^= x >> C.U64(29)
    return x


def names32(data: np.ndarray) -> np.ndarray:
    """Names at depth 32 of every position that has as many bytes after it."""
    if len(data) < GRAM:
        return np.zeros(0, C.U64)
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)).astype(C.U64)
    b16 = paired(eight[:-8], eight[8:], 1)
    return paired(b16[:-16], b16[16:], 2)


def names_at(b32: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Names at depth `length` of the positions `at`."""
    b64 = lambda p: paired(b32[p], b32[p + 32], 3)
    return paired(b64(at), b64(at + length - 64), 4)


def window_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each window of `width` values; by doubling."""
    size = 1
    while size < width:
        step = min(size, width - size)
        v = np.minimum(v[: len(v) - step], v[step:])
        size += step
    return v


class Blocks:
    """The blocks of a chunk: texts one after the other; no string crosses from one to the next."""

    def __init__(self, texts: list[bytes], length: int):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        b32 = names32(np.frombuffer(b"".join(texts), np.uint8))
        width = length - GRAM + 1
        n = max(0, len(b32) - width + 1)
        if not n:
            self.doc = self.start = self.count = np.zeros(0, np.int64)
            self.anchor = self.name = self.sides = np.zeros(0, C.U64)
            return
        least = window_least(b32, width)
        begin = self.ends - self.sizes
        valid = np.zeros(n + 1, np.int32)  # positions whose string lies in one text
        has = np.flatnonzero(self.sizes >= length)
        np.add.at(valid, begin[has], 1)
        np.add.at(valid, self.ends[has] - length + 1, -1)
        valid = np.cumsum(valid[:-1]).astype(bool)
        new = np.ones(n, bool)  # another anchor: another value, or the last one's first place was the position just left
        new[1:] = (least[1:] != least[:-1]) | (b32[: n - 1] == least[:-1]) | ~valid[:-1]
        new[np.minimum(begin[has], n - 1)] = True
        heads = np.flatnonzero(new & valid)
        edge = np.flatnonzero(new | ~valid)
        nxt = np.searchsorted(edge, heads, side="right")
        tails = np.where(nxt < len(edge), edge[np.minimum(nxt, len(edge) - 1)], n)  # one past the block's last position
        self.start, self.count = heads, tails - heads
        self.doc = np.searchsorted(self.ends, heads, side="right")
        self.anchor = least[heads]
        a = np.empty(len(heads), np.int64)
        for k in range(0, len(heads), 20_000):
            z = slice(k, k + 20_000)
            a[z] = heads[z] + (b32[heads[z, None] + np.arange(width)] == self.anchor[z, None]).argmax(1)
        with np.errstate(over="ignore"):
            self.name = C.mix(names_at(b32, heads, length) ^ C.mix(names_at(b32, tails - 1, length) + self.count.astype(C.U64)))
        reach = length - GRAM  # what a shared string has beside the anchor, left and right together
        lo, hi = begin[self.doc], self.ends[self.doc]
        self.sides = np.zeros(len(a), C.U64)
        for k in range(STEPS):
            left, right = reach * k // STEPS, reach - reach * (k + 1) // STEPS
            self.sides |= self._window(b32, a - left, left + GRAM + right, (a - left >= lo) & (a + GRAM + right <= hi)) << C.U64(16 * k)

    @staticmethod
    def _window(b32: np.ndarray, i: np.ndarray, width: int, there: np.ndarray) -> np.ndarray:
        """16-bit names, above 0, of `width` bytes from each position i; 0 where the text is too short."""
        x = C.U64(width)
        with np.errstate(over="ignore"):
            for at in [*range(0, width - GRAM, GRAM), width - GRAM]:
                x = C.mix(x * C.U64(3) + b32[np.clip(i + at, 0, len(b32) - 1)])
        return np.where(there, (x >> C.U64(48)) | C.U64(1), C.U64(0))


def firsts(names: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Which rows are the first of their name, in the order given (none: that of the rows)."""
    if not len(names):
        return np.zeros(0, bool)
    at = np.argsort(names)
    s = names[at]
    head = np.ones(len(s), bool)
    head[1:] = s[1:] != s[:-1]
    out = np.zeros(len(names), bool)
    if not order:
        out[np.minimum.reduceat(at, np.flatnonzero(head))] = True
        return out
    alone = head & np.append(head[1:], True)
    out[at[alone]] = True
    at = at[~alone]  # names that come more than once
    at = at[np.lexsort((*(x[at] for x in reversed(order)), names[at]))]
    s = names[at]
    head = np.ones(len(s), bool)
    head[1:] = s[1:] != s[:-1]
    out[at[head]] = True
    return out


SENT, REPEAT, HOT = 0, 1, 2


def write_blocks(uri: str, b: Blocks, state: np.ndarray) -> None:
    """A chunk's blocks, small: their first positions as gaps after the block before, their counts, and a state each."""
    gaps = b.start - np.concatenate([[0], (b.start + b.count)[:-1]])[: len(b.start)]
    table = pa.table({"gap": pa.array(gaps.astype(np.int32)), "count": pa.array(b.count.astype(np.uint8)), "state": pa.array(state)})
    with _Renamed(*C.open_fs(uri)) as sink, pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
        f.write_table(table)


def read_blocks(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first position, count, state) of each block."""
    t = read_chunk(uri)
    count = t["count"].to_numpy().astype(np.int64)
    return np.cumsum(t["gap"].to_numpy() + np.concatenate([[0], count[:-1]])[: len(count)]), count, t["state"].to_numpy().copy()


def positions(start: np.ndarray, count: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Every position of the blocks `which`, one after the other."""
    start, n = start[which], count[which]
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def ids_of(t: pa.Table) -> np.ndarray:
    """doc_id, null: the least number."""
    return pc.fill_null(t["doc_id"], np.iinfo(np.int64).min).to_numpy()


def exact_names(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Bucket numbers at depth `length` of the positions `starts`, equal where the bytes are: bucket-pointer refinement.

    Every position points to its bucket of equal 8 bytes. A bucket is refined by sorting its positions on their own
    pointer and that of a later offset; the new pointers are those that the next step sorts on (8, 16, 32, 64, length).
    A position alone in its bucket is settled: it keeps a number of its own and is sorted no more.
    """
    n = len(data) - 7
    words = np.ndarray((n,), "<u8", np.ascontiguousarray(data), strides=(1,))
    pointer, open_ = sorted_buckets(words.astype(C.U64))
    depth = 8
    while depth < length:
        step = min(depth, length - depth)
        open_ = open_[open_ + step < n]  # what reaches beyond the data is no start
        bucket, still = sorted_buckets((pointer[open_] << C.U64(32)) | pointer[open_ + step])
        fresh = np.arange(n, 2 * n, dtype=C.U64)  # above all bucket numbers
        fresh[open_[still]] = bucket[still]
        pointer, open_ = fresh, open_[still]
        depth += step
    return pointer[starts]


def sorted_buckets(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key's bucket in sorted order, which rows share theirs with another)."""
    order = np.argsort(keys)
    s = keys[order]
    head = np.ones(len(s), bool)
    head[1:] = s[1:] != s[:-1]
    number = np.empty(len(s), C.U64)
    number[order] = np.cumsum(head) - 1
    shared = ~(head & np.append(head[1:], True)) if len(s) else head
    return number, np.sort(order[shared])


def read_chunk(uri: str) -> pa.Table:
    fs, path = C.open_fs(uri)
    with fs.open_input_file(path) as f:
        return pa.ipc.open_file(f).read_all()


def deduplicate(docs: DataFrame, *, length: int = 100, keep_text: bool = False, sample: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) of every row of docs (doc_id, text).

    A byte goes if a string of `length` bytes (GRAM + 1 to 127 of them are refined to; at least 65) that covers it
    also starts earlier: at a smaller doc_id (null: smallest), of equal ids in a text that is smaller in
    bytes, or earlier in the same text; all judged on the input. Strings don't cross texts. Null text: as
    empty. Rows equal in doc_id and text count as one text each, one of them first. Buckets are told apart
    by 64-bit names.
    """
    if not 65 <= length <= 128:
        raise ValueError("length must be from 65 to 128")
    spark = docs.sparkSession
    C.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    folder = C.shared_dir(spark, "substrings")
    fs, path = C.open_fs(folder)
    fs.create_dir(path, recursive=True)

    # How often anchor buckets occur in a sample of texts; large ones are refined to strings at once.
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = Blocks([t.encode("utf-8", "surrogatepass") for t in batch["text"].to_pylist()], length)
            pairs = np.unique(np.stack([b.anchor, b.doc.astype(C.U64)]), axis=1)[0] if len(b.doc) else b.anchor
            names, n = np.unique(pairs, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(n)], names=["anchor", "n"])

    sampled = docs.where(F.pmod(F.xxhash64(F.lit(7), "doc_id", F.substring("text", 1, 64)), F.lit(sample)) == 0)
    frequent = sampled.mapInArrow(C.tidied(anchors), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") * sample >= LARGE).select("anchor").collect()
    hot = np.sort(np.array([r["anchor"] for r in frequent], np.int64).view(C.U64))  # at most a LARGE-th of all positions
    sent = spark.sparkContext.broadcast(hot)

    row = pa.schema([("chunk", pa.string()), ("anchor", pa.int64()), ("name", pa.int64()), ("sides", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("block", pa.int32())])

    def is_hot(b: Blocks) -> np.ndarray:
        hot = sent.value
        if not len(hot):
            return np.zeros(len(b.anchor), bool)
        at = np.minimum(np.searchsorted(hot, b.anchor), len(hot) - 1)
        return hot[at] == b.anchor

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        rows, size = [], 0

        def flush() -> pa.RecordBatch:
            name = f"chunk-{uuid.uuid4().hex}.arrow"
            rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
            table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "tie": pa.array([r[1] for r in rows], pa.int64()), "text": pa.array([r[2] for r in rows], pa.large_binary())})
            with _Renamed(*C.open_fs(f"{folder}/{name}")) as sink, pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
                f.write_table(table)
            return pa.RecordBatch.from_pydict({"chunk": [name]})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                rows.append((doc_id, int.from_bytes(hashlib.sha256(data).digest()[:8], "big", signed=True), data))
                size += len(data)
                if size >= CHUNK:
                    yield flush()
                    rows, size = [], 0
        if rows:
            yield flush()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["chunk"].to_pylist():
                t = read_chunk(f"{folder}/{name}")
                b = Blocks([x.as_py() for x in t["text"]], length)
                ids, ties = ids_of(t), t["tie"].to_numpy()
                state = np.where(is_hot(b), np.int8(HOT), np.int8(REPEAT))
                cold = np.flatnonzero(state != HOT)
                k = cold[firsts(b.name[cold] ^ C.mix(b.anchor[cold].copy()))]
                state[k] = SENT
                write_blocks(f"{folder}/{name}.blocks", b, state)
                doc = b.doc[k]
                at = (b.start[k] - (b.ends - b.sizes)[doc]).astype(np.int32) if len(k) else np.zeros(0, np.int32)
                for a in range(0, len(k), 50_000):
                    z = slice(a, a + 50_000)
                    cols = (b.anchor[k[z]].view(np.int64), b.name[k[z]].view(np.int64), b.sides[k[z]].view(np.int64), ids[doc[z]], ties[doc[z]], at[z], k[z].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([name]).take(pa.array(np.zeros(len(k[z]), np.int32))), *map(pa.array, cols)], schema=row)

    spec = "chunk string, anchor long, name long, sides long, doc_id long, tie long, start int, block int"
    parts = C.n_parts(spark)
    chunks = C.cut(docs.mapInArrow(C.tidied(cut_up), "chunk string"), "substrings-chunks")
    n_chunks = chunks.count()
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{', kept binary' if keep_text else ''}"
    if not n_chunks:
        return spark.createDataFrame([], schema)
    dealt = chunks.repartition(min(n_chunks, 4 * parts)).mapInArrow(C.tidied(send), spec).repartition(2 * parts, "anchor").sortWithinPartitions("anchor")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_anchors(batches):
            chunk = t["chunk"].combine_chunks().dictionary_encode()
            chunk = chunk.combine_chunks() if isinstance(chunk, pa.ChunkedArray) else chunk
            anchor, name, sides, doc_id, tie, start, block = (t[c].to_numpy() for c in row.names[1:])
            mixed = C.mix(anchor.view(C.U64).copy())
            first = firsts(name.view(C.U64) ^ mixed, doc_id, tie, start)
            # Of the first ones, those that agree with another block of the anchor's bucket in a share of the reach.
            one = np.flatnonzero(first)
            open_ = np.zeros(len(name), bool)
            for k in range(STEPS):
                s = (sides.view(C.U64)[one] >> C.U64(16 * k)) & C.U64(0xFFFF)
                sub = one[s > 0]
                with np.errstate(over="ignore"):
                    key = mixed[sub] + s[s > 0] * C.U64(0x9E3779B97F4A7C15)
                order = np.argsort(key)
                same = key[order][1:] == key[order][:-1]
                open_[sub[order[1:][same]]] = open_[sub[order[:-1][same]]] = True
            for kind, of in ((1, ~first), (2, open_)):
                k = np.flatnonzero(of)
                if len(k):
                    yield pa.RecordBatch.from_arrays([chunk.take(pa.array(k)).dictionary_decode(), pa.array(np.full(len(k), kind, np.int8)), pa.array(block[k])], names=["chunk", "kind", "block"])

    marks_dir = f"{folder}/marks"
    marked = dealt.mapInArrow(C.tidied(meet), "chunk string, kind byte, block int")
    grouped = marked.groupBy("chunk").agg(F.collect_list(F.when(F.col("kind") == 1, F.col("block"))).alias("repeats"), F.collect_list(F.when(F.col("kind") == 2, F.col("block"))).alias("undecided"))
    grouped.write.parquet(marks_dir)  # a row a chunk: at most as many numbers as the chunk has blocks
    marks = chunks.join(spark.read.parquet(marks_dir), "chunk", "left").repartition(min(n_chunks, 4 * parts))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of undecided blocks."""
        for batch in batches:
            for name, undecided in zip(batch["chunk"].to_pylist(), batch["undecided"], strict=True):
                which = np.sort(_ints(undecided))
                if not len(which):
                    continue
                start, count, _ = (x[which] for x in read_blocks(f"{folder}/{name}.blocks"))
                t = read_chunk(f"{folder}/{name}")
                data = b"".join(x.as_py() for x in t["text"])
                b32 = names32(np.frombuffer(data, np.uint8))
                anchor = np.concatenate([b32[start[a : a + 20_000, None] + np.arange(length - GRAM + 1)].min(1) for a in range(0, len(start), 20_000)])
                ends = np.cumsum(pc.binary_length(t["text"]).to_numpy())
                doc = np.searchsorted(ends, start, side="right")
                at = start - np.concatenate([[0], ends])[doc]
                ids, ties = ids_of(t), t["tie"].to_numpy()
                for a in range(0, len(start), 10_000):
                    z = slice(a, a + 10_000)
                    body = pa.array([data[p : p + n + length - 1] for p, n in zip(start[z], count[z], strict=True)], pa.binary())
                    cols = (anchor[z].view(np.int64), ids[doc[z]], ties[doc[z]], at[z].astype(np.int32), start[z].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([name]).take(pa.array(np.zeros(len(body), np.int32))), *map(pa.array, cols), body], names=["chunk", "anchor", "doc_id", "tie", "start", "place", "body"])

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The strings of undecided blocks of some anchors, refined against each other; all but the first of a bucket repeat it."""
        for t in whole_anchors(batches, size=10_000):
            body = t["body"].combine_chunks()
            sizes = pc.binary_length(body).to_numpy()
            data = np.frombuffer(b"".join(body.to_pylist()), np.uint8)
            n = sizes - length + 1
            row_of = np.repeat(np.arange(len(sizes)), n)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            names = exact_names(data, (np.cumsum(sizes) - sizes)[row_of] + inside, length)
            doc_id, tie, start, place = (t[c].to_numpy() for c in ("doc_id", "tie", "start", "place"))
            later = ~firsts(names, doc_id[row_of], tie[row_of], start[row_of] + inside)
            yield from runs_of(t["chunk"], row_of, place[row_of] + inside, later)

    def runs_of(chunk, row_of: np.ndarray, place: np.ndarray, later: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The positions marked `later`, consecutive ones of a row as one: chunk, place, n."""
        k = np.flatnonzero(later)
        if len(k):
            head = np.ones(len(k), bool)
            head[1:] = (row_of[k][1:] != row_of[k][:-1]) | (place[k][1:] != place[k][:-1] + 1)
            at = np.flatnonzero(head)
            out = pa.Table.from_arrays([chunk.take(pa.array(row_of[k][at])), pa.array(place[k][at].astype(np.int32)), pa.array(np.diff(np.append(at, len(k))).astype(np.int32))], names=["chunk", "place", "n"])
            yield from out.combine_chunks().to_batches()

    spread_spec = "chunk string, anchor long, doc_id long, tie long, start int, place int, body binary"
    undecided = marks.where(F.size("undecided") > 0).select("chunk", "undecided").mapInArrow(C.tidied(spread), spread_spec)
    later = undecided.repartition(2 * parts, "anchor").sortWithinPartitions("anchor").mapInArrow(C.tidied(refine), "chunk string, place int, n int")

    def to_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The names of strings in frequent anchor buckets: one row for each different one of a chunk; its others are written down as known."""
        for batch in batches:
            for name, repeats in zip(batch["chunk"].to_pylist(), batch["repeats"], strict=True):
                start, count, state = read_blocks(f"{folder}/{name}.blocks")
                ask = state == HOT
                places = positions(start, count, ask)
                if len(places):
                    t = read_chunk(f"{folder}/{name}")
                    texts = t["text"]
                    ends = np.cumsum(pc.binary_length(texts).to_numpy())
                    names = names_at(names32(np.frombuffer(b"".join(x.as_py() for x in texts), np.uint8)), places, length)
                    lead = firsts(names)
                    again, places, names = places[~lead], places[lead], names[lead]
                    with _Renamed(*C.open_fs(f"{folder}/{name}.known")) as sink:
                        sink.write(again.astype("<i8").tobytes())
                    doc = np.searchsorted(ends, places, side="right")
                    at = places - np.concatenate([[0], ends])[doc]
                    ids, ties = ids_of(t), t["tie"].to_numpy()
                    for a in range(0, len(places), 50_000):
                        z = slice(a, a + 50_000)
                        cols = (names[z].view(np.int64), ids[doc[z]], ties[doc[z]], at[z].astype(np.int32), places[z].astype(np.int32))
                        yield pa.RecordBatch.from_arrays([pa.array([name]).take(pa.array(np.zeros(len(names[z]), np.int32))), *map(pa.array, cols)], names=["chunk", "name", "doc_id", "tie", "start", "place"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_anchors(batches, "name"):
            again = ~firsts(t["name"].to_numpy().view(C.U64), t["doc_id"].to_numpy(), t["tie"].to_numpy(), t["start"].to_numpy())
            yield from runs_of(t["chunk"], np.arange(len(again)), t["place"].to_numpy(), again)

    if len(hot):
        strings = marks.select("chunk", "repeats").mapInArrow(C.tidied(to_strings), "chunk string, name long, doc_id long, tie long, start int, place int").repartition(2 * parts, "name").sortWithinPartitions("name")
        later = later.unionByName(strings.mapInArrow(C.tidied(settle), "chunk string, place int, n int"))
    later_dir = f"{folder}/later"
    later.groupBy("chunk").agg(F.collect_list(F.struct("place", "n")).alias("places")).write.parquet(later_dir)
    found = spark.read.parquet(later_dir).select("chunk", F.col("places.place").alias("places"), F.col("places.n").alias("counts"))
    final = marks.select("chunk", "repeats").join(found, "chunk", "left").repartition(min(n_chunks, 4 * parts))
    any_hot = len(hot) > 0

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, repeats, places, counts in zip(batch["chunk"].to_pylist(), batch["repeats"], batch["places"], batch["counts"], strict=True):
                t = read_chunk(f"{folder}/{name}")
                texts = [x.as_py() for x in t["text"]]
                sizes = np.array([len(x) for x in texts], np.int64)
                total = int(sizes.sum())
                start, count, state = read_blocks(f"{folder}/{name}.blocks")
                done = state == REPEAT  # equal to an earlier block of the chunk
                done[_ints(repeats)] = True
                again = np.zeros(0, np.int64)
                if any_hot and (state == HOT).any():
                    f, p = C.open_fs(f"{folder}/{name}.known")
                    with f.open_input_stream(p) as s:
                        again = np.frombuffer(s.read(), "<i8")
                starts = np.concatenate([start[done], again, _ints(places)])
                runs = np.concatenate([count[done], np.ones(len(again), np.int64), _ints(counts)])
                step = np.zeros(total + 1, np.int32)
                np.add.at(step, starts, 1)
                np.add.at(step, starts + runs + length - 1, -1)
                gone = np.cumsum(step[:-1]) > 0
                rows, held, at = [], 0, 0
                for x, n in zip(texts, sizes, strict=True):
                    g = gone[at : at + n]
                    at += n
                    kept = np.frombuffer(x, np.uint8)[~g].tobytes() if g.any() else x
                    spans = int((g[1:] & ~g[:-1]).sum() + g[0]) if n else 0
                    rows.append((len(x), len(x) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()], strict=True)]
                out = pa.Table.from_arrays([t["doc_id"].combine_chunks(), *cols[: 5 if keep_text else 4]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if keep_text else 5])
                yield from out.combine_chunks().to_batches(max_chunksize=1000)

    return final.mapInArrow(C.tidied(finish), schema)


def whole_anchors(batches: Iterator[pa.RecordBatch], key: str = "anchor", size: int = 200_000) -> Iterator[pa.Table]:
    """Tables of about `size` rows of batches sorted by key; rows of a key are never parted."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if n >= size:
            k = batch[key].to_numpy()
            change = np.flatnonzero(k != held[-1][key][-1].as_py())
            cut = int(change[0]) if len(change) else len(k)
            held.append(batch.slice(0, cut))
            n += cut
            if cut < len(k):
                yield pa.Table.from_batches(held)
                held, n = [batch.slice(cut)], len(k) - cut
        else:
            held.append(batch)
            n += batch.num_rows
    if n:
        yield pa.Table.from_batches(held)


def _ints(x) -> np.ndarray:
    """The numbers of an Arrow list scalar, null: none."""
    return x.values.to_numpy(zero_copy_only=False).astype(np.int64) if x.is_valid and x.values is not None else np.zeros(0, np.int64)


class _Renamed:
    """A new file that has its name only when it is complete."""

    def __init__(self, fs, path: str):
        import uuid

        self.fs, self.path, self.tmp = fs, path, f"{path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        self.sink = self.fs.open_output_stream(self.tmp)
        return self.sink

    def __exit__(self, kind, *_):
        self.sink.close()
        if kind is None:
            self.fs.move(self.tmp, self.path)
