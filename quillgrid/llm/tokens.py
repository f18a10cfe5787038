"""Operator 1: token ids in Arrow IPC files of equal-length sequences and masks.

A file holds the ids of a range of documents, in ascending doc_id, one after the other and cut into
sequences of `length` ids. Its record batches have two columns, both fixed-size lists of `length`:
`ids` (uint16 where the vocabulary fits, else uint32) and `mask` (boolean; false only in the padding
of a file's last sequence). Buffers aren't compressed, so a memory map gives any sequence without a
copy: sequence k is row k % batch of batch k // batch. `<file>.docs` beside it says where documents
lie. manifest.json, written last under a temporary name and renamed, lists the files that count.
"""

import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BATCH = 64

# The splitter that words_of is made for (a fixed value of the vocabulary file), behind a normaliser that makes small letters.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: A full stop or comma that may not be the start of a piece: what precedes it isn't among the letters, digits and blanks
#: that stay what they are when normalised (a mark, or a letter such as U+0130 that becomes letter and mark).
MARKS = r"[^A-Za-z0-9À-ÖØ-öø-įı-žΑ-ΡΣ-Ωα-ωА-яЁё一-鿿ぁ-ゖァ-ヺ \n\t\r][.,]"


def words_of(texts: pa.Array) -> pa.ListArray:
    """Each text in parts that no piece of the vocabulary's splitter crosses, small letters where that is sure to change no id.

    Special tokens are matched with their case, so texts that may hold something like them keep theirs.
    """
    wide = pc.match_substring_regex(texts, r"[\x{100}-\x{10FFFF}]")
    texts = pc.if_else(pc.or_(wide, pc.match_substring(texts, "<|")), texts, pc.utf8_lower(texts))
    texts = pc.replace_substring(texts, "\n", " ")
    marks = pc.match_substring_regex(texts, MARKS)
    apart = pc.binary_join_element_wise(texts, "", " ")
    for mark in (".", ","):
        apart = pc.replace_substring(apart, f"{mark} ", f" {mark} ")
    return pc.split_pattern(pc.if_else(marks, texts, apart), " ")


class Encoder:
    """Ids of whole texts. Words are encoded once and remembered, up to a bounded number.

    The vocabulary's splitter removes white space and parts letters from marks, so a text's ids are
    those of its words in order. Words that the memory doesn't hold are encoded together. A vocabulary
    with another splitter gets whole texts.
    """

    MOST = 500_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        how = json.loads(self.tok.to_str())
        kinds = [x["type"] for x in (how["normalizer"] or {}).get("normalizers", [])]
        steps = (how["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.parted = kinds == ["NFC", "Replace", "Lowercase"] and steps[0].get("pattern") == {"Regex": SPLITTER} and steps[0].get("behavior") == "Removed"
        self.width = np.uint16 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.known: dict[str, int] = {"": 0}
        self.flat = np.zeros(1 << 20, self.width)
        self.starts, self.sizes = np.zeros(self.MOST, np.int64), np.zeros(self.MOST, np.int64)
        self.used = 0

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word). A word of the letters a to z is one piece that normalising leaves alone: the model gives its ids at once."""
        piece = self.tok.model.tokenize
        ids = [[t.id for t in piece(w)] if w.isascii() and w.isalpha() and w.islower() else None for w in words]
        odd = [k for k, x in enumerate(ids) if x is None]
        if odd:
            got = self.tok.encode([words[k] for k in odd], is_pretokenized=True, add_special_tokens=False)
            ends, every = np.cumsum(np.bincount(np.array(got.word_ids, np.int64), minlength=len(odd))).tolist(), got.ids
            for k, a, z in zip(odd, [0, *ends], ends, strict=False):
                ids[k] = every[a:z]
        return np.fromiter(itertools.chain.from_iterable(ids), self.width), np.fromiter(map(len, ids), np.int64, len(ids))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text). Texts are split and their words told apart in Arrow; only different words are looked up."""
        if not self.parted:
            got = [np.array(x.ids, self.width) for x in self.tok.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, self.width), *got]), np.fromiter(map(len, got), np.int64, len(got))
        lists = words_of(texts)
        per_text = lists.value_lengths().to_numpy()
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = self.known
        at = np.fromiter(map(known.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        flat, more_starts, more_sizes = self.flat, np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(new):
            names = [words[i] for i in new]
            ids, sizes = self._encode(names)
            ends = np.cumsum(sizes)
            n, keep = len(known), min(len(names), self.MOST - len(known))
            size = int(ends[keep - 1]) if keep else 0
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), self.width)])
            flat = self.flat
            flat[self.used : self.used + len(ids)] = ids  # what isn't kept is overwritten next time
            starts = self.used + ends - sizes
            self.starts[n : n + keep], self.sizes[n : n + keep] = starts[:keep], sizes[:keep]
            known.update(zip(names[:keep], range(n, n + keep), strict=True))
            self.used += size
            more_starts, more_sizes = starts[keep:], sizes[keep:]
            at[new] = np.concatenate([np.arange(n, n + keep), np.arange(self.MOST, self.MOST + len(names) - keep)])
        start, size = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        held = at < self.MOST
        start[held], size[held] = self.starts[at[held]], self.sizes[at[held]]
        start[~held], size[~held] = more_starts[at[~held] - self.MOST], more_sizes[at[~held] - self.MOST]
        code = coded.indices.to_numpy()
        small = np.int32 if len(flat) < 1 << 31 and len(code) * int(size.max(initial=0)) < 1 << 31 else np.int64
        start, size = start.astype(small)[code], size.astype(small)[code]
        ends = np.cumsum(size, dtype=small)
        index = np.repeat(start - (ends - size), size)
        index += np.arange(len(index), dtype=small)
        text_ends = np.concatenate([[0], ends])[np.cumsum(per_text)]
        return flat[index], np.diff(text_ends, prepend=0)


def encoder(path: str) -> Encoder:
    state = C.worker_state()
    if f"encoder {path}" not in state:
        state[f"encoder {path}"] = Encoder(path)
    return state[f"encoder {path}"]


class SequenceWriter:
    """Appends ids to one file, whatever their number, with a bounded buffer."""

    def __init__(self, uri: str, width, length: int, pad: int):
        fs, self.path = C.open_fs(uri)
        self.fs, self.width, self.length, self.pad = fs, width, length, pad
        kind = pa.uint16() if width is np.uint16 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = fs.open_output_stream(self.path + ".tmp")
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.rest, self.held, self.total = [], 0, 0

    def _put(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        step = BATCH * self.length
        if self.held >= step:
            flat = np.concatenate(self.rest)
            whole = len(flat) // step * step
            for k in range(0, whole, step):
                self._put(flat[k : k + step], step)
            self.rest, self.held = [flat[whole:]], len(flat) - whole

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.rest)
            full = np.full(-(-len(flat) // self.length) * self.length, self.pad, self.width)
            full[: len(flat)] = flat
            self._put(full, len(flat))
        self.file.close()
        self.sink.close()
        self.fs.move(self.path + ".tmp", self.path)


def write_tokens(docs: DataFrame, out: str, tokenizer: str, *, end_id: int = 2, length: int = 2048, pad_id: int = 0, parts: int | None = None) -> dict:
    """Encode docs (doc_id, text) into files below the folder URI `out`; returns the manifest.

    One shuffle, by ranges of doc_id whose bounds come from a quantile sketch of the ids; texts are
    encoded after it. Null text: as empty, so only end_id. Rows of equal doc_id are ordered by text;
    null doc_id is first. Ids of at most 16 bits take 2 bytes. Names hold the range and a random part:
    a repeated task writes another file, and only those named by the rows that reach the driver (one a
    range) are in the manifest. Other columns are ignored. An empty table gives a manifest of no files.
    """
    spark = docs.sparkSession
    C.small_batches(spark, 1024, "3m")
    parts = parts or C.parts_for(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = C.cuts_of(docs, "doc_id", 2 * parts)
    dealt = docs.withColumn("r", F.expr(C.bucket_expr("doc_id", cuts))).repartitionById(parts, F.col("r")).sortWithinPartitions("r", "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        enc, now, writer, index = encoder(tokenizer), None, None, []

        def closed() -> pa.RecordBatch:
            writer.close()
            ids, sizes = (np.concatenate(x) for x in zip(*[(np.asarray(a, object), b) for a, b in index], strict=True))
            table = pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})
            fs, path = C.open_fs(f"{out}/{name}.docs")
            with fs.open_output_stream(path) as sink, pa.ipc.new_file(sink, table.schema) as f:
                f.write_table(table)
            return pa.RecordBatch.from_pydict({"r": [now], "name": [name], "n_docs": [len(ids)], "n_tokens": [writer.total]}, schema=pa.schema([("r", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            rs = batch["r"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(rs)) + 1), len(rs)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if now != int(rs[a]):
                    if writer:
                        yield closed()
                    now, index = int(rs[a]), []
                    name = f"ids-{now:06d}-{uuid.uuid4().hex[:10]}.arrow"
                    writer = SequenceWriter(f"{out}/{name}", enc.width, length, pad_id)
                part = batch.slice(a, b - a)
                flat, sizes = enc(part["text"])
                ends = np.cumsum(sizes)
                writer.add(np.insert(flat, ends, end_id))
                index.append((part["doc_id"].to_pylist(), sizes + 1))
        if writer:
            yield closed()

    fs, path = C.open_fs(out)
    fs.create_dir(path, recursive=True)
    rows = dealt.mapInArrow(C.tidied(write, f"encoder {tokenizer}", after=False), "r int, name string, n_docs long, n_tokens long").collect()  # one row a file
    files, start = [], 0
    for r in sorted(rows, key=lambda r: r["r"]):
        files.append({"name": r["name"], "start": start, "n_docs": r["n_docs"], "n_tokens": r["n_tokens"]})
        start += r["n_tokens"]
    manifest = {"length": length, "pad_id": pad_id, "end_id": end_id, "n_tokens": start, "files": files}
    with fs.open_output_stream(f"{path}/manifest.json.tmp") as f:
        f.write(json.dumps(manifest).encode())
    fs.move(f"{path}/manifest.json.tmp", f"{path}/manifest.json")
    return manifest


def open_sequences(uri: str) -> pa.ipc.RecordBatchFileReader:
    """A file's record batches; without a copy where the store allows a memory map."""
    local = C.local_path(uri)
    if local:
        return pa.ipc.open_file(pa.memory_map(local))
    fs, path = C.open_fs(uri)
    return pa.ipc.open_file(fs.open_input_file(path))


def sequence(reader: pa.ipc.RecordBatchFileReader, k: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of a file's k-th sequence; the ids are a view of the file."""
    batch, row = reader.get_batch(k // BATCH), k % BATCH
    ids = batch.column(0).flatten().to_numpy()[row * length : (row + 1) * length]
    return ids, batch.column(1).flatten().slice(row * length, length).to_numpy(zero_copy_only=False)


def read_tokens(spark, out: str, manifest: dict | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of `out`, from the files alone.

    start counts the ids of all documents before. Files are read one a task, batch by batch.
    """
    if manifest is None:
        fs, path = C.open_fs(out)
        with fs.open_input_stream(f"{path}/manifest.json") as f:
            manifest = json.loads(f.read())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    files = [(f"{out}/{x['name']}", x["start"]) for x in manifest["files"]]
    if not files:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch["uri"].to_pylist(), batch["start"].to_pylist(), strict=True):
                fs, path = C.open_fs(uri + ".docs")
                with fs.open_input_file(path) as f:
                    index = pa.ipc.open_file(f).read_all()
                sizes = index["n_tokens"].to_numpy()
                reader, crcs, k, held, at = open_sequences(uri), np.zeros(len(sizes), np.int64), 0, np.zeros(0, np.uint32), 0
                for i, n in enumerate(sizes):
                    crc, left = 0, int(n)
                    while left:
                        if at == len(held):
                            b = reader.get_batch(k)
                            held, at, k = b.column(0).flatten().to_numpy()[b.column(1).flatten().to_numpy(zero_copy_only=False)].astype("<u4"), 0, k + 1
                        take = held[at : at + left]
                        crc, at, left = zlib.crc32(take, crc), at + len(take), left - len(take)
                    crcs[i] = crc
                starts = start + np.cumsum(sizes) - sizes
                for a in range(0, len(sizes), 10_000):
                    z = slice(a, a + 10_000)
                    yield pa.RecordBatch.from_arrays([index["doc_id"][z].combine_chunks(), pa.array(starts[z]), pa.array(sizes[z]), pa.array(crcs[z])], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(files, "uri string, start long").repartition(min(len(files), 4 * C.n_parts(spark))).mapInArrow(C.tidied(read), schema)


def token_output(docs: DataFrame, tokenizer: str, out: str | None = None, **how) -> DataFrame:
    """Write docs, then return what the files hold (see read_tokens)."""
    out = out or C.shared_dir(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, out, write_tokens(docs, out, tokenizer, **how))
