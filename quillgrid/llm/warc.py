"""Operator 5: WARC archives, written by deterministic shards and read back.

Records are sorted by page_id: ranges of it, whose bounds come from a quantile sketch, are shards. A
shard's records go to files that roll at a compressed size; each record is a gzip member of its own.
Headers, digests and record ids are made anew from the row, with a fixed date, so reruns give the same
bytes. Of equal payloads the record of the largest page_id holds the payload (response); the others are
revisits without it. Files get random temporary names first, final names say shard and number;
MANIFEST.json, written last and renamed, lists the files with their sizes and digests.
"""

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6f1f5a0e-5b1c-5d52-9f43-0b6f3a3f2a11")


def b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int | None] | None) -> bytes:
    """A record's bytes; refers_to: (page_id of the response,) for a revisit."""
    digest = b32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if refers_to else payload)
    uri = "".join(c if c.isprintable() and c not in ' <>"' else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    head = {
        "WARC-Type": "revisit" if refers_to else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": uri or None,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{b32(block)}",
        "WARC-Profile": PROFILE if refers_to else None,
        "WARC-Refers-To": record_id(refers_to[0], digest) if refers_to else None,
        "X-Refers-To-Page": str(refers_to[0]) if refers_to and refers_to[0] is not None else None,
        "X-Page": str(page_id) if page_id is not None else None,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    """A gzip member without name or time."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Roller:
    """Writes members to numbered files of a shard; a file that reaches `roll` bytes is the last but for the next."""

    def __init__(self, out: str, shard: int, roll: int):
        self.fs, self.path = C.open_fs(out)
        self.shard, self.roll, self.number, self.sink, self.done = shard, roll, 0, None, []

    def add(self, member: bytes) -> None:
        if self.sink is None:
            self.tmp = f"{self.path}/.tmp-{self.shard:06d}-{self.number:05d}-{uuid.uuid4().hex}"
            self.sink, self.size, self.records, self.sha = self.fs.open_output_stream(self.tmp), 0, 0, hashlib.sha1()
        self.sink.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.fs.move(self.tmp, f"{self.path}/{name}")
            self.done.append((self.shard, self.number, name, self.records, self.size, self.sha.hexdigest()))
            self.sink, self.number = None, self.number + 1


def write_warc(pages: DataFrame, out: str, *, min_dedupe_bytes: int = 0, roll_bytes: int = 1 << 28, parts: int | None = None) -> dict:
    """Write pages (page_id, url, html) below the folder URI `out`; returns the manifest.

    Null html: an empty payload. Payloads of min_dedupe_bytes or more are stored once. Equal page_ids with
    equal payloads at the top are all responses; null page_id comes first and is the smallest. Null url: no
    target header. Payloads are shuffled once; which records are revisits is found on (page_id, digest)
    alone, where Spark can split a payload that many pages have. Other columns are ignored.
    """
    spark = pages.sparkSession
    C.small_batches(spark)
    parts = parts or C.parts_for(pages)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    slim = pages.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("size")).where(F.col("size") >= min_dedupe_bytes).select("page_id", "digest")
    top = slim.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("digest", "top")
    revisits = slim.join(top, "digest").where("NOT page_id <=> top").select("page_id", "digest", "top")
    void = lambda kind: F.lit(None).cast(kind)
    rows = revisits.select("page_id", F.lit(0).alias("kind"), void("string").alias("url"), void("string").alias("html"), "digest", "top").union(
        pages.select("page_id", F.lit(1).alias("kind"), "url", "html", void("string").alias("digest"), void("long").alias("top"))
    )
    bucket = F.expr(C.bucket_expr("page_id", C.cuts_of(pages, "page_id", 2 * parts)))
    dealt = rows.withColumn("r", bucket).repartitionById(parts, F.col("r")).sortWithinPartitions("r", "page_id", "kind", "url", "html")
    schema = pa.schema([("shard", pa.int32()), ("number", pa.int32()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, page, refers = None, object(), {}

        def closed() -> pa.RecordBatch:
            roller.close()
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in roller.done], schema=schema)

        for batch in batches:
            for r, page_id, kind, url, html, digest, top in zip(*(batch[c].to_pylist() for c in ("r", "page_id", "kind", "url", "html", "digest", "top")), strict=True):
                if roller is None or roller.shard != r:
                    if roller is not None:
                        yield closed()
                    roller, page = Roller(out, r, roll_bytes), object()
                if page != page_id:
                    page, refers = page_id, {}
                if kind == 0:
                    refers[digest] = (top,)
                else:
                    payload = html.encode("utf-8", "surrogatepass")
                    roller.add(gzipped(record(page_id, url, payload, refers.get(hashlib.sha1(payload).hexdigest()) if refers else None)))
        if roller is not None:
            yield closed()

    fs, path = C.open_fs(out)
    fs.create_dir(path, recursive=True)
    files = [r.asDict() for r in dealt.mapInArrow(C.tidied(write), "shard int, number int, name string, records long, bytes long, sha1 string").collect()]  # one row a file
    manifest = {"files": sorted(files, key=lambda f: f["name"]), "records": sum(f["records"] for f in files)}
    with fs.open_output_stream(f"{path}/.MANIFEST.tmp") as f:
        f.write(json.dumps(manifest).encode())
    fs.move(f"{path}/.MANIFEST.tmp", f"{path}/MANIFEST.json")
    return manifest


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The unpacked gzip members of a stream."""
    z, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(size)
        if not data:
            if parts:
                raise ValueError("a record ends early")
            return
        parts.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record; both digests are checked, the payload's where the record has it."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0][:20]}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{b32(block)}":
        raise ValueError(f"wrong block digest in {fields['WARC-Record-ID']}")
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{b32(block.partition(b'\r\n\r\n')[2])}":
        raise ValueError(f"wrong payload digest in {fields['WARC-Record-ID']}")
    return fields, block


def read_warc(spark, out: str, manifest: dict | None = None) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and file of every record in the archives, from their bytes alone."""
    if manifest is None:
        fs, path = C.open_fs(out)
        with fs.open_input_stream(f"{path}/MANIFEST.json") as f:
            manifest = json.loads(f.read())
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"
    files = [(f"{out}/{f['name']}", f["name"]) for f in manifest["files"]]
    if not files:
        return spark.createDataFrame([], schema)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for uri, name in zip(batch["uri"].to_pylist(), batch["name"].to_pylist(), strict=True):
                fs, path = C.open_fs(uri)
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for data in members(stream):
                        f, block = parse(data)
                        http = block.partition(b"\r\n\r\n")[0].decode()
                        size = next(int(x[16:]) for x in http.split("\r\n") if x.startswith("Content-Length: "))
                        rows.append((number(f.get("X-Page")), f.get("WARC-Target-URI"), size, f["WARC-Payload-Digest"][5:], f["WARC-Type"], number(f.get("X-Refers-To-Page")), name))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.createDataFrame(files, "uri string, name string").repartition(min(len(files), 4 * C.n_parts(spark))).mapInArrow(C.tidied(read), schema)


def warc_round_trip(pages: DataFrame, out: str | None = None, **how) -> DataFrame:
    """Write pages, then return what the archives hold."""
    out = out or C.shared_dir(pages.sparkSession, "warc")
    return read_warc(pages.sparkSession, out, write_warc(pages, out, **how))
