"""What the operators of this folder share: the shared folder, written tables, range buckets, hashing."""

import os
import sys
import types
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder URI below spark.checkpoint.dir, which the driver and all executors see.

    Where that setting is missing, a folder of this machine is set if Spark runs on it alone (tests); else it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")

        root = "file://" + tempfile.mkdtemp(prefix="quillgrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def open_fs(uri: str):
    """(file system, path) of a URI, on the driver or an executor."""
    import pyarrow.fs as pafs

    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def cut(df: DataFrame, what: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends there, and any executor can read it."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512, size: str = "1m") -> None:
    """Arrow batches of few rows and few bytes, as some texts are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def parts_for(df: DataFrame, per: int = 256 << 20, most: int = 4096) -> int:
    """How many tasks to deal df's rows to: as the session says, or more where the plan's size (known from files without reading them) asks for it; at most `most`."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(n_parts(df.sparkSession), min(most, -(-size // per)) if size < 1 << 60 else 0)  # sizes beyond mean: not known


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 2_000_000) -> DataFrame:
    """A broadcast hint where df has at most `limit` (narrow) rows; beyond, Spark's shuffled join, which can split hot keys."""
    return F.broadcast(df) if rows <= limit else df


def cuts_of(df: DataFrame, col: str, n: int) -> list[int]:
    """At most n - 1 ascending upper bounds that split the non-null longs of col in about equal parts."""
    if n < 2:
        return []
    q = [i / n for i in range(1, n)]
    got = df.agg(F.percentile_approx(col, q, max(10_000, 20 * n)).alias("q")).first()["q"]
    return sorted(set(got or []))


def bucket_expr(col: str, cuts: list[int]) -> str:
    """SQL for the number of the range that col is in: a balanced tree of comparisons; null is in the first."""

    def tree(a: int, b: int) -> str:
        if a == b:
            return str(a)
        m = (a + b) // 2
        return f"IF({col} <= {cuts[m]}L, {tree(a, m)}, {tree(m + 1, b)})"

    return f"IF({col} IS NULL, 0, {tree(0, len(cuts))})"


def worker_state() -> dict:
    """A dict that lives as long as the Python worker, for caches that tasks can share."""
    return sys.modules.setdefault("_quillgrid_state", types.ModuleType("_quillgrid_state")).__dict__


def tidy(*names: str) -> None:
    """At a task's start and end: drop the caches of other operators, and give freed memory back to the system.

    Idle Python workers would otherwise keep what the largest task so far used, beside the executor's heap.
    """
    import ctypes
    import gc

    state = worker_state()
    for k in [k for k in state if not k.startswith("__") and k not in names]:
        del state[k]
    gc.collect()
    if "pyarrow" in sys.modules:
        sys.modules["pyarrow"].default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def tidied(work, *names: str, after: bool = True):
    """The function of batches `work`, between calls of tidy(*names); without the second if not `after`."""

    def run(batches):
        if after or any(not k.startswith("__") and k not in names for k in worker_state()):
            tidy(*names)
        yield from work(batches)
        if after:
            tidy(*names)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (xor-shift and multiply), in place where x is writable."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


class WordHashes(dict):
    """word -> 64-bit hash, remembered for at most `most` words."""

    most = 250_000

    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < self.most:
            self[word] = h
        return h


def word_hashes(words: list[str]) -> np.ndarray:
    memo = worker_state().setdefault("words", None)
    if memo is None:
        memo = worker_state()["words"] = WordHashes()
    return np.fromiter(map(memo.__getitem__, words), dtype=U64, count=len(words))


def shingle_hashes(h: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of the runs of n words, in order; fewer words are one run; no words, none."""
    if len(h) == 0:
        return h
    n = min(n, len(h))
    out = h[: len(h) - n + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out *= U64(0x9E3779B97F4A7C15)
            out += h[k : len(h) - n + 1 + k]
        out += U64(n)
    return mix(out)


def local_path(uri: str) -> str | None:
    """The path of a file URI if a memory map can open it."""
    return "/" + uri[5:].lstrip("/") if uri.startswith("file:") and os.path.exists("/" + uri[5:].lstrip("/")) else None
