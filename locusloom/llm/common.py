"""Shared plumbing of the corpus operators: the shared folder, range partitions, byte-bounded batches."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
import xxhash
from pyspark import Broadcast
from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

M1, M2, M3 = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))


def mix64(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x *= M1
    x ^= x >> np.uint64(33)
    x *= M2
    x ^= x >> np.uint64(33)
    return x


#: White space of Unicode, and separators, where ``str.split`` cuts and ASCII has no space.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of the lower-cased words (white-space runs) of all texts, one after another, and how many each text has.

    A name is a polynomial of the word's bytes, mixed with its length: all words of a batch in a few array operations.
    """
    parts = []
    for t in texts:
        t = t.lower() if t else ""
        if ODD_SPACE.search(t):
            t = " ".join(t.split())
        parts.append(t.encode("utf-8", "surrogatepass"))
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    space = SPACE[data]
    before = np.append(True, space[:-1])
    start, end = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    if not start.size:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    size = end - start
    first = np.cumsum(size) - size
    powers = np.full(int(size.max()), M3)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    letters = data[~space].astype(np.uint64) + np.uint64(1)
    letters *= powers[np.arange(letters.size) - np.repeat(first, size)]
    name = mix64(np.add.reduceat(letters, first) + size.astype(np.uint64) * M1)
    cut = np.searchsorted(start, np.cumsum([0] + [len(p) + 1 for p in parts]))
    return name, np.diff(cut)


class Names(dict):
    """Word (str or bytes) -> 64-bit name. It forgets all words once they take ``most`` bytes, whatever their lengths."""

    def __init__(self, most: int = 32 << 20):
        super().__init__()
        self.most, self.taken = most, 0

    def __missing__(self, word: str | bytes) -> int:
        self.taken += len(word) + 160  # with the entry's own size and its number's
        if self.taken > self.most:
            self.clear()
            self.taken = len(word) + 160
        self[word] = out = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass") if isinstance(word, str) else word)
        return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session, whose driver and executors are one process, gets a folder of its own. On a
    cluster no folder of ours could be known to be shared, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="locusloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_SHIPPED: list[Broadcast] = []


def shipped(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast ``value`` with its class by value, so that executors need not have this package; see :func:`received`."""
    out = spark.sparkContext.broadcast(CloudPickleSerializer().dumps(value))
    _SHIPPED.append(out)
    return out


def received(shared: Broadcast) -> object:
    """What :func:`shipped` sent; call it once for each task."""
    return CloudPickleSerializer().loads(shared.value)


def recall_shipped() -> None:
    """Destroy what was shipped so far: for use once all results that need it are written."""
    while _SHIPPED:
        _SHIPPED.pop().destroy()


def work_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and lost executors don't matter."""
    spark = df.sparkSession
    path = work_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table made by :func:`materialise` that nothing reads any more, and let Spark drop shuffles that nothing reads."""
    path = getattr(df, "_work_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        release(df.sparkSession)


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver has collected the plans that made them: let it do so now."""
    gc.collect()
    spark._jvm.System.gc()


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a local path or a URI, and the path inside it."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def row_ids(docs: DataFrame, tag: str) -> tuple[DataFrame, bool]:
    """Rows (rid, doc_id, text): rid is the doc_id where all ids are there and different (True), else a number of our own.

    Numbers of our own are fixed by writing the rows down.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    n = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    doubled = n["n"] and rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if n["n"] == n["known"] and not doubled:
        return rows.select(F.col("doc_id").alias("rid"), "doc_id", "text"), True
    return materialise(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), tag), False


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest_key(text: Column) -> Column:
    """128 bits of SHA-256 of a text, as 32 hex digits: the identity of equal texts (null counts as empty)."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32)


def runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut a list of sizes into runs [a, b) of about ``limit``; one item may be larger."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with about ``limit`` bytes in ``column``; one row may be larger."""
    for batch in batches:
        for a, b in runs(pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist(), limit):
            yield batch.slice(a, b - a)


def by_run(texts: pd.Series, limit: int = 1 << 20) -> Iterator[list[str | None]]:
    """The texts in runs of about ``limit`` characters."""
    for a, b in runs([len(t) if t else 0 for t in texts], limit):
        yield texts.iloc[a:b].tolist()


def range_parts(df: DataFrame, key: str, n: int, out: str) -> DataFrame:
    """Add ``out``: 0 <= part < n, ascending with ``key`` (a long; null goes first).

    The cuts come from a percentile sketch of the key column alone, so the wide rows are read once.
    """
    cuts = []
    if n > 1:
        got = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10000).alias("c")).first()[0]
        cuts = sorted(set(got or []))
    if not cuts:
        return df.withColumn(out, F.lit(0))
    if len(cuts) > 512:  # too many for one expression
        bounds = np.array(cuts)

        @F.pandas_udf("int")
        def part(keys: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(bounds, keys.fillna(bounds[0]).to_numpy(), side="left").astype("int32"))

        return df.withColumn(out, part(F.col(key)))

    def split(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) <= F.lit(cuts[mid]), split(lo, mid)).otherwise(split(mid + 1, hi))

    return df.withColumn(out, F.when(F.col(key).isNull(), 0).otherwise(split(0, len(cuts))))


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
