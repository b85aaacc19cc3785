"""What the operators of this package share: tables, stored steps, word hashes, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
CACHED_WORDS = 150_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, n: int) -> Column:
    """crc32 of a number's text, mod n: the folds that the queries are defined on."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where it is unset, a session on one machine
    gets a temporary one, as in tests; on a cluster that is an error, as executors would write to folders of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="pagemill-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before the interpreter does
        return


_steps: list[tuple[SparkSession, str]] = []


def release() -> None:
    """Delete all stored steps. A long session calls it when it has written out the results that read them; else they go
    when the interpreter ends."""
    while _steps:
        _remove(*_steps.pop())


atexit.register(release)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a step to the shared folder and read it back, so that a lost executor costs no recomputation of
    what lies before. See release() for the end of the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagemill-{label}-{uuid.uuid4().hex}"
    _steps.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, limit: str = "8m") -> Iterator[None]:
    """For steps that are stored within it: tables of long texts or sets go to Python in batches of about this size. A
    batch is held in several copies on both sides, for each core of an executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, limit)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Record batches cut so that each holds about `limit` bytes of text (always one row at least), each with its
    texts as bytes; a null text is None. Only one slice's texts are Python objects at a time."""
    for batch in batches:
        raw = batch.column(text).cast(pa.binary())
        upto = np.cumsum(pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(raw):
            before = upto[start - 1] if start else 0
            stop = min(len(raw), int(np.searchsorted(upto, before + limit)) + 1)
            yield batch.slice(start, stop - start), raw.slice(start, stop - start).to_pylist()
            start = stop


class WordHash(dict):
    """64-bit hashes of words, as signed integers, remembered for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    out = words[: n - width + 1] + np.uint64(width)
    for j in range(1, width):
        out = out * np.uint64(0xA0761D6478BD642F) + words[j : n - width + 1 + j]
    return mixed(out)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that can be reached.

    Star contraction: in each round every node's larger neighbours, then its smaller ones, are hung on the
    smallest neighbour. Every step is a grouping or a join, and each round is checkpointed. The number of rounds rises
    with the logarithm of the longest chain; a run that isn't done after `rounds` raises an error."""
    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    shared_dir(edges.sparkSession)
    cur = cur.checkpoint()
    for _ in range(rounds):
        # done when every node hangs on one other, on which nothing but nodes hang
        ends = cur.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(cur.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]:
            break
        # every edge in both directions; larger neighbours go to the smallest of the neighbourhood
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # each node's smaller neighbours, and the node, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        cur = small.checkpoint()
    else:
        raise RuntimeError(f"components: not done after {rounds} rounds")
    tops = cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(tops)
