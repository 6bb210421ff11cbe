"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes 0x20 and 0x09-0x0D part words; this class is written for Java and DuckDB alike.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent on a local master (tests) one is made; on
    a cluster a folder of the driver's machine would lose rows, so it raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = getattr(spark, "_numerail_shared", None) or tempfile.mkdtemp(prefix="numerail-")
        spark._numerail_shared = path
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows of an Arrow batch to Python: texts may be long, and a batch is in memory twice.
BATCH_ROWS = 2048


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch where they are above BATCH_ROWS."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes a table in the shared folder and reads it back: this cuts the
    lineage, and a lost executor costs no recomputation beyond the write."""
    spark = df.sparkSession
    small_batches(spark)
    path = fresh_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing will read again."""
    for t in tables:
        path = getattr(t, "_stored_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def n_shuffle(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def bounded_broadcast(df: DataFrame, limit_rows: int) -> DataFrame:
    """Hints a broadcast only where the table, counted now, is under the limit;
    beyond it the join shuffles. Use it on stored tables."""
    return F.broadcast(df) if df.count() <= limit_rows else df


class WordHashes(dict):
    """64-bit hash of each word (bytes), kept up to a fixed number of words."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


#: The worker's word hashes, for all operators that hash words.
WORDS = WordHashes()
_held: dict = {}


def hold(name: str, drop) -> None:
    """Called where a task starts that keeps a cache in the worker: what other
    operators kept there is dropped and its memory given back, so a worker
    holds one such cache."""
    others = [n for n in _held if n != name]
    for other in others:
        _held.pop(other)()
    _held[name] = drop
    if others:
        give_back()


def give_back() -> None:
    """Collects what is unreachable and returns freed memory."""
    gc.collect()
    trim()


def trim() -> None:
    """Returns freed memory of this process to the system; for the end of each group of texts."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library; then it stays for later use


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Far more rounds than any graph that fits a cluster needs.
ROUNDS = 100
#: Up to so many nodes, counted at run time, their smallest neighbours are broadcast.
BROADCAST_NODES = 1_000_000


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a, b), both bigint: rows (node, label) with
    the smallest node of each component as label.

    Alternates star contractions: in a large star, neighbours above a node go
    to its smallest neighbour; in a small star, those below do. Each needs one
    minimum per node, which is combined before the shuffle, and one join, in
    which a node with very many neighbours is no burden while the minima are
    few enough to broadcast. No node's neighbours are gathered in a row. The
    rounds are logarithmic in the number of nodes; each is written to the
    shared folder. It raises if edges are still chained after ROUNDS of them.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-edges")
    for _ in range(ROUNDS):
        # every edge goes from a node to a smaller one; in the end each node has one edge, to a node without any
        low = stored(now.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low")
        nodes = low.count()
        parents = (F.broadcast(low) if nodes <= BROADCAST_NODES else low).select(F.col("u").alias("v"), "m")
        if nodes == now.count() and not now.join(parents, "v").limit(1).count():
            drop_stored(low)
            break
        large = stored(now.join(parents, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), f"{name}-large")
        drop_stored(now, low)
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low")
        small = large.join(bounded_broadcast(low, BROADCAST_NODES), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-edges")
        drop_stored(large, low)
    else:
        raise RuntimeError(f"components of {name} are not settled after {ROUNDS} rounds")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    out._stored_path = now._stored_path
    return out
