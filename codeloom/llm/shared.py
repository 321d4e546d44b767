"""What several training-data operators share: written tables, word splitting in Arrow, components of links."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.workers import ship_code

#: A word is a run of characters other than these.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: The same as a pattern for Java and RE2.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that an Arrow function works on at once.
SLICE_BYTES = 4 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where a local session has none, a temporary folder that is then set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or None
    if folder is None:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = at.get() if at.isDefined() else None
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='codeloom-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _clear() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended; what is left is the folder's owner's to clear
            return


def own_folder(spark: SparkSession, path: str) -> None:
    """path is deleted when Python ends."""
    if not _written:
        atexit.register(_clear)
    _written.append((spark, path))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go when it has ended, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, what: str, compression: str | None = None) -> DataFrame:
    """df, written to the shared folder and read again: later stages start there, whichever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/codeloom-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    own_folder(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the written tables that df reads; for tables that no pending plan needs."""
    spark = df.sparkSession
    paths = {x.rpartition("/")[0] for x in df.inputFiles()}
    for entry in [e for e in _written if any(p.endswith(e[1].rpartition("/")[2]) for p in paths)]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(entry[1])
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(entry)


def unused_prefix(docs: DataFrame) -> str:
    """A prefix that no column of docs begins with, for columns that stand beside them for a while."""
    prefix = "_own_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def columns_of(docs: DataFrame) -> list[Column]:
    """The columns of docs as they are, whatever their names."""
    return [docs[f"`{c.replace('`', '``')}`"] for c in docs.columns]


def ready_workers(spark: SparkSession, size: int = SLICE_BYTES) -> None:
    """Workers find this package, and Arrow batches are cut by bytes too, so that long texts don't meet in one; a smaller bound stays."""
    ship_code(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    digits = (now or "").rstrip("bB")
    if not digits.isdigit() or int(digits) > size:
        spark.conf.set(name, str(size))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts in each have about size bytes at most (a longer text comes alone)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        ends = np.cumsum(lengths)
        begin = 0
        while begin < n:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
    give_back()


def give_back() -> None:
    """Returns memory that a worker has freed to the machine, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets of each text's words (one more than texts), a code for each word, and the distinct words by code.

    A null text has no words.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    if isinstance(split, pa.ChunkedArray):
        split = split.combine_chunks()
    flat, offsets = split.flatten(), np.asarray(split.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0)) if len(flat) else np.zeros(0, bool)
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    coded = pc.dictionary_encode(flat)
    return offsets, np.asarray(coded.indices).astype(np.int64), coded.dictionary


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of values between each two offsets."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(links: DataFrame, what: str = "links") -> DataFrame:
    """(id, component) of every end of links (a, b): component is the smallest id that links reach.

    Star contraction: each round links every neighbour of a node to the
    smallest one it knows, in turns from the larger and the smaller ends; the
    rounds grow with the logarithm of the longest path. Each round is written
    to the shared folder. A node's neighbours are only reduced to a minimum and
    joined by key, never gathered into one list.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), what
    )
    stamp = None
    while True:
        # Large star: every neighbour above a node points to the node's least neighbour.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: a node and those below it point to its least neighbour.
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = written(
            small.union(lower.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), what
        )
        now = tuple(following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_written(edges)
        edges = following
        if now == stamp:
            break
        stamp = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
