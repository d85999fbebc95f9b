"""Shared plumbing: table access, durable intermediate tables and block joins."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import os
import re
import sys
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Rows and bytes of one Arrow batch: texts may be long, so batches stay small.
ARROW_ROWS, ARROW_BYTES = 512, 32 << 20
#: Ids sent to every executor at most, to pick rows without moving all of them.
PICKED = 1_000_000
#: Allocations from this size on go back to the system as soon as they are freed
#: (glibc's M_MMAP_THRESHOLD, whose number is -3).
BIG, _MMAP_THRESHOLD = 4 << 20, -3
#: What ``hold`` leaves free at the heap's end (glibc's M_TRIM_THRESHOLD).
HELD, _TRIM_THRESHOLD = 32 << 20, -1

_LIBC = None
if sys.platform == "linux":
    _LIBC = ctypes.CDLL(None)
    if hasattr(_LIBC, "mallopt"):
        _LIBC.mallopt(_MMAP_THRESHOLD, BIG)
    pa.set_memory_pool(pa.system_memory_pool())


def trim() -> None:
    """Give freed memory back: Spark keeps Python workers for later tasks, and
    what one keeps is missing for the others of its executor."""
    if _LIBC is not None and hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def hold() -> None:
    """Keep some freed memory until ``trim``, for work that takes and frees arrays
    of a few MB all the time: each would be fresh pages otherwise."""
    if _LIBC is not None and hasattr(_LIBC, "mallopt"):
        _LIBC.mallopt(_TRIM_THRESHOLD, HELD)


def lean(run):
    """A function for mapInArrow or applyInArrow that ends with ``trim``."""

    def through(batches):
        yield from run(batches)
        trim()

    @functools.wraps(run)
    def whole(arg):
        if not isinstance(arg, pa.Table):
            return through(arg)
        out = run(arg)
        trim()
        return out

    return whole


def tune(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small enough that a few huge texts fit in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). A temporary one is
    made only on a local master, where driver and executors are one process."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[[^,]*\])?$", sc.master or ""):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tidemill-")
        sc.setCheckpointDir(where)
    return where


_WRITTEN: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    """Intermediate tables go when the application ends: until then a returned
    DataFrame may read them."""
    for spark, path in _WRITTEN:
        with contextlib.suppress(Exception):  # the session may have ended before
            _remove(spark, path)


@contextlib.contextmanager
def recorded():
    """The tables that ``stored`` writes meanwhile, as a list that ``remove`` takes."""
    n, out = len(_WRITTEN), []
    yield out
    out += _WRITTEN[n:]


def remove(tables: list[tuple[SparkSession, str]]) -> None:
    """Delete stored tables that nothing will read again."""
    for t in tables:
        if t in _WRITTEN:
            _remove(*t)
            _WRITTEN.remove(t)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    task-dependent columns (partition numbers) are fixed by the committed task.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_remove_all)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def stored_alone(df: DataFrame, name: str) -> DataFrame:
    """``stored``, and the shuffle files of the write go at once: ``df`` must be
    of no further use."""
    sc = df.sparkSession.sparkContext._jsc.sc()
    first = sc.newShuffleId()
    out = stored(df, name)
    cleaner = sc.cleaner()
    for shuffle in range(first + 1, sc.newShuffleId()):
        if cleaner.isDefined():
            cleaner.get().doCleanupShuffle(shuffle, True)
    return out


def crc_fold(doc_id) -> F.Column:
    """crc32(doc_id as text) mod 4; the fold 2 is held out. A null id is text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def partition_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def crc_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def strings(texts: pa.Array) -> list[str | None]:
    """``to_pylist`` of texts without a scalar each on the way."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Split texts at ASCII white space: offsets of each text into the chunk
    codes, the codes, and the distinct chunks the codes point to."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary.to_pylist()


def named(words: list[str], make, seen: dict, most: int = 100_000) -> list:
    """``make`` of each word; up to ``most`` words are remembered in ``seen``."""
    out = []
    for w in words:
        x = seen.get(w)
        if x is None:
            x = make(w)
            if len(seen) < most:
                seen[w] = x
        out.append(x)
    return out


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start..start+len-1 of every run, one after another."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


def planes(x: np.ndarray) -> bytes:
    """Bytes of integers, all lowest bytes first: the high ones compress to little."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T).view(dtype).ravel()


def picked(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of some ids. Up to PICKED ids are sent to the rows, which then
    stay where they are; more meet them in an ordinary join."""
    ids = ids.distinct()
    few = ids.limit(PICKED + 1).count() <= PICKED
    return rows.join(F.broadcast(ids) if few else ids, name, "left_semi")


def valid_vectors(df: DataFrame, id_col: str, vec_col: str, allow_zero: bool) -> DataFrame:
    """Rows whose vector is non-null, non-empty, and finite in every component
    (and not all zero unless allowed), as columns ``vec_id`` and ``vec`` (doubles)."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    out = out.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)).where(~bad)
    return out if allow_zero else out.where(F.exists("vec", lambda x: x != 0))


def asked_vectors(df: DataFrame) -> DataFrame:
    """Query rows with a key of their vector: rows equal in id and vector are one
    query, an id on unlike vectors is a query for each."""
    return df.withColumn("vec_key", F.xxhash64("vec")).dropDuplicates(["vec_id", "vec_key"])


def lanes(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


#: Queries of a tile, and how many a task keeps lists for before it gives them out.
TILE, KEPT = 4096, 8192


def meet(rows: DataFrame, queries: DataFrame, n_queries: int, n: int) -> DataFrame:
    """Bring each packed block of rows together with each packed query block.

    Query blocks are dealt to tiles of about ``TILE`` queries, row blocks in turn
    to lanes; a cell is a lane and a tile, and every block is copied to the cells
    of its lane or tile. A task so holds the lists of few tiles however many
    queries there are, and no cell grows with a key: an equi-join on the cell,
    where rows never pair one by one in Spark.
    """
    tiles = max(1, -(-n_queries // TILE))
    wide = max(1, n // tiles)
    left = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    left = left.withColumn("cell", F.col("tile") * wide + F.pmod(F.col("r_no"), F.lit(wide))).drop("tile", "r_no")
    right = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("lane"))
    right = right.withColumn("cell", F.pmod(F.col("q_no"), F.lit(tiles)) * wide + F.col("lane")).drop("lane", "q_no")
    return left.repartition(tiles * wide, "cell").join(right.hint("shuffle_hash"), "cell")


def block_number(part: int, seq: int) -> int:
    """Numbers that go through the lanes in turn: blocks of a partition one after
    the other, partitions from different beginnings."""
    return part + seq


def top_smallest(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest scores, ties to the smaller id, in order."""
    if len(score) > k:
        near = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], score[near]))][:k]
