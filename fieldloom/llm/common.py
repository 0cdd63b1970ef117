"""Shared pieces: scratch tables in the cluster's shared folder, and numpy views of text columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one vectorised step works on; a longer single text makes a step of its own.
STEP_BYTES = 3 << 20

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir; a new one of our own where that is unset and all runs in one process."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not (spark.sparkContext.master or "").split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share: operators store tables there")
        known = "file://" + tempfile.mkdtemp(prefix="fieldloom-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    if not _scratch:
        atexit.register(_sweep)
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    for spark, path in _scratch:
        try:
            _delete(spark, path)
        except Exception:  # the context is gone already: the folder belongs to the cluster
            break


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``stored`` that nothing will read again."""
    for table in tables:
        _delete(table.sparkSession, table.scratch)
        _scratch.remove((table.sparkSession, table.scratch))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded rows and bytes, so that long texts cannot fill a Python worker.

    Frames are lazy, so this setting stays with the session; values that are lower already stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 4096), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = int("".join(c for c in spark.conf.get(key) if c in "-0123456789") or 0)
        if not 0 < now <= most or not spark.conf.get(key).isdigit():
            spark.conf.set(key, str(most))


def held_out(doc_id, parts: int, part: int):
    """Whether crc32 of the id's text, modulo parts, is part; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most so many bytes, or one row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


#: Bytes that end a word: 09 to 0D and 20.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = np.ones(1, U64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        base = np.full(max(n, 256), U64(0x100000001B3 | 1))
        base[0] = 1
        _powers = np.multiply.accumulate(base)
    return _powers


def words_of(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words in data, and n + 1 word offsets of the rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~blank[data]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    lengths = np.flatnonzero(word & ~after) + 1 - starts
    return starts, lengths, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each word's bytes; about ``most`` bytes, or one word, are in work at a time."""
    out = np.empty(len(starts), U64)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    for lo, hi in steps(ends, most):
        first, size = ends[lo:hi] - ends[lo], lengths[lo:hi]
        inside = np.arange(ends[hi] - ends[lo]) - np.repeat(first, size)
        values = data[inside + np.repeat(starts[lo:hi], size)].astype(U64)
        values += U64(1)
        values *= _power_table(int(size.max()) + 1)[inside]
        out[lo:hi] = mix(np.add.reduceat(values, first) + size.astype(U64) * U64(0xD6E8FEB86659FD93))
    return out


def spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the runs of the given lengths."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U64, copy=False).view(np.int64))


def fixed_rows(matrix: np.ndarray) -> pa.Array:
    """Each row of a matrix as a binary value."""
    flat = np.ascontiguousarray(matrix)
    width = flat.shape[1] * flat.itemsize
    ends = np.arange(len(flat) + 1, dtype=np.int32) * np.int32(width)
    return pa.BinaryArray.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(ends), pa.py_buffer(flat.tobytes())])


def matrix_of(column: pa.Array, dtype, width: int) -> np.ndarray:
    """Binary values of one width as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), dtype)
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(dtype).reshape(len(column), width)


def grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of equal keys, from batches in which equal keys are adjacent."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        last = np.ones(table.num_rows, bool)
        for k in key:
            column = table.column(k).to_numpy()
            last &= column == column[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def group_bounds(table: pa.Table, key: list[str]) -> np.ndarray:
    """Where groups of equal keys begin, and the end."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in key:
        column = table.column(k).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)
