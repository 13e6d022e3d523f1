"""Helpers shared by the operators: tables, stored intermediates, packed columns, vectorised text hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir

#: Bytes of text that one vectorised step works on. A longer text is a step of its own.
STEP_BYTES = 2 << 20

U = np.uint64
_MULT = U(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder of this run below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table to the shared checkpoint folder and reads it back: later steps start from these files,
    so a lost executor costs its running tasks only."""
    path = shared_folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a query inside shuffles goes as soon as it has ended, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def in_parts(df: DataFrame, tag: str, table: DataFrame | None = None) -> DataFrame:
    """`stored` with a folder for each value of the column part, or added to such a table."""
    spark = df.sparkSession
    path = table.stored_at if table is not None else shared_folder(spark, tag)
    with _shuffles_removed(spark):
        df.write.mode("append").option("compression", "zstd").partitionBy("part").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(table: DataFrame, part: int | None = None) -> None:
    """Removes a table of `in_parts` or `in_buckets`, or a part of it, that no later step reads."""
    spark = table.sparkSession
    if getattr(table, "catalog_name", None):
        spark.sql(f"DROP TABLE IF EXISTS {table.catalog_name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at if part is None else f"{table.stored_at}/part={part}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_buckets(df: DataFrame, tag: str, n: int, column: str, table: DataFrame | None = None) -> DataFrame:
    """A stored table in n buckets by a column, or added to such a table: groups by that column read it without a shuffle. The session's catalog knows
    the buckets until `discard`."""
    spark = df.sparkSession
    name, path = (table.catalog_name, table.stored_at) if table is not None else (f"{tag}_{uuid.uuid4().hex}", shared_folder(spark, tag))
    with _shuffles_removed(spark):
        df.write.mode("append").option("compression", "zstd").option("path", path).bucketBy(n, column).saveAsTable(name)
    out = spark.table(name)
    out.catalog_name, out.stored_at, out.buckets = name, path, n
    return out


def text_of(column: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(*columns: Column) -> Column:
    """A 64-bit key of whole values: the first 8 bytes of their SHA-256. Among n different texts about
    n * n / 2**65 pairs share a key."""
    whole = columns[0] if len(columns) == 1 else F.concat_ws("\x1f", *columns)
    # conv gives an unsigned number; the upper half wraps to negative longs
    number = F.conv(F.substring(F.sha2(whole, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    half, full = F.lit("9223372036854775808").cast("decimal(20,0)"), F.lit("18446744073709551616").cast("decimal(20,0)")
    return F.when(number >= half, number - full).otherwise(number).cast("long")


def text_digest(whole: Column) -> Column:
    """A 128-bit key of whole values: the first 16 bytes of their SHA-256, for steps that drop what has the same key."""
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


# ---- packed columns -------------------------------------------------------------------------------------

def slices(batches: Iterator[pa.RecordBatch], column: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds at most about `step` bytes of `column`, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(byte_lengths(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + step, "right")))
            yield batch.slice(at, to - at)
            at = to


def _binary(array: pa.Array) -> pa.Array:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return array.cast(pa.large_binary()).fill_null(b"")


def byte_lengths(array: pa.Array) -> np.ndarray:
    return np.diff(offsets_and_bytes(array)[0])


def offsets_and_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets (one more than rows) and the bytes of a string or binary column; nulls are empty."""
    array = _binary(array)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset:array.offset + len(array) + 1]
    if data is None:
        return np.zeros(len(array) + 1, np.int64), np.zeros(0, np.uint8)
    return offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]


def pack(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary cell per row from a flat array and row offsets."""
    data = np.ascontiguousarray(values)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer((np.asarray(offsets, np.int64) * data.itemsize).tobytes()), pa.py_buffer(data.tobytes())]
    ).cast(pa.binary())


def unpack(array: pa.Array, dtype) -> np.ndarray:
    """All cells of a packed column, one after the other."""
    return np.frombuffer(offsets_and_bytes(array)[1].tobytes(), dtype)


def by_shard(shard: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorts entries by shard (stable): the shards present, their offsets, the sorted value arrays."""
    order = np.argsort(shard, kind="stable")
    got, starts = np.unique(shard[order], return_index=True)
    return got, np.append(starts, len(shard)), [v[order] for v in values]


# ---- hashing --------------------------------------------------------------------------------------------

def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * _MIX1
    h ^= h >> U(33)
    h *= _MIX2
    h ^= h >> U(33)
    return h


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ordered combination of two hashes."""
    return mix(left * _MULT + (right ^ (right >> U(29))) + U(0x632BE59BD9B4E019))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span, from prefix sums of weighted bytes."""
    powers = np.full(len(data) + 1, _MULT, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers[:-1], out=sums[1:])
    inverse = U(pow(int(_MULT), -1, 1 << 64))
    down = np.full(len(data) + 1, inverse, np.uint64)
    down[0] = 1
    np.cumprod(down, out=down)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_of(text: str) -> str:
    """Lower-cased words with one blank between them."""
    return " ".join(text.lower().split())


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of several texts, and the row offsets into them."""
    lines = [words_of(t) for t in texts]
    counts = np.array([t.count(" ") + 1 if t else 0 for t in lines], np.int64)
    data = np.frombuffer(" ".join(t for t in lines if t).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    if not len(data):
        return np.zeros(0, np.uint64), offsets
    blanks = np.flatnonzero(data == 32)
    starts, ends = np.concatenate(([0], blanks + 1)), np.append(blanks, len(data))
    return span_hashes(data, starts, ends), offsets
