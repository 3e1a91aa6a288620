"""Shared plumbing: table loading, bounded samples, partitions by size, Arrow text buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinweave.sources.shared import discard, materialise, sweep, written  # noqa: F401  used by the operators from here

#: Text bytes that a vectorised kernel handles at once; a longer single text is one block.
BLOCK_BYTES = 1 << 20
ARROW_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what one of them held goes back to the system before the next."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow in batches of at most ARROW_ROWS rows: two copies of a batch of texts must fit a small worker."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df.mapInArrow(lambda batches: fn(trimmed(batches)), schema)


def fit_rows(rows: DataFrame, label: str, wanted: dict, sizes: dict, total_bytes: int) -> list[tuple[bytes, object]]:
    """Sorted (text, label) pairs to fit on, the same ones whatever the partitions: bounded by rows and bytes of each label.

    rows has doc_id, text and the label.  sizes: how many rows a label has; wanted: how many of them to take, about.  Rows
    are drawn by a hash of id and text; equal texts of a label count once.  A label gets an equal share of total_bytes;
    texts of more than a quarter of that are left out, and so is what its share can't hold, in hash order.  Whole
    texts are taken or none of them.
    """
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col(label) == value, min(1.0, wanted[value] / max(n, 1))).otherwise(share)
    room = total_bytes // max(len(sizes), 1)
    draw = F.pmod(F.xxhash64(F.lit("fit"), "doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    drawn = rows.where((F.octet_length("text") <= room // 4) & (draw < share)).select("text", label).distinct()
    order = Window.partitionBy(label).orderBy(F.xxhash64("text"), "text")
    upto = F.sum(F.octet_length("text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # The draw leaves about `wanted` rows of a label; the window cuts what chance leaves beyond.
    most = F.lit(0)
    for value in sizes:
        most = F.when(F.col(label) == value, wanted[value] + wanted[value] // 4 + 16).otherwise(most)
    kept = drawn.withColumns({"upto": upto, "rn": F.row_number().over(order)}).where((F.col("upto") <= room) & (F.col("rn") <= most))
    return sorted((r["text"].encode(), r[label]) for r in kept.select("text", label).toLocalIterator())


#: Bytes that a shuffled partition should have.
PART_BYTES = 16 << 20


def spread(df: DataFrame, size: int, *columns: str) -> DataFrame:
    """df by columns, in partitions of about PART_BYTES, size being its bytes, and at least one for each core.

    What is smaller than two such partitions gets the session's number, which is merged to fewer at run time.
    """
    parts = size // PART_BYTES
    if parts < 2:
        return df.repartition(*columns)
    return df.repartition(max(int(parts), df.sparkSession.sparkContext.defaultParallelism), *columns)


def crc_mod(doc_id: Column, k: int) -> Column:
    """crc32 of the id written as text, modulo k."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the text; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) holding at most `limit` bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
