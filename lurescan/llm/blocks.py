"""Blocks of documents, and exchanges of packed keys between them.

Several operators look at every word, n-gram or passage of the corpus more than once and need one fact about
each key from the whole corpus. Shuffling a row per occurrence would move many times the input. Instead:

1. ``pack`` cuts the table into blocks of about ``block_bytes`` of text, one compressed row each, and writes
   them to the shared folder. A row is known from then on by its block and place, so repeated or missing ids
   are harmless, and a lost executor costs a re-read.
2. A block sends each of its distinct keys once, packed, to the bucket that the key's hash names. However
   often a key occurs, a bucket sees it at most once per block, so no key makes a hot task.
3. The bucket answers in the order of the question, and the block is met by its answers in a cogroup.

Blocks bound the memory of a task: a block holds ``block_bytes`` of text, or one longer document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import scratch_path

BLOCK_BYTES = 12 << 20


def to_body(batch: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write(batch)
    return sink.getvalue().to_pybytes()


def from_body(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all().combine_chunks()


def _cut(batches: Iterator[pa.RecordBatch], text: str, block_bytes: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), "int64") + 16
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + block_bytes - size, side="right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1] - before)
            if size >= block_bytes or stop < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            start = stop
    if held:
        yield pa.Table.from_batches(held)


def pack(docs: DataFrame, columns: list[str], text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``block bigint, n bigint, body binary``: the given columns of every row, written once.

    The table is bucketed by block, so a cogroup by block reads it in place and shuffles the other side only.
    """
    narrow = docs.select(*[F.col(f"`{c}`") for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for i, table in enumerate(_cut(batches, text, block_bytes)):
            table = table.combine_chunks()
            yield pa.RecordBatch.from_pydict({"block": [base + i], "n": [table.num_rows], "body": [to_body(table)]})

    spark = docs.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    made = narrow.mapInArrow(run, "block bigint, n bigint, body binary")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.write.bucketBy(buckets, "block").option("path", scratch_path(spark, "blocks")).saveAsTable(name)
    return spark.table(name)


def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(block, its rows) for a task that maps over packed blocks."""
    for batch in batches:
        for block, body in zip(batch.column("block").to_pylist(), batch.column("body"), strict=True):
            yield block, from_body(body.as_buffer())


def text_bytes(table: pa.Table, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and where each begins (one more entry: the end). Null counts as empty."""
    array = pc.fill_null(table.column(column), "").cast(pa.large_binary()).combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = array.chunk(0) if array.num_chunks else pa.array([], pa.large_binary())
    if not len(array):
        return np.zeros(0, "uint8"), np.zeros(1, "int64")
    offsets = np.frombuffer(array.buffers()[1], "int64")[array.offset : array.offset + len(array) + 1]
    if not array.buffers()[2]:
        return np.zeros(0, "uint8"), offsets - offsets[0]
    data = np.frombuffer(array.buffers()[2], "uint8")[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def planes(array: np.ndarray) -> bytes:
    """Numbers with equal-weight bytes together, so that zstd sees the empty high bytes as runs."""
    raw = np.ascontiguousarray(array)
    return zstandard.compress(np.ascontiguousarray(raw.view("uint8").reshape(len(raw), raw.itemsize).T).tobytes(), 1)


def unplanes(data: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), "uint8")
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).view(dtype).reshape(-1)


def sorted_planes(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unsorted_planes(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, "uint64"), dtype="uint64")


def bucket_edges(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending keys; a bucket is a range of the key space."""
    edges = np.searchsorted(keys, (np.arange(1, buckets, dtype="object") * (2**64 // buckets)).astype("uint64"))
    edges = np.concatenate([[0], edges, [len(keys)]]).astype("int64")
    return [(b, int(edges[b]), int(edges[b + 1])) for b in range(buckets) if edges[b + 1] > edges[b]]
