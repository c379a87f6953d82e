"""Stupid-backoff scores of documents against n-gram counts of the whole corpus (operator 6).

S(w | history) = count(history w) / count(history) where the n-gram was seen at least ``min_count`` times,
else ``alpha`` times the score with the history's first word dropped; a word alone scores count(w) / N.
The counts cover every word of every document. A document's score is the sum of ln S over its words.

Each block of documents sends its distinct n-grams with their counts to the hash range (bucket) that holds
that part of the count table; the bucket adds up and answers; the block joins the answers to its exploded
n-grams and sums per document. An n-gram reaches a bucket at most once per block, so frequent words are not
hot. N-grams are 64-bit names (see ``words``).

Null or wordless texts have 0 words, score 0.0 and a null mean. Repeated rows count as often as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stable
from .blocks import BLOCK_BYTES, bucket_edges, from_body, pack, planes, sorted_planes, tables, text_bytes, unplanes, unsorted_planes
from .bpe import from_spark
from .words import gram_names, word_names

#: n-grams a bucket counts in one task, about
BUCKET_GRAMS = 3_000_000


def grams_of(table: pa.Table, text: str, order: int):
    """Words' documents, and for each n the names and places of the n-grams."""
    data, starts = text_bytes(table, text)
    name, doc, _, _ = word_names(data, starts)
    return doc, [gram_names(name, doc, n) for n in range(1, order + 1)]


def count_tables(blocks: DataFrame, order: int, text: str = "text") -> DataFrame:
    """``bucket, block, counts, words``: for each question of a block the corpus counts, in its order.

    ``words`` is the bucket's number of running words; a bucket is a range of one order's names.
    """
    # about 200,000 n-grams of each order in a megabyte of text; only the number of tasks hangs on this
    buckets = max(8, blocks.count() * BLOCK_BYTES // (1 << 20) * 200_000 // BUCKET_GRAMS)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in tables(batches):
            _, grams = grams_of(table, text, order)
            for n, (names, _) in enumerate(grams, 1):
                keys, counts = np.unique(names, return_counts=True)
                rows = [(n * buckets + b, block, sorted_planes(keys[i:j]), planes(counts[i:j].astype("uint32"))) for b, i, j in bucket_edges(keys, buckets)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def answer(rows: pa.Table) -> pa.Table:
        keys = [unsorted_planes(b.as_py()) for b in rows.column("keys")]
        counts = [unplanes(b.as_py(), "uint32") for b in rows.column("counts")]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts).astype("float64"), len(every)).astype("uint64")
        ends = np.cumsum([len(k) for k in keys])
        back = [planes(total[place[e - len(k) : e]]) for k, e in zip(keys, ends, strict=True)]
        bucket = rows.column("bucket")
        words = int(total.sum()) if bucket[0].as_py() // buckets == 1 else 0
        return pa.table([bucket, rows.column("block"), pa.array(back, pa.binary()), pa.array([words] * len(back), pa.int64())], names=["bucket", "block", "counts", "words"])

    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    asked = blocks.mapInArrow(ask, "bucket bigint, block bigint, keys binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(answer, "bucket bigint, block bigint, counts binary, words bigint")


def score(docs: DataFrame, id_column: str = "doc_id", text: str = "text", order: int = 3, alpha: float = 0.4, min_count: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_backoff (words not scored at the order their place allows), score, mean_score."""
    blocks = pack(docs, [id_column, text], text, block_bytes)
    answers = stable(count_tables(blocks, order, text), "gram-counts")
    # one number per bucket of single words
    running = answers.groupBy("bucket").agg(F.max("words").alias("words")).agg(F.sum("words")).first()[0] or 0

    def finish(block: pa.Table, got: pa.Table) -> pa.Table:
        table = from_body(block.column("body")[0].as_buffer())
        doc, grams = grams_of(table, text, order)
        parts = sorted(zip(got.column("bucket").to_pylist(), got.column("counts"), strict=True), key=lambda r: r[0])
        flat = np.concatenate([unplanes(b.as_py(), "uint64") for _, b in parts]) if parts else np.zeros(0, "uint64")
        # every order's distinct names ascending, as they were asked
        seen, at = [], 0
        for names, _ in grams:
            keys, place = np.unique(names, return_inverse=True)
            seen.append(flat[at : at + len(keys)][place].astype("float64"))
            at += len(keys)
        value = np.log(seen[0] / max(running, 1))
        level = np.ones(len(doc), "int64")
        for n in range(2, order + 1):
            count, first = seen[n - 1], grams[n - 1][1]
            last = first + n - 1
            if n == 2:
                history = seen[0][first]
            else:  # the (n-1)-gram that begins at the same word
                where = np.full(len(doc), -1)
                where[grams[n - 2][1]] = np.arange(len(grams[n - 2][1]))
                history = seen[n - 2][where[first]]
            direct = count >= min_count
            value[last] = np.where(direct, np.log(count / history), value[last] + np.log(alpha))
            level[last[direct]] = n
        begins = np.searchsorted(doc, np.arange(table.num_rows))
        possible = np.minimum(np.arange(len(doc)) - begins[doc] + 1, order) if len(doc) else level
        n_words = np.bincount(doc, minlength=table.num_rows)
        total = np.bincount(doc, value, table.num_rows).astype("float64")
        low = np.bincount(doc, level < possible, table.num_rows).astype("int64")
        mean = pa.array(total / np.maximum(n_words, 1), mask=n_words == 0)
        return pa.table([table.column(id_column).cast(kind), pa.array(n_words.astype("int64")), pa.array(low), pa.array(total), mean], names=[id_column, "n_words", "n_backoff", "score", "mean_score"])

    kind = from_spark(docs.schema[id_column].dataType)
    shape = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, n_words bigint, n_backoff bigint, score double, mean_score double"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, shape)
