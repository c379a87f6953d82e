"""BPE encoding and decoding through a table of distinct words (operator 7).

Texts are split into the vocabulary's words block by block. Each distinct word of a block goes once to the
bucket its checksum names; a bucket encodes every distinct word of the corpus that falls to it exactly once.
The ids come back to the blocks that asked and are joined to the words by their positions. Decoding joins
ids to pieces (a table as long as the vocabulary, a fixed size) and concatenates them.

Null texts are empty, give no ids and the checksum of nothing. Repeated rows and ids give repeated results.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stable
from .blocks import BLOCK_BYTES, from_body, pack, tables, to_body

ENCODE_BATCH = 8_192


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


class Splitter:
    """Splits a text as the tokenizer's pre-tokenizer does.

    The pattern runs in ``regex``; the tokenizer knows a later Unicode version, so a text with a character
    that the two classify differently goes through the tokenizer's own splitter.
    """

    def __init__(self, path: str):
        from public_tokenizers import PATTERN

        self.tokenizer = _tokenizer(path)
        self.pattern = regex.compile(PATTERN)
        self.special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.same: dict[str, bool] = {}

    def agrees(self, char: str) -> bool:
        if char not in self.same:
            self.same[char] = all(len(self.tokenizer.pre_tokenizer.pre_tokenize_str(x + char)) == len(self.pattern.findall(x + char)) for x in "a1!")
        return self.same[char]

    def plain(self, text: str) -> list[str]:
        if text.isascii() or all(map(self.agrees, set(text))):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def __call__(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.cut.split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.plain(part))]


@cache
def _splitter(path: str) -> Splitter:
    return Splitter(path)


@cache
def _pieces(path: str) -> list[bytes]:
    """id -> bytes. Byte-level vocabularies write bytes as printable characters: those that print stand
    for themselves, the others for code points from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    back = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    vocabulary = _tokenizer(path).get_vocab(True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
    return out


def _texts(table: pa.Table, text: str) -> list[str]:
    return [t or "" for t in table.column(text).to_pylist()]


def asked_words(split: Iterator[list[str]], buckets: int) -> list[tuple[int, list[str]]]:
    """A block's distinct words, ascending, for each bucket that they fall to."""
    parts: dict[int, list[str]] = {}
    for word in sorted(set(chain.from_iterable(split))):
        parts.setdefault(zlib.crc32(word.encode()) % buckets, []).append(word)
    return sorted(parts.items())


def encode_words(blocks: DataFrame, path: str, buckets: int, text: str = "text") -> DataFrame:
    """``block, bucket, answer``: the ids of the words that a block asked a bucket for, in its order."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in tables(batches):
            parts = asked_words(map(_splitter(path), _texts(table, text)), buckets)
            bodies = [to_body(pa.record_batch({"word": pa.array(words)})) for _, words in parts]
            yield pa.RecordBatch.from_pydict({"bucket": [b for b, _ in parts], "block": [block] * len(parts), "body": bodies}, schema)

    def answer(rows: pa.Table) -> pa.Table:
        tokenizer = _tokenizer(path)
        asked = [from_body(b.as_buffer()).column("word").to_pylist() for b in rows.column("body")]
        words = list({w for part in asked for w in part})
        ids: dict[str, list[int]] = {}
        for i in range(0, len(words), ENCODE_BATCH):
            some = words[i : i + ENCODE_BATCH]
            ids.update(zip(some, (e.ids for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        bodies = [to_body(pa.record_batch({"ids": pa.array([ids[w] for w in part], pa.list_(pa.int32()))})) for part in asked]
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "answer": pa.array(bodies, pa.binary())})

    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("body", pa.binary())])
    asked = blocks.mapInArrow(ask, "bucket int, block bigint, body binary")
    return asked.groupBy("bucket").applyInArrow(answer, "block bigint, bucket int, answer binary")


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", with_ids: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids and the decoded text."""
    blocks = pack(docs, [id_column, text], text, block_bytes)
    buckets = max(8, blocks.count())
    answers = stable(encode_words(blocks, path, buckets, text), "word-ids")

    def finish(block: pa.Table, got: pa.Table) -> pa.Table:
        pieces = _pieces(path)
        table = from_body(block.column("body")[0].as_buffer())
        docs_words = list(map(_splitter(path), _texts(table, text)))
        place = {w: i for i, w in enumerate(chain.from_iterable(words for _, words in asked_words(docs_words, buckets)))}
        flat, sizes = [], []
        for _, body in sorted(zip(got.column("bucket").to_pylist(), got.column("answer"), strict=True), key=lambda r: r[0]):
            part = from_body(body.as_buffer())
            lists = part.column("ids").chunk(0) if part.num_rows else pa.array([], pa.list_(pa.int32()))
            sizes.append(np.diff(lists.offsets.to_numpy()))
            flat.append(lists.flatten().to_numpy())
        ids = np.concatenate(flat) if flat else np.zeros(0, "int32")
        size = np.concatenate(sizes).astype("int64") if sizes else np.zeros(0, "int64")
        first = np.cumsum(size) - size
        out: dict[str, list] = {c: [] for c in names}
        for doc, words in zip(table.column(id_column).to_pylist(), docs_words, strict=True):
            at = np.fromiter(map(place.__getitem__, words), "int64", len(words))
            n = size[at]
            start = np.repeat(first[at] - (np.cumsum(n) - n), n)
            doc_ids = ids[start + np.arange(len(start))]
            # byte sequences that are no UTF-8 become replacement characters, as in the library's decoder
            decoded = b"".join(map(pieces.__getitem__, doc_ids.tolist())).decode("utf-8", "replace")
            row = [doc, len(doc_ids), hashlib.sha256(doc_ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
            for c, v in zip(names, [*row, doc_ids, decoded], strict=False):
                out[c].append(v)
        return pa.table({c: pa.array(out[c], kinds[c]) for c in names})

    id_kind = docs.schema[id_column].dataType
    kinds = {id_column: from_spark(id_kind), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    shape = f"`{id_column}` {id_kind.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        kinds |= {"ids": pa.list_(pa.int32()), "decoded": pa.string()}
        shape += ", ids array<int>, decoded string"
    names = list(kinds)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, shape)


def from_spark(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def decode(tokens: DataFrame, path: str, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts from id lists, with the id-to-piece table joined row by row inside Arrow batches.

    A null list gives a null text; an unknown id gives nothing, as in the library.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            texts = [None if row is None else b"".join(pieces[i] for i in row if i is not None and 0 <= i < len(pieces)).decode("utf-8", "replace") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_column, "decoded"])

    kind = tokens.schema[id_column].dataType.simpleString()
    return tokens.select(F.col(id_column), F.col(ids)).mapInArrow(run, f"`{id_column}` {kind}, decoded string")
