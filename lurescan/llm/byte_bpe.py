"""Byte-level BPE by folds over the byte arrays of distinct words (operator 12).

Texts are cut into words block by block. A block's distinct words are encoded once each, and a document's ids are
those of its words, by place; decoding joins the binary pieces of ids. Nothing is shuffled and nothing stored: a block
is encoded where it is read, a hot text or word costs each task once per block, and a lost executor costs its blocks.
A task holds one block of ``block_bytes`` of text, or one longer document.

``encode_folded`` merges by folds of Spark's higher-order functions: the state is the set of cuts between a word's
pieces, single bytes at first, and the parts of the word that have a rank; a step merges the neighbouring pair of
least rank, leftmost first. A word that is itself a piece is taken whole, before any merge. Ranks come from a literal:
an array of small maps, a piece standing in the map that its hash names, so a look-up costs the same however long the
vocabulary is. The vocabulary is a fixed file, which bounds the literal. The cuts are bits of one number, so words of
over ``fold_bytes`` bytes are merged in the task that cuts the text, by the same rule.

Such folds are interpreted, node by node, and take several times the CPU that the limits allow (README has figures), so
``encode`` folds every word in the task that cut it: the same merges, in the same order, over the same arrays of bytes.

Null texts are empty and have no ids. Repeated rows and ids give repeated results, null ids stay. An empty table
gives no rows; extra columns of any name are left out. Equal ranks, the only ties, go to the leftmost pair.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 8 << 20
#: a word's cuts are bits of one long
FOLD_BYTES = 60
#: words merged in the task: longer ones with a heap
HEAP_BYTES = 60
NONE = 2**31 - 1
#: merged words that a worker remembers
REMEMBERED = 1 << 18
SLOTS = 1 << 16


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


# --- cutting texts into words ----------------------------------------------------------------------


class Splitter:
    """Cuts a text as tiktoken does with the published pattern.

    The pattern runs in ``regex``, which may know another Unicode version than tiktoken. A character that the two
    class differently is replaced, while cutting, by one of the class that tiktoken gives it. Texts whose characters
    are ASCII, or ASCII and letters that ``re`` takes for letters too, are cut by ``re`` with the same alternatives,
    which is twice as fast.
    """

    STAND_INS = {"a": "é", "1": "²", "!": "§", "": "　"}
    _PLAIN = r"'(?:[sdmt]|re|ve|ll)| ?{letter}+| ?[0-9]+| ?(?:{other})+|\s+(?!\S)|\s+"

    def __init__(self):
        import tiktoken
        from public_tokenizers import PATTERN

        self.pattern = regex.compile(PATTERN)
        self.ascii = re.compile(self._PLAIN.format(letter="[A-Za-z]", other=r"[^\sA-Za-z0-9]"), re.ASCII)
        self.letters = re.compile(self._PLAIN.format(letter=r"[^\W\d_]", other=r"[^\s\w]|_"))
        self.one_letter = re.compile(r"[^\W\d_]")
        # blanks to ``re``, but not to the pattern
        self.separators = re.compile("[\x1c-\x1f]")
        pieces = [bytes([b]) for b in range(256)] + [lead + bytes([b]) for lead in (b"a", b"1", b"!") for b in range(128, 256)]
        self.probe = tiktoken.Encoding("probe", pat_str=PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
        self.known: dict[str, tuple[bool, str | None]] = {}

    def about(self, char: str) -> tuple[bool, str | None]:
        """Whether all agree that a character is a letter; its stand-in, or None where ``regex`` classes it alike."""
        if char not in self.known:
            theirs = [lead for lead in "a1!" if self.probe.encode_ordinary(lead + char)[0] > 255]
            ours = [lead for lead in "a1!" if len(self.pattern.findall(lead + char)) == 1]
            swap = None if theirs == ours else self.STAND_INS["".join(theirs)]
            self.known[char] = (theirs == ["a"] and self.one_letter.match(char) is not None, swap)
        return self.known[char]

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text)
        found = {c: self.about(c) for c in set(text) if not c.isascii()}
        if all(letter for letter, _ in found.values()) and not self.separators.search(text):
            return self.letters.findall(text)
        swaps = {ord(c): s for c, (_, s) in found.items() if s}
        words = self.pattern.findall(text.translate(swaps) if swaps else text)
        if not swaps:
            return words
        ends = list(accumulate(map(len, words), initial=0))
        return [text[a:b] for a, b in pairwise(ends)]


@cache
def _splitter() -> Splitter:
    return Splitter()


def merge(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The ids of one word, merged in the task: pieces, and the ranks of the pairs between them."""
    if word in rank:
        return [rank[word]]
    if len(word) > HEAP_BYTES:
        return merge_long(word, rank)
    pieces = [word[i : i + 1] for i in range(len(word))]
    pairs = [rank.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while pairs and (least := min(pairs)) < NONE:
        at = pairs.index(least)
        pieces[at] += pieces.pop(at + 1)
        del pairs[at]
        if at:
            pairs[at - 1] = rank.get(pieces[at - 1] + pieces[at], NONE)
        if at < len(pairs):
            pairs[at] = rank.get(pieces[at] + pieces[at + 1], NONE)
    return [rank[p] for p in pieces]


@cache
def _merger(path: str) -> Callable[[bytes], list[int]]:
    """``merge``, remembering a bounded number of words between blocks."""
    rank = ranks(path)
    return lru_cache(REMEMBERED)(lambda word: merge(word, rank))


def merge_long(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The same for a long word, by a heap of pairs: least rank first, then leftmost."""
    n = len(word)
    ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        if j < n and (r := rank.get(word[i : ends[j]])) is not None:
            heapq.heappush(heap, (r, i, ends[j]))

    for i in range(n):
        push(i)
    gone = bytearray(n)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or ends[j] != end:
            continue  # one of the two has changed since
        gone[j] = 1
        ends[i], after[i] = end, after[j]
        if after[j] < n:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < n:
        out.append(rank[word[i : ends[i]]])
        i = after[i]
    return out


class _Places(dict):
    """word -> its place among the distinct words"""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def _cut(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[bytes]]]:
    """Blocks of rows (id, text): the ids, where each document's words end, the words' places, the distinct words."""
    split = _splitter()
    ids, ends, at, places, size = [], array("q", [0]), array("i"), _Places(), 0
    for batch in batches:
        first = 0
        for row, text in enumerate(batch.column(1).to_pylist()):
            at.extend(map(places.__getitem__, split(text or "")))
            ends.append(len(at))
            size += len(text or "") + 16
            if size >= block_bytes:
                ids.append(batch.column(0).slice(first, row + 1 - first))
                yield pa.concat_arrays(ids), np.array(ends), np.array(at, "int32"), [w.encode() for w in places]
                ids, ends, at, places, size, first = [], array("q", [0]), array("i"), _Places(), 0, row + 1
        ids.append(batch.column(0).slice(first))
    if len(ends) > 1:
        yield pa.concat_arrays(ids), np.array(ends), np.array(at, "int32"), [w.encode() for w in places]


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def blocks(docs: DataFrame, path: str, id_column: str, text: str, block_bytes: int, fold_bytes: int) -> DataFrame:
    """``docs array<struct<id, places>>, words array<binary>, long array<array<int>>``: long words come encoded."""
    schema = T.StructType().add("docs", T.ArrayType(T.StructType().add("id", docs.schema[id_column].dataType).add("places", T.ArrayType(T.IntegerType()))))
    schema = schema.add("words", T.ArrayType(T.BinaryType())).add("long", T.ArrayType(T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = _merger(path)
        for ids, ends, at, words in _cut(batches, block_bytes):
            rows = pa.StructArray.from_arrays([ids, _lists(ends, pa.array(at))], ["id", "places"])
            long = [merged(w) if len(w) > fold_bytes else None for w in words]
            yield pa.RecordBatch.from_pydict(
                {"docs": _lists(np.array([0, len(ids)]), rows), "words": pa.array([words], pa.list_(pa.binary())), "long": pa.array([long], pa.list_(pa.list_(pa.int32())))}
            )

    return docs.select(F.col(f"`{id_column}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


@cache
def _pieces(path: str) -> pa.Array:
    """id -> piece"""
    by_id = {i: p for p, i in ranks(path).items()}
    return pa.array([by_id.get(i, b"") for i in range(max(by_id) + 1)], pa.binary())


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id, n_tokens, ids array<int>, decoded string``, a row per row of ``docs``; distinct words are merged in the task.

    Ids are taken from the distinct words by place, pieces from the vocabulary by id; a document's ids and bytes are
    then ranges of what was taken.
    """
    schema = T.StructType().add(id_column, docs.schema[id_column].dataType).add("n_tokens", T.LongType()).add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged, pieces = _merger(path), _pieces(path)
        for ids, ends, at, words in _cut(batches, block_bytes):
            known = pa.array([merged(w) for w in words], pa.list_(pa.int32()))
            taken = known.take(pa.array(at))
            bounds = taken.offsets.to_numpy()[ends].astype("int64") if len(at) else np.zeros(len(ends), "int64")
            tokens = taken.flatten()
            spelt = pieces.take(tokens)
            starts = np.frombuffer(spelt.buffers()[1], "int32")[: len(spelt) + 1] if len(spelt) else np.zeros(1, "int32")
            decoded = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(starts[bounds].tobytes()), spelt.buffers()[2] or pa.py_buffer(b"")])
            columns = [ids, pa.array(np.diff(bounds)), _lists(bounds, tokens), decoded.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return docs.select(F.col(f"`{id_column}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


# --- folding merges --------------------------------------------------------------------------------


def rank_table(path: str) -> Column:
    """The literal: slot -> {hexadecimal piece: rank}. Spark folds the parsing away while planning."""
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for piece, rank in ranks(path).items():
        text = piece.decode("latin-1")
        slots[xxhash.xxh64_intdigest(text.encode(), seed=42) % SLOTS][text] = rank
    return F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), "array<map<string,bigint>>")


def piece_table(path: str) -> Column:
    """The literal: id -> hexadecimal piece."""
    by_id = {i: p.hex().upper() for p, i in ranks(path).items()}
    return F.split(F.lit(",".join(by_id.get(i, "") for i in range(max(by_id) + 1))), ",")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _bit(p: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), p)


def fold_word(word: Column, rank_of: Callable[[Column], Column]) -> Column:
    """The ids of one word, an array of integers; ``rank_of`` takes bytes as characters, null is no piece.

    Any piece that merges can make is a part of the word that has a rank. The state is the set of cuts between pieces
    (a bit per byte position, both ends included) and these parts in order of rank and start, each as the bits of its
    ends and of the cuts inside. A part is a neighbouring pair when one cut is left inside; the first such part is
    merged. Parts that lost an end to a merge, or were merged, leave the state.
    """

    def parts(text: Column, n: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            return rank_of(F.substring(text, a + 1, b - a)) * 4096 + (a * 64 + b)

        found = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda a: F.transform(F.sequence(a + 2, n), lambda b: part(a, b))))
        bits = F.transform(F.sort_array(F.array_compact(found)), lambda k: F.struct(_bit((k / 64).cast("int") % 64).alias("a"), _bit((k % 64).cast("int")).alias("b")))
        return F.transform(bits, lambda k: F.struct((k["a"] + k["b"]).alias("ends"), (k["b"] - k["a"] * 2).alias("inner")))

    def step(acc: Column, _: Column) -> Column:
        def merged(inner: Column) -> Column:
            cuts = acc["cuts"] - acc["cuts"].bitwiseAND(inner)
            return _let(cuts, lambda now: F.struct(now.alias("cuts"), F.filter(acc["parts"], lambda p: (now.bitwiseAND(p["ends"]) == p["ends"]) & (now.bitwiseAND(p["inner"]) != 0)).alias("parts")))

        ready = F.filter(acc["parts"], lambda p: F.bit_count(acc["cuts"].bitwiseAND(p["inner"])) == 1)
        return F.when(F.size(acc["parts"]) == 0, acc).otherwise(_let(F.coalesce(F.get(ready, 0)["inner"], F.lit(-1).cast("bigint")), merged))

    def folded(text: Column, n: Column) -> Column:
        start = F.struct((_bit(n + 1) - 1).alias("cuts"), parts(text, n).alias("parts"))

        def pieces(acc: Column) -> Column:
            live = F.filter(F.sequence(F.lit(0), n), lambda i: F.getbit(acc["cuts"], i) == 1)
            return _let(live, lambda at: F.transform(F.slice(at, 2, n), lambda end, i: rank_of(F.substring(text, F.get(at, i) + 1, end - F.get(at, i))).cast("int")))

        return F.aggregate(F.sequence(F.lit(1), n - 1), start, step, pieces)

    def ids(text: Column) -> Column:
        whole = rank_of(text)
        return F.when(whole.isNotNull(), F.array(whole.cast("int"))).otherwise(_let(F.length(text), lambda n: folded(text, n)))

    return _let(F.decode(word, "ISO-8859-1"), ids)


def encode_folded(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, fold_bytes: int = FOLD_BYTES) -> DataFrame:
    """``encode`` with the distinct words of up to ``fold_bytes`` bytes merged by Spark's higher-order functions."""

    def rank_in(table: Column) -> Callable[[Column], Column]:
        return lambda piece: F.get(table, F.xxhash64(piece).bitwiseAND(F.lit(SLOTS - 1)).cast("int"))[piece]

    def spelt(ids: Column, pieces: Column) -> Column:
        return _let(ids, lambda i: F.struct(i.alias("ids"), _joined(i, pieces).cast("string").alias("text")))

    cut = blocks(docs, path, id_column, text, block_bytes, fold_bytes)

    def word(plain: Column, long: Column, table: Column, pieces: Column) -> Column:
        return spelt(F.coalesce(long, fold_word(plain, rank_in(table))), pieces)

    # each literal stands in the plan once, bound to a variable
    known = _let(rank_table(path), lambda table: _let(piece_table(path), lambda pieces: F.zip_with("words", "long", lambda w, x: word(w, x, table, pieces))))
    # out of a one-row generator, so that the planner cannot move the folds into the work per document
    known = cut.select("docs", F.inline(F.array(F.struct(known.alias("known")))))

    def document(doc: Column) -> Column:
        ids = F.flatten(F.transform(doc["places"], lambda p: F.get("known", p)["ids"]))
        decoded = F.array_join(F.transform(doc["places"], lambda p: F.get("known", p)["text"]), "")
        return F.struct(doc["id"].alias(id_column), ids.alias("ids"), decoded.alias("decoded"))

    out = known.select(F.inline(F.transform("docs", document)))
    return out.select(id_column, F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


def _joined(ids: Column, hex_pieces: Column) -> Column:
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(hex_pieces, i)), ""))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``bytes``: the binary pieces of the ids, joined. Null ids give null bytes."""
    return encoded.withColumn("bytes", _joined(F.col(f"`{ids}`"), piece_table(path)))
