"""Removal of passages that stand earlier in the corpus, by longest-previous-factor length (operator 9).

A byte goes when some ``length``-byte string that covers it also starts earlier: in a document with a smaller
id, or further ahead in the same document. Everything is judged on the input.

The longest-previous-factor array of a text gives, for each position, the longest prefix of its suffix that
starts earlier; the earlier start is found at the previous or next smaller position in suffix order. Only
whether it reaches ``length`` matters here, so a suffix order by names is enough: suffixes are sorted by the
names (64-bit hashes) of their leading strings and, among equals, by position. Any order that keeps suffixes
with a common ``length``-byte prefix together gives the same answer, and with ties in position order the
previous smaller position inside such a run is the entry just before (``previous_factor``).

A sort of every suffix would shuffle many times the input. Positions are therefore named in runs:

* Windows of ``length`` bytes whose smallest 32-byte name (minimiser) stands at the same place form a run.
  Equal windows have equal minimisers, so a window can only repeat inside a run with the same one.
* Level 1 sorts runs by (minimiser, name of the run's whole text). A run whose text starts earlier is a
  copy. A run that shares its minimiser with different texts is open; all others are first and done.
* Level 2 does the same to pieces of open runs of up to 8 windows (their common 93 bytes take the
  minimiser's place), level 3 to the single windows of open pieces. So the work of the finer levels follows
  the edges of copies, not their extent.

Each level is one exchange of packed names (see ``blocks``): a block names each text once, so copies never
crowd a bucket. No bytes are compared; two different strings share a name with a chance of about 2^-60.

Null and empty texts have no bytes. Rows that share an id count as one document: a string at a smaller start
in one counts as earlier for the other, equal starts do not. Null ids come before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stable
from .blocks import bucket_edges, from_body, pack, planes, sorted_planes, tables, text_bytes, unplanes, unsorted_planes
from .words import mix

#: a block's names take about 24 times its text while they are made, and a worker keeps that memory
BLOCK_BYTES = 6 << 20
KGRAM = 32
LEVELS = (1 << 30, 8, 1)  # windows in a piece, at most
UNIQUE, OPEN, COPY = 0, 1, 2

_U = np.uint64
_BYTES = np.random.default_rng(20240602).integers(1, 2**63, 256, dtype="uint64") * _U(2) + _U(1)
_STEPS = [_U(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


#: positions named at once; their arrays stay in the processor's cache
CHUNK = 1 << 16


def _chunk_names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the 32 and 64 bytes from each position on, by doubling. Entries past the end are unused."""
    h = _BYTES[data]
    out = []
    for k, c in enumerate(_STEPS):
        step = 1 << k
        h *= c
        if len(h) > step:
            other = h[step:] >> _U(1)
            other *= _STEPS[5 - k]
            h[:-step] += other
        h ^= h >> _U(29)
        if step >= 16:
            out.append(mix(h))
    return out[0], out[1]


def _names(data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(32-byte names, 64-byte names, place of the leftmost smallest 32-byte name among ``span`` from each on)."""
    n = len(data)
    short, long, least = np.empty(n, "uint64"), np.empty(n, "uint64"), np.empty(n, "int32" if n < 2**31 else "int64")
    for at in range(0, n, CHUNK):
        h32, h64 = _chunk_names(data[at : at + CHUNK + span + 64])
        width = min(CHUNK, n - at)
        short[at : at + width], long[at : at + width] = h32[:width], h64[:width]
        # the name's high half, then the place: the smallest is the leftmost of the smallest names
        key = (h32 >> _U(32) << _U(32)) | np.arange(len(h32), dtype="uint64")
        have = 1
        while have < span:
            step = min(have, span - have)
            key[: max(len(key) - step, 0)] = np.minimum(key[: max(len(key) - step, 0)], key[step:])
            have += step
        least[at : at + width] = at + (key[:width] & _U(0xFFFFFFFF)).astype("int64")
    return short, long, least


def previous_factor(groups: np.ndarray, strings: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """UNIQUE, OPEN or COPY for entries of a suffix order by (group, string), ties in position order.

    COPY: the previous smaller position shares the whole string. OPEN: first with its string, but others of
    the group differ, so shorter common prefixes are possible.
    """
    order = np.lexsort((places, docs, strings, groups))
    g, s, d, p = groups[order], strings[order], docs[order], places[order]
    same_group = np.r_[False, g[1:] == g[:-1]]
    same = same_group & np.r_[False, s[1:] == s[:-1]]
    # the first position of the equal run: entries at that very position (rows sharing an id) have none before
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    copy = same & ((d != d[first]) | (p != p[first]))
    group_no = np.cumsum(~same_group) - 1
    kinds = np.bincount(group_no, ~same) if len(order) else np.zeros(0)
    state = np.where(copy, COPY, np.where(kinds[group_no] > 1, OPEN, UNIQUE)).astype("uint8")
    out = np.empty(len(order), "uint8")
    out[order] = state
    return out


class Block:
    """The runs of a block's windows, and the names of their pieces."""

    def __init__(self, table: pa.Table, id_column: str, text: str, length: int):
        self.table, self.length = table, length
        self.data, self.starts = text_bytes(table, text)
        self.ids = np.asarray(table.column(id_column).fill_null(-(2**63)).to_numpy(), "int64")
        self.shared = len(np.unique(self.ids)) < len(self.ids)
        n, span = len(self.data), length - KGRAM + 1
        ends = self.starts[1:]
        valid = np.zeros(n, bool)
        for a, b in zip(self.starts[:-1].tolist(), ends.tolist(), strict=True):
            valid[a : max(a, b - length + 1)] = True
        if not valid.any():
            self.run_from = self.run_to = self.anchor = np.zeros(0, "int64")
            return
        self.h32, self.h64, least = _names(self.data, span)
        moved = np.r_[True, least[1:] != least[:-1]]
        # a run begins and ends where the minimiser's place or the document changes; flags, not positions, keep a block small
        self.run_from = np.flatnonzero(valid & (moved | ~np.r_[False, valid[:-1]]))
        self.run_to = np.flatnonzero(valid & np.r_[moved[1:] | ~valid[1:], True])
        self.anchor = least[self.run_from].astype("int64")

    def text_name(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Name of the bytes from begin to end; 65 to 192 of them, which three overlapping names of 64 cover."""
        middle = np.minimum(begin + 64, end - 64)
        return mix(mix(mix(self.h64[begin]) + self.h64[middle] * _STEPS[1]) + self.h64[end - 64] * _STEPS[2] + (end - begin).astype("uint64"))

    def pieces(self, size: int, first: np.ndarray, last: np.ndarray, anchor: np.ndarray):
        """Cuts runs into pieces of windows with (anchor - start) // size equal. Returns start, end, anchor."""
        if size >= self.length or not len(first):
            return first, last, anchor
        low, high = (anchor - last) // size, (anchor - first) // size
        count = high - low + 1
        owner = np.repeat(np.arange(len(first)), count)
        j = np.repeat(high, count) - (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
        a = anchor[owner]
        return np.maximum(first[owner], a - j * size - size + 1), np.minimum(last[owner], a - j * size), a

    def entries(self, size: int, first: np.ndarray, last: np.ndarray, anchor: np.ndarray):
        """(group name, string name) of pieces: the group by what all windows of such a piece share."""
        string = mix(self.text_name(first, last + self.length) + (anchor - first).astype("uint64"))
        if size >= self.length:
            return self.h32[anchor], string
        if size == 1:
            return self.text_name(first, first + self.length), np.zeros(len(first), "uint64")
        j = (anchor - first) // size
        core = anchor - j * size
        return mix(self.text_name(core, core - size + 1 + self.length) + self.h32[anchor] + j.astype("uint64")), string

    def ask(self, size: int, first: np.ndarray, last: np.ndarray, anchor: np.ndarray):
        """Distinct entries in suffix order, and which of them each piece is (or COPY inside the block)."""
        group, string = self.entries(size, first, last, anchor)
        doc = np.searchsorted(self.starts, first, side="right") - 1
        ids, place = self.ids[doc], first - self.starts[doc]
        # pieces come by document and place; with ids ascending a stable sort keeps them so
        rising = bool((self.ids[1:] >= self.ids[:-1]).all()) and bool((first[1:] >= first[:-1]).all())
        order = np.lexsort((string, group) if rising and not self.shared else (place, ids, string, group))
        g, s, d, p = group[order], string[order], ids[order], place[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (s[1:] != s[:-1])] if len(order) else np.zeros(0, bool)
        head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
        copied = np.empty(len(order), bool)
        copied[order] = (d != d[head]) | (p != p[head])
        which = np.empty(len(order), "int64")
        which[order] = np.cumsum(new) - 1
        return g[new], s[new], d[new], p[new], which, copied

    def states(self, size: int, first, last, anchor, flags: np.ndarray) -> np.ndarray:
        _, _, _, _, which, copied = self.ask(size, first, last, anchor)
        return np.where(copied, COPY, flags[which]) if len(which) else np.zeros(0, "uint8")

    def descend(self, levels: list[np.ndarray]):
        """Follows the answers of the levels done. Returns copied [start, end) byte ranges and what is open."""
        ranges = []
        open_runs = (self.run_from, self.run_to, self.anchor)
        for size, flags in zip(LEVELS, levels, strict=False):
            open_runs = self.pieces(size, *open_runs)
            state = self.states(size, *open_runs, flags)
            copy = state == COPY
            ranges.append((open_runs[0][copy], open_runs[1][copy] + self.length))
            # of a string that stands several times only its first place goes on: the others are copies
            open_runs = tuple(x[state == OPEN] for x in open_runs)
        return ranges, open_runs


def _answers(got: pa.Table, level: int) -> np.ndarray:
    parts = sorted((b, f) for lv, b, f in zip(got.column("level").to_pylist(), got.column("bucket").to_pylist(), got.column("flags").to_pylist(), strict=True) if lv == level)
    return np.concatenate([unplanes(f, "uint8") for _, f in parts]) if parts else np.zeros(0, "uint8")


def _settle(asked: DataFrame) -> DataFrame:
    def settle(rows: pa.Table) -> pa.Table:
        read = {c: [unplanes(b.as_py(), t) for b in rows.column(c)] for c, t in (("strings", "uint64"), ("ids", "int64"), ("places", "uint32"))}
        groups = [unsorted_planes(b.as_py()) for b in rows.column("groups")]
        flags = previous_factor(np.concatenate(groups), *(np.concatenate(read[c]) for c in ("strings", "ids", "places")))
        ends = np.cumsum([len(g) for g in groups])
        back = [planes(flags[e - len(g) : e]) for g, e in zip(groups, ends, strict=True)]
        return pa.table([rows.column("block"), rows.column("level"), rows.column("bucket"), pa.array(back, pa.binary())], names=["block", "level", "bucket", "flags"])

    return asked.groupBy("bucket").applyInArrow(settle, "block bigint, level int, bucket int, flags binary")


ASKED = "block bigint, level int, bucket int, groups binary, strings binary, ids binary, places binary"


def repeated(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = 100, block_bytes: int = BLOCK_BYTES, with_text: bool = True) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, spans and kept text.

    ``length`` is 65 to 124 bytes. Spans are [start, end) byte ranges, ascending. Kept text drops the bytes
    of characters that were cut in two.
    """
    if not 65 <= length <= 124:
        raise ValueError("length must be 65 to 124 bytes")
    blocks = pack(docs.withColumn(id_column, F.col(id_column).cast("bigint")), [id_column, text], text, block_bytes)
    buckets = max(8, blocks.count())

    def rows_of(block: int, made: Block, level: int, open_runs) -> pa.RecordBatch:
        g, s, d, p, _, _ = made.ask(LEVELS[level], *made.pieces(LEVELS[level], *open_runs))
        rows = [(block, level, b, sorted_planes(g[i:j]), planes(s[i:j]), planes(d[i:j]), planes(p[i:j].astype("uint32"))) for b, i, j in bucket_edges(g, buckets)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in tables(batches):
            made = Block(table, id_column, text, length)
            if len(made.run_from):
                yield rows_of(block, made, 0, (made.run_from, made.run_to, made.anchor))

    def refine(level: int):
        def run(block: pa.Table, got: pa.Table) -> pa.Table:
            made = Block(from_body(block.column("body")[0].as_buffer()), id_column, text, length)
            if not len(made.run_from):
                return schema.empty_table()
            _, open_runs = made.descend([_answers(got, k) for k in range(level)])
            return pa.Table.from_batches([rows_of(block.column("block")[0].as_py(), made, level, open_runs)])

        return run

    def finish(block: pa.Table, got: pa.Table) -> pa.Table:
        made = Block(from_body(block.column("body")[0].as_buffer()), id_column, text, length)
        cover = np.zeros(len(made.data) + 1, "int32")
        if len(made.run_from):
            ranges, _ = made.descend([_answers(got, k) for k in range(len(LEVELS))])
            for begins, ends in ranges:
                np.add.at(cover, begins, 1)
                np.add.at(cover, ends, -1)
        gone = np.cumsum(cover[:-1]) > 0
        out: dict[str, list] = {c: [] for c in names}
        for i, (a, b) in enumerate(zip(made.starts[:-1].tolist(), made.starts[1:].tolist(), strict=True)):
            cut = gone[a:b]
            edge = np.flatnonzero(np.diff(np.r_[False, cut, False].astype("int8")))
            kept = made.data[a:b][~cut].tobytes()
            row = [made.table.column(id_column)[i].as_py(), b - a, int(cut.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest()]
            if with_text:
                row += [[{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)], kept.decode("utf-8", "ignore")]
            for c, v in zip(names, row, strict=True):
                out[c].append(v)
        return pa.table({c: pa.array(out[c], kinds[c]) for c in names})

    schema = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("bucket", pa.int32()), *[(c, pa.binary()) for c in ("groups", "strings", "ids", "places")]])
    answers = stable(_settle(blocks.mapInArrow(begin, ASKED)), "repeats-1")
    for level in range(1, len(LEVELS)):
        asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(refine(level), ASKED)
        answers = answers.unionByName(stable(_settle(asked), f"repeats-{level + 1}"))
    kinds = {id_column: pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    shape = f"`{id_column}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    if with_text:
        kinds |= {"spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept": pa.string()}
        shape += ", spans array<struct<start: bigint, end: bigint>>, kept string"
    names = list(kinds)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, shape)
