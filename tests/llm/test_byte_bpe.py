"""Byte-level BPE against the library."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from lurescan.llm import byte_bpe
from lurescan.llm.queries import QUERIES, RANKS, vocabulary

SHAPE = "doc_id bigint, text string, ids string, words string, known int"
PATH = vocabulary(RANKS)
RANK = byte_bpe.ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANK, special_tokens={})


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    odd = [None, "", " ", "\x00", "<|endoftext|>", "a" * 5_000, "=" * 3_001, "中文字" * 400, "x՘࢏'s don't 'LL", "　 \x1c\x85  \n\n z", "é" * 61 + " " + "ab" * 30, "🙂‍🙃" * 9, "0123456789" * 30]
    made = ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x500), rng.randint(0x2000, 0xD7FF), rng.randint(0x1F000, 0x1FBFF), 32, 10])) for _ in range(rng.randint(1, 300))) for _ in range(150)]
    made += [" ".join("".join(rng.choice("etaoinshrdluöé") for _ in range(rng.randint(1, 14))) for _ in range(200)) for _ in range(20)]
    return list(enumerate(odd + made)) + [(None, "no id"), (3, "same id"), (3, "same id")]


@pytest.mark.parametrize("fold_bytes", [60, 6, None])
def test_ids_and_text_equal_the_library(spark, rows, fold_bytes):
    docs = spark.createDataFrame([(*r, "i", "w", 1) for r in rows], SHAPE).repartition(3)
    out = byte_bpe.encode_folded(docs, PATH, block_bytes=9_000, fold_bytes=fold_bytes) if fold_bytes else byte_bpe.encode(docs, PATH, block_bytes=9_000)
    got = collections.Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in out.collect())
    want = collections.Counter()
    for i, t in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        want[i, len(ids), tuple(ids), t or ""] += 1
    assert got == want
    assert all(bytes(r.bytes) == r.decoded.encode() for r in byte_bpe.decode(out, PATH).collect())


def test_every_character_is_cut_as_the_library_cuts_it():
    split = byte_bpe.Splitter()
    for code in range(128, 0x110000):
        if not 0xD800 <= code < 0xE000 and code % 7 == 0:
            text = f"a{chr(code)}1{chr(code)}! {chr(code)}'s"
            assert "".join(split(text)) == text
            ids = [i for w in split(text) for i in (byte_bpe.merge(w.encode(), RANK))]
            assert ids == LIBRARY.encode_ordinary(text), hex(code)


def test_long_words():
    rng = random.Random(2)
    for n in (1, 2, 61, 1_000):
        word = bytes(rng.choice(b"abcdefgh") for _ in range(n))
        assert byte_bpe.merge(word, RANK) == LIBRARY.encode_ordinary(word.decode())


def test_empty_table(spark):
    none = spark.createDataFrame([], SHAPE)
    assert byte_bpe.encode(none, PATH).count() == byte_bpe.encode_folded(none, PATH).count() == 0
    blank = spark.createDataFrame([(1, None, "i", "w", 1), (2, "", "i", "w", 1)], SHAPE)
    assert [(r.n_tokens, r.ids, r.decoded) for r in byte_bpe.encode(blank, PATH).collect()] == [(0, [], "")] * 2


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op12_byte_bpe"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
