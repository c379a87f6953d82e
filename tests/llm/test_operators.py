"""The first ten operators against brute force, on small rows with nulls, repeats, ties and odd texts."""

import collections
import hashlib
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from lurescan.llm import bpe, decontaminate, licenses, near_dups, ngram_lm, pii, quality, repeats, search, warc
from lurescan.llm.queries import QUERIES, vocabulary
from lurescan.llm.words import words_of

SHAPE = "doc_id bigint, text string, node string, id string, bucket bigint"
ODD = [(9001, None), (9002, ""), (9003, "!!"), (None, "x y z"), (9004, "É é ß 12"), (9005, "ab " * 400), (9005, "ab " * 400), (9006, "ab " * 200 + "q " + "ab " * 200), (9007, "w"), (9008, "b" * 100), (9009, "b" * 100), (9010, "<|endoftext|>x՘࢏'s")]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vocabulary_ = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    made = [" ".join(rng.choice(vocabulary_) for _ in range(rng.randint(3, 90))) for _ in range(40)]
    copies = []
    for t in made[:12]:
        w = t.split()
        w[len(w) // 2] = "Changed,"
        copies += [" ".join(w), t.upper(), t]
    return [(i, t) for i, t in enumerate(made + copies)] + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "n", "i", 1) for i, t in rows], SHAPE).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def test_bpe_equals_the_library(docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    expected = collections.Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected[(i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), library.decode(ids, skip_special_tokens=False))] += 1
    encoded = bpe.encode(docs, vocabulary(), block_bytes=2_000)
    got = encoded.collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded) for r in got) == expected
    assert all(hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256 for r in got)
    assert {r.decoded for r in bpe.decode(encoded, vocabulary()).collect()} == {t or "" for _, t in rows}
    assert bpe.encode(empty, vocabulary()).count() == 0


def test_repeats_equal_brute_force(docs, rows, empty):
    texts = [(-1 if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        for p in range(len(b) - 99):
            first[b[p : p + 100]] = min(first.get(b[p : p + 100], (i, p)), (i, p))
    expected = collections.Counter()
    for i, b in texts:
        cover = bytearray(len(b))
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] < (i, p):
                cover[p : p + 100] = b"\1" * 100
        kept = bytes(c for c, x in zip(b, cover, strict=True) if not x)
        expected[(i, len(b), sum(cover), len([s for s in bytes(cover).split(b"\0") if s]), hashlib.sha256(kept).hexdigest())] += 1
    got = repeats.repeated(docs, block_bytes=3_000).collect()
    assert collections.Counter((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected
    assert sum(r.n_removed for r in got) > 1_000
    assert repeats.repeated(empty).count() == 0


def test_ngram_scores_equal_brute_force(docs, rows, empty):
    counts, total, lists = collections.Counter(), 0, []
    for i, t in rows:
        w = words_of(t)
        lists.append((-1 if i is None else i, w))
        total += len(w)
        for n in (1, 2, 3):
            counts.update(zip(*[w[k:] for k in range(n)], strict=False))
    expected = []
    for i, w in lists:
        score = 0.0
        for k in range(len(w)):
            factor = 1.0
            for n in range(min(3, k + 1), 0, -1):
                gram = tuple(w[k - n + 1 : k + 1])
                if n == 1:
                    score += math.log(factor * counts[gram] / total)
                elif counts[gram] >= 2:
                    score += math.log(factor * counts[gram] / counts[gram[:-1]])
                    break
                else:
                    factor *= 0.4
        expected.append((i, len(w), score))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.score) for r in ngram_lm.score(docs, block_bytes=2_000).collect())
    for (i, n, s), (j, m, x) in zip(got, sorted(expected), strict=True):
        assert (i, n) == (j, m) and abs(s - x) < 1e-6
    assert ngram_lm.score(empty).count() == 0


def _shingles(text):
    w = words_of(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def test_near_duplicate_classes_equal_brute_force(docs, rows, empty):
    named = {i: _shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in named}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in named:
        for j in named:
            if j < i and named[i] and named[j]:
                common = sum((named[i] & named[j]).values())
                if common >= 0.8 * (sum(named[i].values()) + sum(named[j].values()) - common):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    got = near_dups.classes(docs).collect()
    assert len(got) == len(rows)
    assert all(r.class_id == (None if r.doc_id is None else root(r.doc_id)) for r in got)
    kept = near_dups.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({root(i) for i in named})
    assert near_dups.classes(empty).count() == 0


def test_bagminhash_is_unbiased():
    import numpy as np

    name = np.arange(1, 41, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)
    one, two = np.arange(1, 41) % 7 + 1, np.arange(1, 41) % 5 + 1
    rows_ = near_dups.signatures(np.repeat([0, 1], 40), np.r_[name, name], np.r_[one, two], 2, 4_000)
    assert abs((rows_[0] == rows_[1]).mean() - np.minimum(one, two).sum() / np.maximum(one, two).sum()) < 0.04


def test_decontamination_equals_brute_force(spark, docs, rows, empty):
    texts = dict(rows)
    items = [(1, " ".join(texts[2].split()[:30])), (2, "w"), (3, None), (1, "b " * 20), (None, "É é")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    windows = {}
    for i, t in items:
        w = words_of(t)
        for p in range(len(w) - min(13, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + 13]), set()).add("null" if i is None else str(i))
    expected = collections.Counter()
    for i, t in rows:
        w = words_of(t)
        hit, found = set(), set()
        for gram, names in windows.items():
            for p in range(len(w) - len(gram) + 1):
                if tuple(w[p : p + len(gram)]) == gram:
                    hit |= set(range(p, p + len(gram)))
                    found |= names
        expected[(i, len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w))] += 1
    for limit in (0, 500_000):  # by shuffle, by broadcast
        got = decontaminate.hits(docs, bench, broadcast_rows=limit).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in got) == expected
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in expected.items() if not k[4])
    assert decontaminate.hits(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.hits(empty, bench).count() == 0


def test_search_equals_scoring_everything(docs, rows, empty):
    lists = [(i, collections.Counter(words_of(t))) for i, t in rows]
    n, mean = len(lists), sum(sum(c.values()) for _, c in lists) / len(lists)
    df = collections.Counter(w for _, c in lists for w in c)
    idf = {w: round(math.log(1 + (n - d + 0.5) / (d + 0.5)), 9) for w, d in df.items() if d > 1}
    expected = {}
    for q, c in lists:
        if q is None or q % 20 or not c:
            continue
        terms = [w for w in c if w in idf]
        scored = []
        for i, d in lists:
            s = sum(idf[w] * d[w] * 2.2 / (d[w] + 1.2 * (0.25 + 0.75 * sum(d.values()) / mean)) for w in terms if d[w])
            if i is not None and s > 0:
                scored.append((-round(s, 6), i))
        expected[q] = [(i, -s) for s, i in sorted(scored)[:3]]
    got = {}
    for r in search.top_k(docs, F.col("doc_id") % 20 == 0, k=3, shard_bytes=2_000).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert {q: v for q, v in expected.items() if v} == got
    assert search.top_k(empty, F.col("doc_id") % 20 == 0).count() == 0


def test_search_query_takes_whole_documents(spark, rows, tmp_path):
    """Rows whose only link is a passage of frequent words, which the rarer words of the query must not hide."""
    rng = random.Random(3)
    shared = " ".join(f"passage{i}" for i in range(30))
    own = " ".join(f"{w} {w} {w}" for w in (f"rare{i}" for i in range(12)))
    made = [(20, f"{shared} {own}"), (21, shared), *((i, f"{own} tail{i}") for i in range(22, 26)), *((i, " ".join(rng.sample(shared.split(), 8))) for i in range(26, 200))]
    made += [r for r in rows if r[0] is None or r[0] >= 9001]
    spark.createDataFrame(made, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lists = [(i, collections.Counter(words_of(t))) for i, t in made]
    n, mean = len(lists), sum(sum(c.values()) for _, c in lists) / len(lists)
    df = collections.Counter(w for _, c in lists for w in c)
    idf = {w: round(math.log(1 + (n - d + 0.5) / (d + 0.5)), 9) for w, d in df.items() if d > 1}
    expected = set()
    for q, c in lists:
        if q is not None and q % 20 == 0:
            scored = []
            for i, d in lists:
                s = sum(idf[w] * d[w] * 2.2 / (d[w] + 1.2 * (0.25 + 0.75 * sum(d.values()) / mean)) for w in c if w in idf and d[w])
                if i is not None and s > 0:
                    scored.append((-round(s, 6), i))
            expected |= {(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:10], 1)}
    got = {tuple(r) for r in QUERIES["op2_search"](spark, str(tmp_path)).collect()}
    assert got == expected
    assert (20, 21) in {(q, d) for q, _, d, _ in got}


def test_licenses(spark, empty):
    texts = [
        (1, "Released under the MIT\n * License. MIT LICENSE mit-license"),
        (2, "Licensed under the Apache License, Version 2.0."),
        (3, "Licensed under the Apache Software License"),
        (4, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
        (5, "Redistribution and use in source and binary forms, with modification, are permitted provided that the following conditions are met:"),
        (6, None),
        (7, "This work is licensed under the GNU General Public License, version 3."),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert [(x.label, x.start) for x in got[1].base] == [("mit", 3), ("mit", 5), ("mit", 7)]
    assert [(x.label, x.start, x.end) for x in got[1].found] == [("mit", 0, 5)]
    assert [(x.label, x.start, x.end) for x in got[2].found] == [("apache", 0, 8)]
    assert not got[3].found and not got[3].base and got[3].score == 0
    assert [x.label for x in got[4].found] == ["bsd"] and not got[5].found
    assert got[6].n_words == 0 and got[6].score == 0
    assert [x.label for x in got[7].base] == ["gpl"] and got[7].found[0].end == 12
    assert licenses.scan(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.compile_template("x", "a <<endOptional>>")


def test_license_automaton_equals_expansion():
    template = "a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> <<var;name=x;words=1..2>> d"
    automaton = licenses.compile_template("x", template)
    rng = random.Random(3)
    for _ in range(300):
        w = [rng.choice([b"a", b"b", b"c", b"d", b"e"]) for _ in range(rng.randint(1, 9))]
        ends = [e for e in range(1, len(w) + 1) for opt in ([], [b"b"], [b"b", b"c"]) for k in (1, 2) if e == 2 + len(opt) + k and w[0] == b"a" and w[1 : 1 + len(opt)] == opt and w[e - 1] == b"d"]
        assert automaton.longest(w, 0) == (max(ends) if ends else None)


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/ü", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "u\r\nx: y", ""), (None, "n", "<p>é</p>"), (5, "big", "z" * 300_000), (2, "http://b/", "<p>é</p>")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id bigint, url string, html string, payload string")
    got = warc.round_trip(df, with_payload=True, roll_bytes=600).collect()
    assert len(got) == len(pages) and all(r.verified for r in got)
    for r in got:
        html = next(h or "" for i, u, h in pages if i == r.page_id and u == r.url)
        assert r.payload_bytes == len(html.encode())
        assert r.payload_digest == warc.digest32(hashlib.sha1(html.encode()).digest())
        assert (r.record_type, r.refers_to) == (("revisit", 2) if r.page_id == 1 else ("revisit", 4) if r.page_id == 3 else ("response", None))
        assert r.payload == (None if r.record_type == "revisit" else html.encode())
    assert warc.round_trip(df.limit(0)).count() == 0
    import io

    data = warc.record(1, "u", b"abc", None, "2024-01-01T00:00:00Z")
    assert [x["verified"] for x in warc.records(io.BytesIO(data * 2), "p")] == [True, True]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-9]), "p"))
    import zlib

    broken = zlib.compressobj(6, zlib.DEFLATED, 31)
    wrong = broken.compress(zlib.decompress(data, 31).replace(b"abc", b"abd")) + broken.flush()
    assert [x["verified"] for x in warc.records(io.BytesIO(wrong), "p")] == [False]


def test_pii_rules_equal_the_patterns():
    import re

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(5)
    for _ in range(2_000):
        text = "".join(rng.choice(["a", "@", ".", "b.c", " ", "1", "+1", "é", "-", "4111 1111 1111 1111", "10.0.0.1"]) for _ in range(rng.randint(1, 14)))
        got = pii.rule_spans(text)
        assert got["email"] == [m.span() for m in email.finditer(text)]
    got = pii.rule_spans("x 256.1.1.1 1.2.3.4, 4111-1111 1111 1111, 4111111111111112 +1 (980) 555-2833")
    assert (got["ip"], got["card"], got["phone"]) == ([(12, 19)], [(21, 40)], [(59, 76)])


def test_pii_field_adds_spans_and_leaves_prose(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.train(docs, sample=150)
    add = pii.find('So the token = "269b1cea0846965f2d3ecb5cdb87c0edc7a7a587" of thing', model)[1]
    assert add == [("secret", 16, 56)]
    assert pii.find("in the year 1984 there were 12 of them and 300 more", model)[1] == []
    rows = spark.createDataFrame([(1, None, 0), (2, "mail bo.42@mail8.example.com, é +1 (980) 555-2833.", 50), (2, "plain", 5)], "doc_id bigint, text string, n_chars bigint")
    out = sorted((r.doc_id, r.text or "", r.n_chars) for r in pii.masked(rows, length="n_chars", model=model).collect())
    assert out == [(1, "", 0), (2, "mail [EMAIL], é [PHONE].", 24), (2, "plain", 5)]
    assert pii.scan(empty).count() == 0


def test_pii_finds_spelled_out_addresses_without_digits(spark):
    model = pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    for told in ("jane dot doe at mailhost dot com", "jane.doe (at) mailhost.com", "jane.doe [at] mailhost [dot] com"):
        text = f"please write to {told}, or ask for the others of the committee at home"
        assert pii.find(text, model)[1] == [("email", 16, 16 + len(told))], told
    assert pii.regions("we met at home and the dot was there") == []


def test_pii_regions_end_at_blanks():
    """The key word stands more than 48 characters before the first digit, and the word goes on after the last."""
    text = "plain words token = " + "a" * 60 + "1" + "b" * 60 + " " + "more plain words " * 5
    (found,) = pii.regions(text)
    assert found[0] <= 12 and found[1] >= 20 + 121
    assert all(text[a - 1 : a].strip() == "" and text[b : b + 1].strip() == "" for a, b in [found])


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    judged = quality.judge(docs, labels.where("doc_id % 2 = 0"))
    held = judged.join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("_keep").cast("int")).alias("kept")).collect()
    kept = {(r.quality, r.toxic): r.kept for r in held}
    assert kept[(1, 0)] > 0.99 and kept[(0, 0)] < 0.05 and kept[(1, 1)] < 0.1


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None), (None, "a b", "s", None)], "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1, None)], "doc_id bigint, quality int, toxic int")
    assert [r._keep for r in quality.judge(docs, labels).collect()] == [True, True]
    assert quality.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_site_means_shrink(spark):
    scored = spark.createDataFrame([("a", "x", 3.0)] * 50 + [("b", "x", -3.0)] * 50 + [("c", "x", 3.0)], "host string, path string, _odds_k double")
    got = {r.host: r._site_k for r in quality.site_posteriors(scored, ["host", "path"], ["k"]).collect()}
    assert got["b"] < 0 < got["c"] < got["a"]


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


def test_shingles_by_slices_are_those_of_the_whole(monkeypatch):
    import numpy as np
    import pyarrow as pa

    table = pa.table({"text": pa.chunked_array([["a b c d e f g a b c d e", None, "", "É é"], ["x " * 50, "1 2 3 4 5 6"]])})
    doc, name, weight, _, _ = near_dups.shingles(table, "text", 5)
    monkeypatch.setattr(near_dups, "SLICE_BYTES", 8)
    assert len(list(near_dups.slices(table, "text"))) > 3
    edges, names, weights = near_dups.sliced_shingles(table, "text", 5)
    assert np.array_equal(edges, np.searchsorted(doc, np.arange(table.num_rows + 1)))
    assert np.array_equal(names, name) and np.array_equal(weights, weight)


def test_near_dup_groups_go_by_bytes(spark):
    sizes = spark.createDataFrame([(1, 3 << 20), (2, 5)], "node bigint, bytes bigint")
    seats = spark.createDataFrame([(1,), (1,), (2,), (3,)], "a bigint")
    assert near_dups._bytes(seats, "a", sizes) == (6 << 20) + 5
    assert near_dups._bytes(seats.where("a > 5"), "a", sizes) == 0


def test_query_packs_are_bounded_and_floor_keeps_the_best(spark):
    import numpy as np
    import pyarrow as pa

    chosen = spark.range(5).selectExpr("id AS query", "sequence(1L, 100000L) AS names", "transform(sequence(1, 100000), x -> CAST(x AS DOUBLE)) AS idfs").coalesce(1)
    packs = search.packed_queries(chosen).collect()
    assert [p.words for p in packs] == [200_000, 200_000, 100_000] and len({p.pack for p in packs}) == 3
    assert [q for p in packs for q in search.from_body(p.body).column("query").to_pylist()] == [0, 1, 2, 3, 4]

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 40) % 60) for _ in range(400)]
    made = search._index(pa.table({"text": texts}))
    lists = search.Lists({c: np.asarray(made[c]) for c in ("name", "from", "doc", "tf", "length")}, 40.0, list(range(400)))
    names, idfs = made["name"], np.log(400 / np.diff(made["from"])) + 0.1
    best = lists.best(names, idfs, 10)
    for score, _ in best:
        kept = [x for x in lists.best(names, idfs, 10, score) if x[0] >= score]
        assert kept == [x for x in best if x[0] >= score]
    assert [x for x in lists.best(names, idfs, 10, best[0][0] + 1) if x[0] > best[0][0]] == []


@pytest.mark.parametrize("sizes", [{}, {"CELLS": 2_000, "CELLS_IN_BATCH": 2_500, "POSTS_AT_ONCE": 300, "STRETCHES_AT_ONCE": 1}])
def test_search_of_a_batch_equals_scoring_everything(monkeypatch, sizes):
    import numpy as np
    import pyarrow as pa

    for name, value in sizes.items():
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.2, int(rng.integers(0, 120))) % 3_000) for _ in range(300)]
    texts += texts[:40] + ["", "w1", "w1"]
    ids = [None if i % 17 == 3 else 1_000 - i for i in range(len(texts))]
    made = search._index(pa.table({"text": texts}))
    lists = search.Lists({c: np.asarray(made[c]) for c in ("name", "from", "doc", "tf", "length")}, 50.0, ids)
    assert 0 < len(lists.rows) < len(lists.names)
    names, idfs = np.r_[made["name"], np.uint64(7)], np.r_[np.log(400 / np.diff(made["from"])) + 0.1, 1.0]  # the last one in no document
    term = np.repeat(np.arange(len(lists.count)), lists.count)
    queries = [np.sort(np.r_[term[made["doc"] == d], len(names) - 1]) for d in range(0, len(texts), 5)]
    words, ends = np.concatenate(queries), np.cumsum([len(q) for q in queries])
    gains = np.zeros((len(names), len(texts)))
    gains[term, made["doc"]] = lists.gain
    expected = {}
    for q, query in enumerate(queries):
        scores = idfs[query] @ gains[query]
        hits = sorted((-round(float(s), 6), i) for s, i in zip(scores, ids, strict=True) if i is not None and s > 0)
        expected |= {q: [(-s, i) for s, i in hits[:10]]} if hits else {}
    none = np.full(len(queries), -math.inf)
    assert lists.best_of_each(names, idfs, words, ends, 10, none) == expected
    # floors may hide only what is below them
    floor = np.array([expected[q][len(expected[q]) // 2][0] if q in expected else 5.0 for q in range(len(queries))])
    got = lists.best_of_each(names, idfs, words, ends, 10, floor)
    for q, hits in expected.items():
        assert [x for x in got.get(q, []) if x[0] >= floor[q]] == [x for x in hits if x[0] >= floor[q]]
    beyond = lists.best_of_each(names, idfs, words, ends, 10, floor * 100)
    assert not any(s >= floor[q] * 100 for q, hits in beyond.items() for s, _ in hits)


def test_query_packs_hold_each_word_once(spark):
    chosen = spark.range(4).selectExpr("id AS query", "sequence(id, 1000L) AS names", "transform(sequence(id, 1000L), x -> CAST(x AS DOUBLE) / 8) AS idfs").coalesce(1)
    (pack,) = search.packed_queries(chosen).collect()
    terms, body = search.from_body(pack.terms).to_pydict(), search.from_body(pack.body).to_pydict()
    assert len(set(terms["name"])) == len(terms["name"]) == 1001
    assert all([terms["name"][w] for w in words] == list(range(q, 1001)) and [terms["idf"][w] * 8 for w in words] == list(range(q, 1001)) for q, words in zip(body["query"], body["words"], strict=True))
