"""Queries opN_<name>: each operator with production settings over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_bpe, conversations, decontaminate, filter_audit, licenses, near_dups, ngram_lm, pii, quality, repeats, search, warc

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    label = F.transform("base", lambda x: x["label"])
    every = F.concat(label, F.transform("found", lambda x: x["label"]))
    start = F.transform("base", lambda x: x["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(label)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("labels"),
        "score",
    )


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep_text=False)
    return judged.select("doc_id", F.round("_p_junk", 6).alias("p_junk"), F.round("_p_toxic", 6).alias("p_toxic"), F.col("_keep").alias("keep"))


def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_lm.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "n_backoff", F.round("score", 3).alias("score"), F.round("mean_score", 5).alias("mean_score"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated(table(spark, sf_dir, "documents"), with_text=False)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"))

    def written(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.BASE), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), vocabulary(RANKS))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return encoded.select("doc_id", "n_tokens", ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_search, op3_licenses, op4_near_dups, op5_quality, op6_ngram_lm, op7_bpe, op8_decontaminate, op9_repeats, op10_pii, op11_conversations, op12_byte_bpe, op13_filter_audit)}

_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

# of op11's fold: per grammar state (nothing yet, after s, after u, after a; from 1) the least (cost, audit) of a suffix
_EDITS = [
    [f"{{'c': acc[{q}].c + 3, 'a': 'D' || acc[{q}].a}}"]
    + [f"{{'c': CASE WHEN lower(x) = '{own}' THEN acc[{to}].c + (x <> lower(x))::INT ELSE 1000000 END, 'a': 'K' || acc[{to}].a}}" for own, to in keeps]
    + [f"{{'c': CASE WHEN x IN ('x', 'y') THEN 1000000 ELSE acc[{to}].c + 2 + (x <> lower(x))::INT END, 'a': 'R' || acc[{to}].a}}" for to in (4 if q == 3 else 3,)]
    for q, keeps in ((1, [("s", 2), ("u", 3)]), (2, [("u", 3)]), (3, [("a", 4)]), (4, [("u", 3)]))
]
_INSERTS = ", ".join(
    "list_min([" + ", ".join(f"{{'c': b[{at}].c + {2 * i}, 'a': '{'I' * i}' || b[{at}].a}}" for i, at in enumerate(path)) + "])"
    for path in ((1, 3, 4), (2, 3, 4), (3, 4, 3), (4, 3, 4))
)
_FOLD = f"list_transform([[{', '.join('list_min([' + ', '.join(e) + '])' for e in _EDITS)}]], lambda b: [{_INSERTS}])[1]"

ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
        k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes,
          array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            ((('0x' || substr(hex || '00', ((5 * i) // 4 + 1)::BIGINT, 3))::INTEGER >> (7 - (5 * i) % 4)::INTEGER) & 31) + 1, 1)), '') AS payload_digest,
          CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN page_id < keeper THEN keeper END AS refers_to, true AS verified
        FROM k""",
    "op2_search": f"""
        WITH w AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents),
        len AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
        stat AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS docs, (SELECT count(*) FROM w)::DOUBLE / (SELECT count(*) FROM documents) AS mean),
        tf AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY 1, 2),
        df AS (SELECT word, round(ln(1 + ((SELECT docs FROM stat) - count(*) + 0.5) / (count(*) + 0.5)), 9) AS idf FROM tf GROUP BY 1 HAVING count(*) > 1),
        q AS (SELECT tf.doc_id AS query_id, word, idf FROM tf JOIN df USING (word) WHERE tf.doc_id % 20 = 0),
        s AS (SELECT query_id, tf.doc_id, round(sum(idf * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * len.n / stat.mean))), 6) AS score
          FROM q JOIN tf USING (word) JOIN len ON len.doc_id = tf.doc_id, stat GROUP BY 1, 2)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10""",
    "op6_ngram_lm": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        t AS (SELECT doc_id, unnest(w) AS c, unnest(list_concat([NULL], w[:-2])) AS b, unnest(list_concat([NULL, NULL], w[:-3])) AS a FROM d WHERE len(w) > 2
          UNION ALL SELECT doc_id, w[1], NULL, NULL FROM d WHERE len(w) IN (1, 2) UNION ALL SELECT doc_id, w[2], w[1], NULL FROM d WHERE len(w) = 2),
        u AS (SELECT c, count(*) AS n FROM t GROUP BY 1), total AS (SELECT count(*)::DOUBLE AS n FROM t),
        bi AS (SELECT b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY 1, 2),
        tri AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY 1, 2, 3),
        s AS (SELECT doc_id,
          CASE WHEN tri.n >= 2 THEN ln(tri.n::DOUBLE / hb.n)
               WHEN bi.n >= 2 THEN (CASE WHEN t.a IS NULL THEN 0 ELSE ln(0.4) END) + ln(bi.n::DOUBLE / hu.n)
               ELSE (CASE WHEN t.b IS NULL THEN 0 WHEN t.a IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END) + ln(u.n / total.n) END AS score,
          CASE WHEN t.a IS NOT NULL THEN coalesce(tri.n, 0) < 2 WHEN t.b IS NOT NULL THEN coalesce(bi.n, 0) < 2 ELSE false END AS low
          FROM t JOIN u USING (c) LEFT JOIN bi ON bi.b = t.b AND bi.c = t.c LEFT JOIN tri ON tri.a = t.a AND tri.b = t.b AND tri.c = t.c
          LEFT JOIN bi hb ON hb.b = t.a AND hb.c = t.b LEFT JOIN u hu ON hu.c = t.b, total),
        g AS (SELECT doc_id, count(*) AS n, sum(low::INTEGER) AS low, sum(score) AS score FROM s GROUP BY 1)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(low, 0)::BIGINT AS n_backoff, round(coalesce(score, 0.0), 3) AS score, round(score / n, 5) AS mean_score
        FROM documents LEFT JOIN g USING (doc_id)""",
    "op8_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        bw AS (SELECT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS gram FROM b WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram FROM d, sizes WHERE len(w) >= n),
        h AS (SELECT DISTINCT doc_id, p, dw.n, item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.gram = dw.gram),
        c AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM (SELECT doc_id, p, unnest(range(0, n)) AS k FROM h) GROUP BY 1),
        i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
          coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY 1),
        m AS (SELECT part, (len(w) < 200)::INTEGER + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INTEGER
            + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INTEGER + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER
            + 16 * coalesce(w.doc_id > first, false)::INTEGER AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
          FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
        c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
        f AS (SELECT unnest([1, 2, 4, 8, 16]) AS bit, unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
        o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
          FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
        s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[:step]) AS upto FROM o, range(1, 6) r(step)),
        x AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & upto = 0 THEN n ELSE 0 END) AS kept,
            sum(CASE WHEN mask & upto = bit THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN mask & bit > 0 AND mask & upto <> bit THEN n ELSE 0 END) AS redundant,
            sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN mask & upto = bit AND good = 1 THEN n ELSE 0 END) AS good_lost,
            sum(CASE WHEN mask & upto = bit AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
          FROM c, s GROUP BY ALL)
        SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
          unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
          sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
        FROM x""",
    "op11_conversations": rf"""
        WITH crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS t),
        k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT),
              lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind FROM conversations, crc),
        r AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE kind <> 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM r),
        l AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'o' END AS own,
            lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM n),
        f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'x' WHEN nth > 1 THEN 'y'
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN upper(own) ELSE own END AS letter FROM l),
        g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (letter = 'x') AS blank, count(*) FILTER (letter = 'y') AS duplicate,
            count(*) FILTER (letter <> lower(letter)) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
            list_reduce(list(letter ORDER BY pos DESC), lambda acc, x: {_FOLD},
              [{{'c': 0, 'a': ''}}, {{'c': 4, 'a': 'II'}}, {{'c': 2, 'a': 'I'}}, {{'c': 0, 'a': ''}}])[1] AS best
          FROM f GROUP BY conv_id),
        e AS (SELECT conv_id, best.a AS audit, unnest(string_split(best.a, '')) AS edit, unnest(range(1, length(best.a) + 1)) AS place FROM g),
        p AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY place) AS pos FROM e),
        o AS (SELECT p.conv_id, place, edit, role, text, initial, row_number() OVER (PARTITION BY p.conv_id ORDER BY place) - 1 AS j FROM p LEFT JOIN f
          ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos AND edit <> 'I' WHERE edit <> 'D'),
        h AS (SELECT *, first_value((edit = 'K' AND initial = 's')::INT) OVER (PARTITION BY conv_id ORDER BY place) AS leads FROM o),
        w AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - leads) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY place)) AS sha FROM h GROUP BY 1)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
          coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id""",
}
