"""Filter audit against one pass over the rows per order."""

import collections
import random
import re
from itertools import permutations

from lurescan.llm import filter_audit

SHAPE = "doc_id bigint, text string, lang string, part string, key string, mask int"
LABELS = "doc_id bigint, quality int, toxic int, good int"
BLANKS = "[\x20\x09-\x0d]+"


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    fails = []
    for i, text, lang in rows:
        t = text or ""
        w = [x for x in re.split(BLANKS, t) if x]
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        fails.append((lang or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out = collections.defaultdict(collections.Counter)
    for order in map("".join, permutations("ABCDE")):
        for part, failed, is_good, is_toxic in fails:
            gone = False
            for step, filter_ in enumerate(order, 1):
                c = out[part, order, step]
                c["removed"] += not gone and filter_ in failed
                c["good_lost"] += not gone and filter_ in failed and is_good
                c["toxic_lost"] += not gone and filter_ in failed and is_toxic
                c["redundant"] += gone and filter_ in failed
                c["unique_fails"] += failed == {filter_}
                gone |= filter_ in failed
                c["kept"] += not gone
    share = collections.Counter()
    for (part, order, step), c in out.items():
        share[part, order[step - 1]] += c["removed"]
    return {(p, o, s): (*(c[x] for x in filter_audit.COUNTS), share[p, o[s - 1]]) for (p, o, s), c in out.items()}


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "A", "few words", "a b " * 150, " ".join(map(str, range(250))), " ".join(f"w{i}" for i in range(201)) + " #", "É Ü " * 300, "UP " * 10, "x" * 200_000, "\x0b\x0c1 2 ", "ünï " + " ".join(f"q{i}" for i in range(230)) + " $ SHOUT" * 9]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(120)]
    rows += [(None, "few words", "en"), (None, "few words", "en"), (7, "few words", "xx"), (7, "few words", "xx"), (-5, "only here", "en"), (-5, "only here", "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(*r, "p", "k", 1) for r in rows], SHAPE).repartition(3)
    got = filter_audit.audit(docs, spark.createDataFrame([(*x, 0) for x in labels], LABELS)).collect()
    want = brute(rows, labels)
    assert len(got) == len(want) == 600 * len({(r[2] or "") for r in rows})
    assert {(r.part, r.filter_order, r.step): (*(r[c] for c in filter_audit.COUNTS), r.shapley) for r in got} == want
    assert filter_audit.audit(docs, spark.createDataFrame([], LABELS)).where("good_lost + toxic_lost > 0").count() == 0


def test_empty_table(spark):
    assert filter_audit.audit(spark.createDataFrame([], SHAPE), spark.createDataFrame([], LABELS)).count() == 0
