"""Conversation repair against an exhaustive search over edits."""

import hashlib
import heapq
import random
import zlib

import pytest

from lurescan.llm import conversations

SHAPE = "conv_id bigint, turn bigint, role string, text string, conv string, letter string, head int"
BLANKS = " \t\n\x0b\x0c\r"


def damage(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        if kind:
            yield from [(turn, role, text)] * (2 if kind == 3 else 1)


def cheapest(rows, faults):
    """(cost, audit, repaired rows) by a uniform-cost search over whole edit sequences, cheapest and then ASCII-least first."""
    heap, seen = [(0, "", 0, 0, ())], set()
    lead = {0: "su", 1: "u", 2: "a", 3: "u"}
    after = {"s": 1, "u": 2, "a": 3}
    name = {"u": "user", "a": "assistant"}
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, out
        if (i, state) in seen:
            continue
        seen.add((i, state))
        for initial in lead[state].replace("s", ""):
            heapq.heappush(heap, (cost + 2, audit + "I", i, after[initial], (*out, (name[initial], ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                if role[:1] and role[0] in lead[state]:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, after[role[0]], (*out, (role, text))))
                for initial in lead[state].replace("s", ""):
                    heapq.heappush(heap, (cost + cut + 2, audit + "R", i + 1, after[initial], (*out, (name[initial], text))))


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        kept = list(damage([r for r in rows if r[0] == conv]))
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in kept:
            body = text.rstrip(BLANKS)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        initials = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, fixed = cheapest(kept, faults)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "uncle"], ["Yes.", "So what?", "cut off", "", " \t\n", None, "é ß!", "No.  \n", "x" * 30_000 + "."]
    made = []
    for conv in range(120):
        for i in range(rng.randint(1, 9)):
            turn = None if rng.random() < 0.05 else i + rng.choice([0, 0, 0, 3])
            made.append((conv, turn, roles[(conv + i) % 2] if rng.random() < 0.7 else rng.choice(roles), rng.choice(texts)))
    made += [(None, None, None, None), (None, 3, "user", "Hm."), (None, 3, "user", "Hm."), (None, 3, "user", "Ah.")]
    made += [(500, i % 700, roles[i % 2], f"Row {i % 900}.") for i in range(3_000)]  # a long one with many ties and repeats
    made += [(c, t, "user", "Ends.") for c in range(1_000, 1_060) for t in (0,)]  # many share a signature, some lose their only row
    return made


def test_repair_equals_exhaustive_search(spark, rows):
    table = spark.createDataFrame([(*r, "c", "l", 1) for r in rows], SHAPE).repartition(5)
    got = conversations.repair(table).collect()
    want = expected(rows)
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want
    assert any(v[6] == "" and v[7] == hashlib.sha256(b"").hexdigest() for v in want.values())


def test_empty_table(spark):
    out = conversations.repair(spark.createDataFrame([], SHAPE))
    assert out.count() == 0 and out.columns[0] == "conv_id"


def test_nodes_are_shared():
    nodes = conversations.SharedSuffixes()
    signatures = sorted(("uaua", "suaua", "xua", "ua", "Uua", "a"), key=lambda s: s[::-1])
    assert [nodes.repair(s) for s in signatures] == [conversations.SharedSuffixes().repair(s) for s in signatures]
    assert nodes.built == len({s[i:] for s in signatures for i in range(len(s))})


def test_heavy_and_other_signatures_meet_their_audits(spark, monkeypatch, rows):
    monkeypatch.setattr(conversations, "HOT_SIGNATURES", 1)
    table = spark.createDataFrame([(*r, "c", "l", 1) for r in rows[:300]], SHAPE)
    want = expected(rows[:300])
    assert {r.conv_id: r.audit for r in conversations.repair(table).collect()} == {c: v[6] for c, v in want.items()}
