"""Conversation repair against all edit sequences, a plain-string DP, and whole conversations in plain Python."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clipline.llm import conversation_audit as C

PATTERN = re.compile("(s?(ua)+)?")
ROWS = st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.integers(0, 3)), max_size=5)


def every_way(rows):
    """(cost, audit) by trying all edits, up to two inserts in each gap."""
    found = None
    inserts = [(k, "I" * k, "".join(x)) for k in range(3) for x in itertools.product("ua", repeat=k)]
    gaps = [[(3 * k, letters, roles) for k, letters, roles in inserts]]
    for role, fault in rows:
        extra = 3 if fault == 3 else 0
        ways = [(4, "D", "")]
        if fault not in (1, 2):
            ways += [(3 + extra, "R", "u"), (3 + extra, "R", "a")] + ([(extra, "K", role)] if role else [])
        gaps += [ways, gaps[0]]
    partial = {("", ""): 0}
    for ways in gaps:
        new = {}
        for (letters, roles), cost in partial.items():
            for c, le, ro in ways:
                if not re.fullmatch("s?(ua)*u?", roles + ro):
                    continue
                k = (letters + le, roles + ro)
                new[k] = min(new.get(k, 10**9), cost + c)
        partial = new
    for (letters, roles), cost in partial.items():
        if PATTERN.fullmatch(roles) and (found is None or (cost, letters) < found):
            found = (cost, letters)
    return found


@settings(max_examples=120, deadline=None)
@given(ROWS)
def test_cheapest_of_all(rows):
    assert C.cheapest(rows) == every_way(rows)


def plain_dp(rows):
    """The same DP with whole strings."""
    def with_inserts(best):
        for _ in range(2):
            for s, (c, w) in list(best.items()):
                best[C.NEXT[s]] = min(best.get(C.NEXT[s], (10**9, "")), (c + 3, w + "I"))
        return best

    best = with_inserts({0: (0, "")})
    for role, fault in rows:
        new, extra = {}, 3 if fault == 3 else 0
        for s, (c, w) in best.items():
            ways = [(s, 4, "D")]
            if fault not in (1, 2):
                ways.append((C.NEXT[s], 3 + extra, "R"))
                if (s, role) in C.STEPS:
                    ways.append((C.STEPS[s, role], extra, "K"))
            for to, k, letter in ways:
                new[to] = min(new.get(to, (10**9, "")), (c + k, w + letter))
        best = with_inserts(new)
    return min(best[s] for s in (0, 3) if s in best)


@pytest.mark.parametrize("base", [C._BASE, 0, 1])
def test_collisions_are_verified(base, monkeypatch):
    """With base 0 the hash is the last letter, with base 1 the sum of the letters: nearly all hashes collide."""
    monkeypatch.setattr(C.Audits.__init__, "__defaults__", (base,))
    rng = random.Random(base)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 60))]
        assert C.cheapest(rows) == plain_dp(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x"]), st.integers(0, 3)), max_size=24), st.integers(1, 4))
def test_blocks_fold_to_the_whole(rows, size):
    blocks = [rows[k : k + size] for k in range(0, len(rows), size)] or [[]]
    cost, states = C.fold([C.transitions(b) for b in blocks])
    got = "I" * {0: 0, 2: 1, 3: 2}[states[0]]
    for b, start, end in zip(blocks, states[:-1], states[1:], strict=True):
        audits = C.Audits()
        got += audits.text(C.walk(b, start, audits)[end][1])
    assert (cost, got) == plain_dp(rows)


def plain(table):
    """Results of whole conversations from (conv_id, turn, role, text)."""
    def text_of(x):
        return " " if x is None else str(x)

    out, convs = collections.Counter(), collections.defaultdict(list)
    for conv, turn, role, text in table:
        own, kind = convs[conv], zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else kind != 0)
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append(1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 3)
            seen.add((role, text))
        cost, audit = plain_dp([(r[1][:1], f) for r, f in zip(own, faults, strict=True)])
        lines, at, state = [], 0, 0
        for c in audit:
            if c == "K":
                state = C.STEPS[state, own[at][1][:1]]
                lines.append(own[at][1] + ":" + own[at][2])
            elif c != "D":
                state = C.NEXT[state]
                lines.append(C.ROLE_OF[state] + ":" + (own[at][2] if c == "R" else ""))
            at += c != "I"
        turns = {r[0] for r in own if r[0] is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        out[conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(1), faults.count(2), faults.count(3), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()] += 1
    return out


def result(frame):
    return collections.Counter(tuple(r) for r in frame.select("conv_id", *C.FIGURES, "audit", "repaired_sha256").collect())


def test_given_conversations(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    assert result(C.audit(table)) == plain(rows)


@pytest.mark.parametrize("block, parts", [(8192, 8), (3, 8), (1, 3), (40, 5)])
def test_odd_conversations(spark, block, parts):
    """One conversation with most rows, nulls in every column, ties, repeated rows, odd roles, empty and long texts, clashing names."""
    rng = random.Random(block)
    texts = ["Yes.", "no", "", " \n", "Why?", "a. b", "end! \t", "é.", None, "x" * 30_000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    rows = [(c, rng.choice([None, *range(40)]), rng.choice(roles), rng.choice(texts)) for c in [1] * 160 + [2, 3, 4, 5, None] * 6 + list(range(10, 40))]
    rows += [(7, 5, "user", "Same.")] * 3 + [(8, k, "user", "Same.") for k in range(30)]
    frame = spark.createDataFrame([(*r, "k", 0, True) for r in rows], "conv_id long, turn long, role string, text string, key string, fault int, done boolean").repartition(parts)
    assert result(C.audit(frame, block)) == plain(rows)


def test_text_ids_and_no_rows(spark):
    frame = spark.createDataFrame([("a", 0, "user", "Hi.")] * 2 + [(None, 1, "user", "Hi."), (" ", 1, "assistant", "Hi.")], "conv_id string, turn int, role string, text string")
    assert result(C.audit(frame)) == plain([tuple(r) for r in frame.collect()])
    assert C.audit(frame.limit(0)).collect() == []
