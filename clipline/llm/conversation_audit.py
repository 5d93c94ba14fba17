"""Conversation structure repair: the cheapest edits that give a conversation well-formed turns, by a persistent audit DP.

A walk over the rows keeps, for each state of the role pattern ``(s?(ua)+)?``, the least cost and the least audit (the edits' initials)
that reach it. Audits are linked nodes that share their prefixes: a node holds its letter, its parent, ancestors at powers of two and a
rolling hash of its whole string. Equal costs are settled by the longest common prefix, found by halving over the ancestors' hashes and
then verified letter by letter up to the common node.

A conversation is not bounded by a task. Rows are range-partitioned by (conversation, turn, role, text) and walked where they lie; a
conversation that lies inside one partition and has at most ``BLOCK`` rows is settled there. The others (two a partition at most, and the long
ones) are cut into blocks. A block gives the walk from every state to every state: costs, and how each two of its audits compare, also if
one begins with up to two more inserts. Of two audits over the same rows neither is the other's prefix but for inserts at the end, so
what follows never changes an order, and these small rows, folded in order, give the states at the borders of all blocks. Then
each block writes its own edits. Only the digest of a conversation needs its rows in one order: they stream through one task, none is held.

Cases: a null id, turn, role or text counts as one space where a string is needed, the null id is a conversation of its own; rows of equal turn are
taken by role and text; repeated rows are duplicates; an empty role has no initial and cannot be kept; very long texts pass through whole; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..session import cut_lineage

#: Costs of the edits, the share of damaged rows, the faults' order.
REROLE, DELETE, INSERT, TRUNCATED_KEPT, DAMAGES = 3, 4, 3, 3, 20
FAULTS = ("blank", "duplicate", "truncated")

START, SYSTEM, USER, ASSISTANT = range(4)
#: (state, role initial) -> next state
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: the state that an inserted or re-labelled row leads to
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ENDS = (START, ASSISTANT)
FAR = 1 << 60
BLOCK = 8192
SHIFTS = range(-2, 3)

_MOD, _BASE = (1 << 61) - 1, 1_000_003


class Audits:
    """Strings as linked nodes. Node 0 is the empty string."""

    def __init__(self, base: int = _BASE):
        self.base = base
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[]]

    def add(self, node: int, letter: str) -> int:
        new, up = len(self.letter), [node]
        while len(up) <= len(self.up[up[-1]]):
            up.append(self.up[up[-1]][len(up) - 1])
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.base + ord(letter)) % _MOD)
        self.up.append(up)
        return new

    def ancestor(self, node: int, depth: int) -> int:
        drop = self.depth[node] - depth
        while drop:
            k = drop.bit_length() - 1
            node = self.up[node][k]
            drop -= 1 << k
        return node

    def _parted(self, a: int, b: int) -> tuple[int, int]:
        """For different nodes of one depth, their first ancestors whose letters differ; equal strings give (0, 0)."""
        apart = (a, b)
        if self.hash[a] == self.hash[b]:
            apart = (0, 0)
        else:
            for k in range(max(len(self.up[a]) - 1, 0), -1, -1):
                if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                    a, b = self.up[a][k], self.up[b][k]
            apart = (a, b)
            a, b = self.up[a][0], self.up[b][0]
        # equal hashes are no proof: what they call equal is read up to the node that both share
        while a != b:
            if self.letter[a] != self.letter[b]:
                apart = (a, b)
            a, b = self.up[a][0], self.up[b][0]
        return apart

    def compare(self, a: int, b: int) -> int:
        """-1, 0 or 1 as the string of ``a`` is before, equal to or after that of ``b``."""
        if a == b:
            return 0
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if x != y:
            x, y = self._parted(x, y)
            if self.letter[x] != self.letter[y]:
                return -1 if self.letter[x] < self.letter[y] else 1
        return (self.depth[a] > depth) - (self.depth[b] > depth)

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def _better(audits: Audits, a: tuple[int, int], b: tuple[int, int] | None) -> bool:
    return b is None or a[0] < b[0] or (a[0] == b[0] and audits.compare(a[1], b[1]) < 0)


def _with_inserts(audits: Audits, best: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Up to two inserted rows after what was reached; a third would only lead back to a state at a higher cost."""
    best, latest = dict(best), best
    for _ in range(2):
        improved: dict[int, tuple[int, int]] = {}
        for state, (cost, node) in latest.items():
            to = NEXT[state]
            known = improved.get(to, best.get(to))
            if known is None or cost + INSERT <= known[0]:
                option = (cost + INSERT, audits.add(node, "I"))
                if _better(audits, option, known):
                    improved[to] = option
        best |= improved
        latest = improved
    return best


def walk(rows: list[tuple[str, int]], start: int, audits: Audits, before: bool = False) -> dict[int, tuple[int, int]]:
    """state -> (cost, audit) after ``rows`` of (role initial, fault), with inserts behind each row, and before the first one if asked for."""
    best = {start: (0, 0)}
    if before:
        best = _with_inserts(audits, best)
    for role, fault in rows:
        new: dict[int, tuple[int, int]] = {}
        kept = TRUNCATED_KEPT if fault == 3 else 0
        for state, (cost, node) in best.items():
            options = [(state, cost + DELETE, "D")]
            if fault not in (1, 2):
                options.append((NEXT[state], cost + REROLE + kept, "R"))
                if (state, role) in STEPS:
                    options.append((STEPS[state, role], cost + kept, "K"))
            for to, total, letter in options:
                if total <= new.get(to, (FAR, 0))[0]:
                    option = (total, audits.add(node, letter))
                    if _better(audits, option, new.get(to)):
                        new[to] = option
        best = _with_inserts(audits, new)
    return best


def cheapest(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    audits = Audits()
    best = walk(rows, START, audits, before=True)
    found = None
    for end in ENDS:
        if end in best and _better(audits, best[end], found):
            found = best[end]
    return found[0], audits.text(found[1])


#: how two audits compare: for good, or by the inserts that the second has more at its end
BEFORE, AFTER = -9, 9


def _relation(a: str, b: str) -> int:
    if b.startswith(a):
        return len(b) - len(a)
    if a.startswith(b):
        return len(b) - len(a)
    return BEFORE if a < b else AFTER


def transitions(rows: list[tuple[str, int]]) -> tuple[list[int], bytes]:
    """(costs, relations) of a block: by start * 4 + end, and by (way, way, shift) for two such ways.

    A positive shift puts so many inserts before the second audit, a negative one before the first.
    """
    ways: list[tuple[int, str] | None] = []
    for start in range(4):
        audits = Audits()
        best = walk(rows, start, audits)
        ways += [(best[e][0], audits.text(best[e][1])) if e in best else None for e in range(4)]
    relations = [
        _relation("I" * max(0, -k) + x[1], "I" * max(0, k) + y[1]) if x and y else 0 for x, y, k in itertools.product(ways, ways, SHIFTS)
    ]
    return [w[0] if w else FAR for w in ways], np.array(relations, np.int8).tobytes()


def fold(blocks: list[tuple[list[int], bytes]]) -> tuple[int, list[int]]:
    """(cost, the state before each block and after the last) on the cheapest way, ties by the least audit."""
    best = {START: 0, USER: INSERT, ASSISTANT: 2 * INSERT}
    inserted = {START: 0, USER: 1, ASSISTANT: 2}
    relation = {(x, y): inserted[y] - inserted[x] for x in best for y in best}
    came_from = []
    for costs, raw in blocks:
        table = np.frombuffer(raw, np.int8).reshape(16, 16, len(SHIFTS))

        def compared(x, e, y, f, table=table, relation=relation):
            r = relation[x, y]
            return r if r in (BEFORE, AFTER) else int(table[x * 4 + e, y * 4 + f, r + 2])

        came: dict[int, int] = {}
        for e, s in itertools.product(range(4), best):
            if costs[s * 4 + e] < FAR:
                gain = best[s] + costs[s * 4 + e] - (best[came[e]] + costs[came[e] * 4 + e] if e in came else FAR)
                if gain < 0 or (gain == 0 and compared(s, e, came[e], e) == BEFORE):
                    came[e] = s
        best, relation = {e: best[s] + costs[s * 4 + e] for e, s in came.items()}, {(e, f): compared(came[e], e, came[f], f) for e in came for f in came}
        came_from.append(came)
    ends = [e for e in ENDS if e in best]
    end = min(ends, key=lambda e: best[e])
    if len(ends) == 2 and best[ends[0]] == best[ends[1]]:
        end = ends[0] if relation[ends[0], ends[1]] in (BEFORE, 0, 1, 2) else ends[1]
    states = [end]
    for came in reversed(came_from):
        states.append(came[states[-1]])
    return best[end], states[::-1]


def edited(rows: list[tuple[str, str, int]], audit: str, state: int) -> list[tuple[str, list[str]]]:
    """For each row of (role, text, fault) its letters and the lines they give; inserts before the first row go with it."""
    out, at = [], 0
    for letter in audit:
        new = letter != "I"
        if new and at:
            out.append(("", []))
        if not out:
            out.append(("", []))
        lines = out[-1][1]
        if letter == "K":
            role, text, _ = rows[at]
            state = STEPS[state, role[:1]]
            lines.append(f"{role}:{text}")
        elif letter != "D":
            state = NEXT[state]
            lines.append(f"{ROLE_OF[state]}:{rows[at][1] if new else ''}")
        out[-1] = (out[-1][0] + letter, lines)
        at += new
    return out


class Tally:
    """The figures of one conversation, row by row in order."""

    def __init__(self):
        self.n, self.counts, self.illegal, self.last = 0, [0, 0, 0, 0], 0, None
        self.turns, self.least, self.greatest = 0, None, None

    def row(self, turn, role: str, fault: int) -> None:
        self.counts[fault] += 1
        if self.n and self.last + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last, self.n = role[:1], self.n + 1
        if turn is not None:
            self.turns += turn != self.greatest
            self.least, self.greatest = turn if self.least is None else self.least, turn

    def figures(self) -> dict:
        gaps = 0 if self.least is None else self.greatest - self.least + 1 - self.turns
        return {"gaps": gaps, **dict(zip(FAULTS, self.counts[1:], strict=True)), "illegal": self.illegal}


FIGURES = ("gaps", *FAULTS, "illegal", "cost")
_RESULT = ", ".join(f"{c} long" for c in FIGURES) + ", audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, with those that it drops as ``gone``: conv_id, key (never null), turn, role, text, gone."""
    space = F.lit(" ")
    own = conversations.select(
        "conv_id", F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("v"), F.coalesce(F.col("conv_id").cast("string"), space)).alias("key"),
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
    )
    kind = F.crc32(F.concat(F.substring("key", 2, 1 << 30), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % DAMAGES
    own = own.withColumn("kind", kind).withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("kind") < 2, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return own.select("conv_id", "key", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault``: 0 none, 1 blank, 2 duplicate, 3 truncated, -1 gone."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = rows.withColumn("fault", F.when(F.col("gone"), -1).when(blank, 1).when(~whole, 3).otherwise(0))
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("place", F.struct("turn", F.monotonically_increasing_id()))
    same = ["key", "role", "digest"]
    first = rows.where(F.col("fault").isin(0, 3)).groupBy(*same).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    again = F.col("fault").isin(0, 3) & F.col("first").isNotNull() & (F.col("place") != F.col("first"))
    return rows.join(first.drop("n"), same, "left").select("conv_id", "key", "turn", "role", "text", F.when(again, 2).otherwise(F.col("fault")).alias("fault"))


def _settled(own: list[dict]) -> dict:
    """The result of a whole conversation."""
    tally, rows = Tally(), [(r["role"], r["text"], r["fault"]) for r in own if r["fault"] >= 0]
    for r in own:
        if r["fault"] >= 0:
            tally.row(r["turn"], r["role"], r["fault"])
    cost, audit = cheapest([(role[:1], fault) for role, _, fault in rows])
    text = "\n".join(line for _, lines in edited(rows, audit, START) for line in lines)
    return tally.figures() | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


def _walk_partition(batches, block, schema):
    """Settle what lies inside the partition; give the rows of the other conversations their places."""
    part, out, own, key, inside, n = TaskContext.get().partitionId(), [], [], None, False, 0

    def place(rows):
        nonlocal n
        for r in rows:
            out.append(r | {"done": False, "part": part, "block": n // block, "pos": n})
            n += 1

    for batch in batches:
        for r in batch.to_pylist():
            if r["key"] != key:
                if inside and own:
                    out.append({"conv_id": own[0]["conv_id"], "key": key, "done": True} | _settled(own))
                inside, own, n = key is not None, [], 0
                key = r["key"]
            if inside and len(own) < block:
                own.append(r)
            else:
                place([*own, r])
                inside, own = False, []
        yield pa.RecordBatch.from_pylist(out, schema)
        out = []
    place(own)
    yield pa.RecordBatch.from_pylist(out, schema)


def _rows_of(group: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[str, str, int]]]:
    group = group[group["fault"] >= 0].sort_values("pos")
    return group, list(zip(group["role"], group["text"], group["fault"].astype(int), strict=True))


def _block_transitions(group: pd.DataFrame) -> pd.DataFrame:
    _, rows = _rows_of(group)
    costs, relations = transitions([(role[:1], fault) for role, _, fault in rows])
    return pd.DataFrame([(*group.iloc[0][["key", "part", "block"]], costs, relations)], columns=["key", "part", "block", "costs", "relations"])


def _borders(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["part", "block"])
    cost, states = fold(list(zip(group["costs"], group["relations"], strict=True)))
    return group[["key", "part", "block"]].assign(start=states[:-1], end=states[1:], head=[True, *[False] * (len(group) - 1)], cost=cost)


def _block_edits(group: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block with their letters and lines; rows that the damage dropped have none."""
    own, rows = _rows_of(group)
    start, end, head = (group.iloc[0][c] for c in ("start", "end", "head"))
    audits = Audits()
    best = walk([(role[:1], fault) for role, _, fault in rows], start, audits)
    audit = audits.text(best[end][1])
    if head:
        audit, start = "I" * {START: 0, USER: 1, ASSISTANT: 2}[start] + audit, START
    got = edited(rows, audit, start)
    group = group.sort_values("pos").assign(letters="", lines=None)
    # inserts at the head of a block whose rows are all gone go with its first row
    at = own.index if len(own) else group.index[:1]
    for k, (letters, lines) in zip(at, got, strict=False):
        group.at[k, "letters"] = letters
        group.at[k, "lines"] = "\n".join(lines) if lines else None
    return group[["conv_id", "key", "part", "pos", "turn", "role", "fault", "cost", "letters", "lines"]]


def _finish_partition(batches, schema):
    """Conversations sorted by place, row by row: figures, the audit, the digest of the lines."""
    key, first, tally, letters, digest, lines = None, None, None, [], None, 0

    def result():
        return {"conv_id": first["conv_id"]} | tally.figures() | {"cost": first["cost"], "audit": "".join(letters), "repaired_sha256": digest.hexdigest()}

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["key"] != key:
                if key is not None:
                    out.append(result())
                key, first, tally, letters, digest, lines = r["key"], r, Tally(), [], hashlib.sha256(), 0
            if r["fault"] >= 0:
                tally.row(r["turn"], r["role"], r["fault"])
            letters.append(r["letters"])
            if r["lines"] is not None:
                digest.update((("\n" if lines else "") + r["lines"]).encode())
                lines += 1
        yield pa.RecordBatch.from_pylist(out, schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([result()], schema)


def audit(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation after damage."""
    rows = with_faults(damaged(conversations))
    order = ["key", "turn", "role", "text"]
    lying = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    conv_id = StructType([StructField("conv_id", conversations.schema["conv_id"].dataType)])

    def typed(ddl):
        return StructType([*conv_id.fields, *StructType.fromDDL(ddl).fields])

    walked = typed("key string, done boolean, part int, block long, pos long, turn long, role string, text string, fault int, " + _RESULT)
    result = typed(_RESULT)
    arrow, result_arrow = to_arrow_schema(walked), to_arrow_schema(result)
    held = cut_lineage(lying.mapInArrow(lambda batches: _walk_partition(batches, block, arrow), walked))
    apart = held.where(~F.col("done")).select("conv_id", "key", "part", "block", "pos", F.col("turn").cast("string").alias("turn"), "role", "text", "fault")
    where = ["key", "part", "block"]
    small = apart.groupBy(*where).applyInPandas(_block_transitions, "key string, part int, block long, costs array<bigint>, relations binary")
    borders = small.groupBy("key").applyInPandas(_borders, "key string, part int, block long, start int, end int, head boolean, cost long")
    edits = apart.join(borders, where).groupBy(*where).applyInPandas(
        _block_edits, typed("key string, part int, pos long, turn string, role string, fault int, cost long, letters string, lines string")
    )
    in_order = edits.withColumn("turn", F.col("turn").cast("long")).repartition("key").sortWithinPartitions("key", "part", "pos")
    streamed = in_order.mapInArrow(lambda batches: _finish_partition(batches, result_arrow), result)
    return held.where("done").select(*result.names).unionByName(streamed)
