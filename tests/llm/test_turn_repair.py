"""Conversation repair against a plain search from the end, on awkward and very long conversations."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from waypost.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, piece string, stretch int"
BLANK = " \t\n\x0b\x0c\r"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def broken(rows):
    """The damage, by the words of the contract, of rows (conv_id, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        role, text = (" " if x is None else x for x in (role, text))
        harm = zlib.crc32(":".join(shown).encode()) % 20
        if harm == 1:
            text = ""
        if harm == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv, turn, "user" if harm == 4 else role, text)] * {0: 0, 3: 2}.get(harm, 1)
    return out


def mended(rows):
    """(facts, repaired rows) of the (turn, role, text) rows of one conversation."""
    rows = sorted(
        rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    )
    faults, seen = [], set()
    for _, role, text in rows:
        whole = text.rstrip(BLANK)
        faults.append("blank" if not whole else "duplicate" if (role, text) in seen else "" if whole[-1] in ".!?" else "truncated")
        seen.add((role, text))

    @functools.cache
    def best(i, said, run):
        """Least (cost, audit, repaired rows) from row ``i`` on, after the role initial ``said`` and ``run`` insertions."""
        ways = []
        follows = lambda x: {"": "su", "s": "u", "u": "a", "a": "u"}[said].find(x) >= 0 and x != ""

        def take(cost, letter, state, row, j, run=0):
            rest = best(j, state, run)
            if rest:
                ways.append((cost + rest[0], letter + rest[1], (row, *rest[2]) if row else rest[2]))

        for x, name in (("u", "user"), ("a", "assistant")):
            if run < 3 and follows(x):
                take(3, "I", x, (name, ""), i, run + 1)
        if i == len(rows):
            if said in ("", "a"):
                ways.append((0, "", ()))
            return min(ways, default=None)
        _, role, text = rows[i]
        take(4, "D", said, None, i + 1)
        if faults[i] not in ("blank", "duplicate"):
            late = 3 * (faults[i] == "truncated")
            if follows(role[:1]):
                take(late, "K", role[0], (role, text), i + 1)
            for x, name in (("u", "user"), ("a", "assistant")):
                if follows(x):
                    take(3 + late, "R", x, (name, text), i + 1)
        return min(ways, default=None)

    cost, audit, kept = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    facts = (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
        faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    )
    return facts, list(kept)


def conversations(seed, n, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for _ in range(rng.randint(0, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "s", "unknown"])
            text = rng.choice(["Yes.", "No", "  ", "", None, "What?\n", "Well!\u0085", "Go on.", "é…", "Two. Three"])
            rows.append((conv if conv % 17 else None, rng.choice([None, *range(most)]), role, text))
    return rows


def by_conversation(rows):
    groups = {}
    for conv, *rest in rows:
        groups.setdefault(conv, []).append(tuple(rest))
    return groups


def found(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_equals_a_search_from_the_end(spark):
    rows = conversations(1, 300, 9)
    got = found(turn_repair.repair(turn_repair.damaged(table(spark, rows)), F.col("present")))
    want = dict.fromkeys({r[0] for r in rows}, (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
    want |= {conv: mended(own)[0] for conv, own in by_conversation(broken(rows)).items()}
    assert got == want


@pytest.mark.parametrize("rows_a_piece", [1, 3])
def test_pieces_chain(spark, monkeypatch, rows_a_piece):
    """Conversations of many stretches, and stretches of many pieces, are repaired as one."""
    rows = [(conv, None if turn is None else turn * 40, role or "", text or "") for conv, turn, role, text in conversations(2, 40, 14)]
    walk = turn_repair._walked

    def short(batches):
        turn_repair.ROWS = rows_a_piece
        return walk(batches)

    monkeypatch.setattr(turn_repair, "_walked", short)
    got = found(turn_repair.repair(table(spark, rows)))
    assert got == {conv: mended(own)[0] for conv, own in by_conversation(rows).items()}


def test_repaired_rows(spark):
    rows = [(c, t, r or "", x or "") for c, t, r, x in conversations(3, 60, 8)]
    got = {}
    for r in turn_repair.repaired(table(spark, rows)).orderBy("conv_id", "position").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    want = {conv: mended(own)[1] for conv, own in by_conversation(rows).items()}
    assert got == {conv: kept for conv, kept in want.items() if kept}


def test_long_and_hot_conversation(spark):
    """One conversation with nearly all rows, of which two thirds repeat, and one text of megabytes."""
    rows = [(1, i, ("user", "assistant")[i % 2], f"{i % 2000}.") for i in range(6000)]
    rows += [(2, 0, "user", "x" * 3_000_000 + "."), (2, 1, "assistant", " " * 1_000_000), (3, None, "user", "a")]
    got = found(turn_repair.repair(table(spark, rows)))
    assert got[1][:7] == (0, 0, 4000, 0, 0, 16000, "K" * 2000 + "D" * 4000)
    assert got[2][:7] == (0, 1, 0, 0, 0, 7, "KDI") and got[3][5:7] == (4, "D")


def test_empty_tables(spark):
    none = table(spark, [(1, 1, "user", "a.")]).limit(0)
    assert turn_repair.repair(none).collect() == [] and turn_repair.repaired(none).collect() == []


def test_texts_are_shuffled_once(spark):
    plan = turn_repair.repair(table(spark, [(1, 1, "user", "a.")]))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 3 and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
