"""Cheapest repair of conversations whose turns are out of order, doubled, blank or cut off.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``. The
four states of that grammar are all that a repair has to remember, so the work
splits by stretches of turns: ``_stretches`` takes stretches of ``STRETCH``
turn numbers, hash-partitioned by conversation and stretch. In each batch one
recursive DuckDB query advances a row a recursion for all stretches of the
batch, and keeps for each grammar state a stretch may begin in, and each it may
be in by then, the minimum cost and of the cheapest audits the least one.
``_Course`` chains the stretches of a conversation in order. Rows with the
same number of turns are never prefixes of each other's audits, so the order
of audits at a stretch's start decides the order of whatever follows.

Only counts, states and audits travel so far, no texts: these meet the audit
once, in one shuffle by conversation, and stream by in order. What a task keeps
is a batch of stretches, or one conversation's audit; a conversation that holds
a large part of all rows is spread over the tasks by its stretches, and only
its texts pass through one task, as a hash over them in order has to.

Rows are ordered by turn (nulls first), role and the SHA-256 of their text; that
defines ties. A null role or text counts as one space. Rows without conv_id are
one conversation. Repeated rows are duplicates. Further columns are ignored.
Empty tables give empty results. A stretch whose rows share one turn is cut
after ``ROWS`` rows, so that no recursion is longer.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Costs of the edits, blank characters and what ends a whole text.
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
_BLANK, _ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: Turn numbers of a stretch (a power of two), rows of a stretch's piece, rows of a batch.
STRETCH, ROWS, BATCH = 64, 64, 8192
#: States: nothing yet, after the system message, after a user's, after an assistant's; those it may end in come at no cost.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {
    (_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER
}
_CLOSING = {_START: 0, _SYSTEM: 2, _USER: 1, _ASSISTANT: 0}
_ROLES = {"u": "user", "a": "assistant"}


def _inserted(state: int) -> Iterator[tuple[int, int]]:
    """(number of insertions, state after them): at most two, as a third would only lead back."""
    yield 0, state
    for n in (1, 2):
        state = _NEXT.get((state, "u"), _NEXT.get((state, "a")))
        yield n, state


def _moves() -> list[tuple[int, str, int, str, int, bool]]:
    """(state, initial, state after, letters, cost, whether the row stays); the initial ``d`` has to go, ``x`` is no known role.

    What is inserted beside a deleted row goes after it, which costs the same and is the lesser audit.
    """
    out = []
    for state, initial in itertools.product(range(4), "suaxd"):
        out.append((state, initial, state, "D", DELETE, False))
        for n, then in _inserted(state) if initial != "d" else ():
            ways = [("K", 0, initial), *(("R", REROLE, role) for role in "ua" if role != initial)]
            out += [
                (state, initial, _NEXT[then, role], "I" * n + letter, INSERT * n + cost, True)
                for letter, cost, role in ways if (then, role) in _NEXT
            ]
    return out


_WALK = f"""
WITH RECURSIVE walk(piece, i, origin, state, cost, audit) AS (
  SELECT piece, 0::BIGINT, origin, origin, 0::BIGINT, '' FROM (SELECT DISTINCT piece FROM turns), (VALUES (0), (1), (2), (3)) origins(origin)
  UNION ALL
  SELECT piece, i, origin, state, best.cost, best.audit FROM (
    SELECT turns.piece AS piece, turns.i AS i, walk.origin AS origin, moves.state_after AS state,
      min({{'cost': walk.cost + moves.cost + CASE WHEN moves.stays THEN turns.extra ELSE 0 END, 'audit': walk.audit || moves.letters}}) AS best
    FROM walk JOIN turns ON turns.piece = walk.piece AND turns.i = walk.i + 1 JOIN moves ON moves.state = walk.state AND moves.initial = turns.initial
    GROUP BY ALL
  )
)
SELECT piece, origin, state, cost, audit FROM walk JOIN (SELECT piece, max(i) AS i FROM turns GROUP BY piece) USING (piece, i)
"""

_PATHS = pa.list_(
    pa.struct([("origin", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
)
_PIECE = pa.schema(
    [
        ("conv_id", pa.int64()), ("stretch", pa.int64()), ("nth", pa.int64()), ("first", pa.string()), ("last", pa.string()),
        ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("faults", pa.list_(pa.int64())),
        ("illegal", pa.int64()), ("paths", _PATHS)
    ]
)
_PIECE_SQL = "conv_id long, stretch long, nth long, first string, last string, low long, high long, turns long, faults array<long>, illegal long, paths array<struct<origin: int, state: int, cost: long, audit: string>>"
_LEGAL = {"su", "ua", "au"}


def _pieces(rows: Iterator[tuple]) -> Iterator[tuple[dict, list[tuple[str, int]]]]:
    """(facts of a piece, its rows as initial and extra cost) of rows (conv_id, stretch, turn, initial, fault) in order."""
    for (conv_id, stretch), own in itertools.groupby(rows, key=itemgetter(0, 1)):
        nth, before = 0, None
        while cut := list(itertools.islice(own, ROWS)):
            turns = [turn for _, _, turn, _, _ in cut if turn is not None]
            initials = [initial for *_, initial, _ in cut]
            faults = [fault for *_, fault in cut]
            yield {
                "conv_id": conv_id, "stretch": stretch, "nth": nth, "first": initials[0], "last": initials[-1],
                "low": turns[0] if turns else None, "high": turns[-1] if turns else None,
                "turns": sum(a != b for a, b in itertools.pairwise([before, *turns])),
                "faults": [faults.count(i) for i in (1, 2, 3)],
                "illegal": sum(a + b not in _LEGAL for a, b in itertools.pairwise(initials))
            }, [
                ("d" if fault in (1, 2) else initial if initial in ("s", "u", "a") else "x", UNFINISHED * (fault == 3))
                for initial, fault in zip(initials, faults, strict=True)
            ]
            nth, before = nth + 1, turns[-1] if turns else before


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest ways through each piece, by one recursive query a batch."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    con.execute("CREATE TABLE moves(state INT, initial VARCHAR, state_after INT, letters VARCHAR, cost BIGINT, stays BOOLEAN)")
    con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", _moves())

    def solved(facts: list[dict], turns: list[tuple[int, int, str, int]]) -> pa.RecordBatch:
        piece, i, initial, extra = zip(*turns, strict=True)
        con.register(
            "turns", pa.table({"piece": pa.array(piece, pa.int64()), "i": pa.array(i, pa.int64()), "initial": initial, "extra": pa.array(extra, pa.int64())})
        )
        for fact in facts:
            fact["paths"] = []
        for at, origin, state, cost, audit in con.execute(_WALK).fetchall():
            facts[at]["paths"].append({"origin": origin, "state": state, "cost": cost, "audit": audit})
        con.unregister("turns")
        return pa.RecordBatch.from_pylist(facts, schema=_PIECE)

    facts, turns = [], []
    for fact, rows in _pieces(_rows(batches)):
        turns += [(len(facts), i, initial, extra) for i, (initial, extra) in enumerate(rows, 1)]
        facts.append(fact)
        if len(turns) >= BATCH:
            yield solved(facts, turns)
            facts, turns = [], []
    if facts:
        yield solved(facts, turns)
    con.close()


class _Course:
    """The pieces of one conversation, chained in order."""

    def __init__(self) -> None:
        #: By state: cost, rank of its audit among the states', and the audit as a linked list of pieces, the last first.
        self.states: dict[int, tuple[int, int, tuple | None]] = {_START: (0, 0, None)}
        self.faults, self.illegal, self.turns, self.low, self.high, self.last = [0, 0, 0], 0, 0, None, None, None

    def add(self, piece: dict) -> None:
        best: dict[int, tuple] = {}
        for path in piece["paths"]:
            if (held := self.states.get(path["origin"])) is None:
                continue
            way = (held[0] + path["cost"], held[1], path["audit"], held[2])
            if path["state"] not in best or way[:3] < best[path["state"]][:3]:
                best[path["state"]] = way
        order = sorted(best, key=lambda state: best[state][1:3])
        self.states = {
            state: (best[state][0], rank, (best[state][3], best[state][2])) for rank, state in enumerate(order)
        }
        self.faults = [a + b for a, b in zip(self.faults, piece["faults"], strict=True)]
        self.illegal += piece["illegal"] + (self.last is not None and self.last + piece["first"] not in _LEGAL)
        self.last = piece["last"]
        self.turns += piece["turns"]
        if piece["low"] is not None:
            self.low, self.high = piece["low"] if self.low is None else self.low, piece["high"]

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def end(self) -> tuple[int, str]:
        """Cost and audit of the cheapest way that ends well."""
        cost, _, closing, link = min(
            ((cost + INSERT * _CLOSING[state], rank, "I" * _CLOSING[state], link) for state, (cost, rank, link) in self.states.items()),
            key=itemgetter(0, 1, 2)
        )
        parts = [closing]
        while link is not None:
            link, part = link
            parts.append(part)
        return cost, "".join(reversed(parts))


def _edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired rows."""
    after = None
    for letter in audit:
        role, text = next(rows) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter != "K":
            role = _ROLES["a" if after == "u" else "u"]
        after = role[0]
        yield letter, role, text


_FACTS = pa.schema(
    [
        ("conv_id", pa.int64()), *((name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        ("audit", pa.string()), ("repaired_sha256", pa.string())
    ]
)
_MESSAGES = pa.schema(
    [("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, _Course, Iterator[tuple[str, str]]]]:
    """(conv_id, its pieces chained, its rows as role and text) of rows (conv_id, piece, role, text), pieces before texts."""
    for conv_id, rows in itertools.groupby(_rows(batches), key=itemgetter(0)):
        course, first = _Course(), []
        for row in rows:
            if row[1] is None:
                first = [row]
                break
            course.add(row[1])
        yield conv_id, course, ((role, text) for _, _, role, text in itertools.chain(first, rows) if role is not None)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for conv_id, course, rows in _conversations(batches):
        cost, audit = course.end()
        digest, joined = hashlib.sha256(), ""
        for _, role, text in _edited(audit, rows):
            digest.update(f"{joined}{role}:{text}".encode())
            joined = "\n"
        out.append((conv_id, course.gaps, *course.faults, course.illegal, cost, audit, digest.hexdigest()))
        if len(out) >= BATCH:
            yield _batch(out, _FACTS)
            out = []
    yield _batch(out, _FACTS)


def _spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for conv_id, course, rows in _conversations(batches):
        for position, edit in enumerate(_edited(course.end()[1], rows)):
            out.append((conv_id, position, *edit))
            size += len(edit[2])
            if len(out) >= BATCH or size >= 1 << 24:
                yield _batch(out, _MESSAGES)
                out, size = [], 0
    yield _batch(out, _MESSAGES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types, strict=True)], schema=schema)


def _streamed(messages: DataFrame, present: Column | None) -> DataFrame:
    """conv_id, piece, role, text: of each conversation its pieces, then its rows, in order, in one task."""
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.coalesce(F.lit(True) if present is None else present, F.lit(False)).alias("present")
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    whole = F.rtrim("text", F.lit(_BLANK))
    ending = F.when(whole == "", 1).when(F.right(whole, F.lit(1)).isin(*_ENDS), 0).otherwise(3)
    light = rows.filter("present").select(
        "conv_id", "turn", "role", "digest", ending.alias("ending"), F.shiftright("turn", STRETCH.bit_length() - 1).alias("stretch")
    )
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    faulted = light.withColumn("fault", F.when(F.col("ending") == 1, 1).when(again, 2).otherwise(F.col("ending")))
    pieces = (
        faulted.select("conv_id", "stretch", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "role", "digest")
        .repartition("conv_id", "stretch")
        .sortWithinPartitions("conv_id", F.asc_nulls_first("stretch"), F.asc_nulls_first("turn"), "role", "digest", F.col("fault") == 2)
        .select("conv_id", "stretch", "turn", "initial", "fault")
        .mapInArrow(_walked, _PIECE_SQL)
    )
    sent = pieces.select(
        "conv_id", F.struct(*[c for c in pieces.columns if c not in ("conv_id", "stretch", "nth")]).alias("piece"),
        F.col("stretch").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
        "nth", F.lit(None).cast("binary").alias("digest")
    )
    kind = sent.schema["piece"].dataType
    told = rows.select(
        "conv_id", F.lit(None).cast(kind).alias("piece"), "turn", *[F.when(F.col("present"), F.col(c)).alias(c) for c in ("role", "text")],
        F.lit(None).cast("long").alias("nth"), "digest"
    )
    return (
        sent.unionByName(told)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("piece").isNull(), F.asc_nulls_first("turn"), "nth", "role", "digest")
        .select("conv_id", "piece", "role", "text")
    )


def repair(messages: DataFrame, present: Column | None = None) -> DataFrame:
    """Per conversation of ``messages`` (conv_id, turn, role, text): its faults and its cheapest repair.

    conv_id, gaps (turn numbers missing between the first and the last), blank,
    duplicate, truncated (rows by their first fault), illegal (adjacent roles
    that can't follow each other), cost, audit (K keep, R rerole, D delete,
    I insert) and repaired_sha256 over the ``role:text`` lines that
    ``repaired`` returns. Rows that aren't ``present`` only name their conversation.
    """
    return _streamed(messages, present).mapInArrow(
        _told, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    )


def repaired(messages: DataFrame, present: Column | None = None) -> DataFrame:
    """The repaired conversations: conv_id, position, edit, role, text."""
    return _streamed(messages, present).mapInArrow(
        _spoken, "conv_id long, position long, edit string, role string, text string"
    )


def damaged(messages: DataFrame) -> DataFrame:
    """``messages`` with every fifth row or so dropped, emptied, cut off, repeated or given to the user, and ``present``.

    crc32 of conv_id and turn (one space for null) decides; dropped rows stay with ``present`` false.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(harm == 1, "").when(harm == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(harm == 4, "user").otherwise(spaced("role"))
    return messages.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (harm != 0).alias("present"),
        F.explode(F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    ).drop("copy")
