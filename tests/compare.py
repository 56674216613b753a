"""Order-insensitive comparison of a Spark result with an oracle's."""

from __future__ import annotations

import math


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def same(df, con, sql):
    cur = con.execute(sql)
    want = rows_of([x[0] for x in cur.description], cur.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    wrong = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not wrong, (len(wrong), wrong[:3])
