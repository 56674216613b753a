"""Bucketed upserts, stored answers and the run as a stream: what is touched, what is asked, what a restart does."""

import json
import os
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from waypost.operators import enrich
from waypost.plans.run_queries import answer, answer_again
from waypost.sources import answers, buckets
from waypost.sources.scratch import move
from waypost.streaming import run as R

COLUMNS = ["naam", "provincie", "prijs", "stroom", "wifi", "sanitair"]


def base(spark, n=400):
    kinds = ["Camping", "Parking", "Boerderij", "Hotel"]
    rows = [(i, f"{kinds[i % 4]} {i}", "Drenthe", "€5", "Onbekend", "Onbekend", "Onbekend", "Nee" if i % 3 else "Ja") for i in range(n)]
    return spark.createDataFrame(rows, "place_id long, naam string, provincie string, prijs string, stroom string, wifi string, sanitair string, ai_gecheckt string")


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path, "rows").rglob("*.parquet")}


def bucket(path):
    return int(path.split("bucket_=")[1].split("/")[0])


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def updates(df):
    return df.filter("place_id % 100 = 7").select("place_id", F.lit("nieuw").alias("prijs"), F.lit("stil").alias("rust"))


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    df, path = base(spark), str(tmp_path / "t")
    buckets.create(df, path, buckets=32)
    before = files(path)
    hit = buckets.upsert_stored(spark, path, updates(df))
    after = files(path)
    assert 0 < len(hit) <= 4
    assert {bucket(f) for f in before.keys() - after.keys()} == set(hit) == {bucket(f) for f in after.keys() - before.keys()}
    assert all(after[f] == before[f] for f in before if bucket(f) not in hit)
    want = rows(enrich.upsert(df, updates(df)))
    assert rows(buckets.read(spark, path)) == want
    buckets.upsert_stored(spark, path, updates(df))  # again: the same rows
    assert rows(buckets.read(spark, path)) == want
    plan = buckets._stored(spark, path).filter(F.col("bucket_").isin(hit))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket_" in plan
    assert buckets.upsert_stored(spark, path, updates(df).limit(0)) == []


def test_upsert_survives_being_cut_off(spark, tmp_path, monkeypatch):
    df, path = base(spark), str(tmp_path / "t")
    buckets.create(df, path, buckets=16)
    want = rows(enrich.upsert(df, updates(df)))

    def fails(*_):
        raise RuntimeError("cut off")

    with monkeypatch.context() as m:  # before the rename: nothing has changed
        m.setattr(buckets, "move", lambda s, a, b: fails() if b.endswith("/ready") else move(s, a, b))
        with pytest.raises(RuntimeError):
            buckets.upsert_stored(spark, path, updates(df))
    old = buckets.read(spark, path)
    assert rows(old.drop("rust")) == rows(df)
    with monkeypatch.context() as m:  # after it: the next reader puts in place what is ready
        calls = []
        m.setattr(buckets, "recover", lambda s, p, real=buckets.recover: real(s, p) if not calls.append(1) and len(calls) == 1 else fails())
        with pytest.raises(RuntimeError):
            buckets.upsert_stored(spark, path, updates(df))
    assert os.path.exists(f"{path}/ready")
    gone = next(Path(path, "rows").glob("bucket_=*"))  # as if the bucket was being replaced
    if Path(path, "ready", gone.name).exists():
        for f in gone.iterdir():
            f.unlink()
    assert rows(buckets.read(spark, path)) == want and not os.path.exists(f"{path}/ready")


def test_null_keys_and_new_rows_are_left(spark, tmp_path):
    df, path = base(spark, 20), str(tmp_path / "t")
    buckets.create(df.withColumn("place_id", F.when(F.col("place_id") > 2, F.col("place_id"))), path, buckets=4)
    buckets.upsert_stored(spark, path, spark.createDataFrame([(5, "x"), (5000, "y"), (None, "z")], "place_id long, prijs string"))
    got = buckets.read(spark, path)
    assert got.count() == 20 and got.filter("prijs = 'x'").count() == 1 and got.filter("prijs in ('y', 'z')").count() == 0


def test_answers_are_asked_once_and_expire(spark, tmp_path):
    path, log = str(tmp_path / "answers"), str(tmp_path / "log")

    def call(question):
        with open(log, "a") as f:
            f.write(question + "\n")
        if question == "q3":
            raise ValueError("no such place")
        return f"answer to {question}"

    asked = lambda: open(log).read().split() if os.path.exists(log) else []
    df = spark.createDataFrame([(i, f"q{i % 5}") for i in range(40)] + [(99, None)], "id long, question string")
    at = lambda s: F.lit(f"2024-01-01 00:{s:02d}:00").cast("timestamp")
    first = rows(answers.asked(df, "question", "model", call, path, 600, at(0)))
    assert sorted(asked()) == [f"q{i}" for i in range(5)]
    assert {r.question: (r.site_text, r.error) for r in answers.asked(df, "question", "model", call, path, 600, at(5)).collect()} == {
        **{f"q{i}": (f"answer to q{i}", None) for i in (0, 1, 2, 4)}, "q3": ("", "no such place"), None: (None, None)
    }
    assert rows(answers.asked(df, "question", "model", call, path, 600, at(9))) == first
    assert len(asked()) == 5  # a second run asks nothing, failures included
    more = df.union(spark.createDataFrame([(7, "q7")], df.schema))
    answers.asked(more, "question", "model", call, path, 600, at(9)).collect()
    assert asked()[5:] == ["q7"]
    answers.asked(df, "question", "other", call, path, 600, at(9)).collect()
    assert len(asked()) == 11  # another client has answers of its own
    assert rows(answers.asked(df, "question", "model", call, path, 600, at(11))) == first
    assert len(asked()) == 16  # older than ten minutes


def started(spark, tmp_path, name, n=400):
    """A run over four files of scraped rows."""
    df = base(spark, n)
    root = tmp_path / name
    store = str(root / "table")
    buckets.create(df, store, buckets=8)
    scraped = df.filter("ai_gecheckt <> 'Ja'").select(
        "place_id", F.lit("").alias("site_text"), F.lit(True).alias("changed"), (F.col("place_id") % 500).alias("total_len"), F.lit(None).cast("array<string>").alias("photos")
    )
    ids = [r.place_id for r in scraped.orderBy("place_id").select("place_id").collect()]
    size = len(ids) // 20 * 5 + 5
    for i in range(0, len(ids), size):
        scraped.filter(F.col("place_id").isin(ids[i : i + size])).coalesce(1).write.mode("append").parquet(str(root / "in"))
    job = R.Run(spark, store, str(root / "progress"), answer, answer_again, COLUMNS, str(root / "snapshot"), str(root / "sync"))
    schema = "place_id long, site_text string, changed boolean, total_len long, photos array<string>"
    want = rows(enrich.applied(df, enrich.batch_run(df, scraped, answer, answer_again, COLUMNS)))
    return job, lambda: R.run(job, str(root / "in"), schema, str(root / "state")), want, root


def test_stream_is_stopped_resumed_and_exact(spark, tmp_path):
    job, go, want, root = started(spark, tmp_path, "a", 120)
    seen = []
    job.stop = lambda: seen.append(1) or len(seen) > 1
    assert not go()  # one micro-batch, then the flag
    assert job.last()[0] == 0 and rows(buckets.read(spark, job.store)) != want
    assert spark.read.option("header", True).option("escape", '"').csv(job.snapshot).count() == 120  # saved at the end all the same
    job.stop = lambda: False
    assert go() and rows(buckets.read(spark, job.store)) == want
    assert spark.read.parquet(job.sync).count() == 120
    progress = [json.loads(line) for p in Path(job.progress).glob("*.json") for line in p.read_text().splitlines()]
    assert sorted(p["batch"] for p in progress) == [0, 1, 2, 3] and sum(p["processed"] for p in progress) == 80
    seen = job.totals(80).first()
    whole = spark.createDataFrame(want, spark.read.parquet(job.sync).select(*sorted(spark.read.parquet(job.sync).columns)).schema)
    assert (seen.processed, seen.skipped, seen.done) == (80, 0, 100.0) and seen.eta == "~0m 0s"
    assert seen.succeeded == whole.filter("ai_gecheckt = 'Ja' and place_id % 3 <> 0").count() and seen.fallback > 0
    assert go() and rows(buckets.read(spark, job.store)) == want  # nothing is new


@pytest.mark.parametrize("where", ["before the upsert", "after the upsert"])
def test_stream_killed_within_a_micro_batch(spark, tmp_path, monkeypatch, where):
    job, go, want, _ = started(spark, tmp_path, where[:3], 60)
    real, calls = buckets.upsert_stored, []

    def upsert(*args):
        calls.append(1)
        if len(calls) == 2 and where.startswith("before"):
            raise RuntimeError("killed")
        out = real(*args)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return out

    with monkeypatch.context() as m:
        m.setattr(buckets, "upsert_stored", upsert)
        with pytest.raises(Exception, match="killed"):
            go()
    assert job.last()[0] == 0
    assert go() and rows(buckets.read(spark, job.store)) == want


def test_cadences(spark, tmp_path):
    """A snapshot after 25 rows, a sync after 50, counted over micro-batches."""
    job, go, _, root = started(spark, tmp_path, "c", 60)  # 40 rows to do, in files of 15, 15 and 10
    written = []
    real = R.Run.saved
    R.Run.saved = lambda self, a, b, x, y: written.append((a >= x, b >= y)) or real(self, a, b, x, y)
    try:
        assert go()
    finally:
        R.Run.saved = real
    assert written == [(False, False), (True, False), (False, False), (True, True)]
    assert threading.active_count() < 200


def test_favourites_in_any_order(spark, tmp_path):
    """Add, remove and re-add, late events and ties, in lots of every order, with a restart after each lot."""
    import itertools
    import random
    from datetime import datetime, timedelta

    from waypost.streaming import favourites as FV

    start = datetime(2024, 1, 1)
    events = [(i, start + timedelta(minutes=m), u, n, a) for i, (m, u, n, a) in enumerate([
        (0, 1, "x", True), (1, 1, "y", True), (2, 1, "x", False), (3, 1, "x", True), (4, 1, "x", True), (4, 2, "x", True), (4, 2, "x", False),
        (5, 2, "y", False), (6, 2, "z", True), (0, 3, "q", False), (9, 3, "q", True), (8, 3, "q", False), (7, 1, "z", True)
    ])]
    want = {}
    for key in {(e[2], e[3]) for e in events}:
        own = sorted((e[1], e[0], e[4]) for e in events if (e[2], e[3]) == key)
        tail = list(itertools.takewhile(lambda e: e[2], reversed(own)))
        if tail:
            want.setdefault(key[0], []).append((tail[-1][:2], key[1]))
    want = {u: [n for _, n in sorted(v)] for u, v in want.items()}
    for seed in range(2):
        lots = events[:]
        random.Random(seed).shuffle(lots)
        places = [str(tmp_path / f"{seed}{x}") for x in ("in", "out", "state")]
        for i in range(0, len(lots), 5):
            spark.createDataFrame(lots[i : i + 5], FV.EVENTS).coalesce(1).write.mode("append").parquet(places[0])
            FV.follow(spark, *places).awaitTermination()
        got = {}
        for r in FV.favourites(spark, places[1]).orderBy("rank").collect():
            got.setdefault(r.user_id, []).append(r.naam)
        assert got == want


def test_large_lots_are_several_files(spark, duck, monkeypatch):
    """A lot of many batches isn't written and read by one task; batches stay whole."""
    from tests.compare import same
    from tests.conftest import SF
    from waypost.plans import catalog, run_queries

    taken, whole = [], run_queries.run_stream.run
    monkeypatch.setattr(run_queries, "FILE_BATCHES", 3)
    monkeypatch.setattr(run_queries.run_stream, "run", lambda job, source, schema, checkpoint, files=1: taken.append((files, len(spark.read.parquet(source).inputFiles()))) or whole(job, source, schema, checkpoint, files))
    same(catalog.queries()["stream_run"](spark, SF), duck, catalog.oracle_sql()["stream_run"])
    files, written = taken[0]
    assert files > 1 and 4 < written <= 4 * files
