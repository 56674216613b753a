"""The enrichment run with a model that answers by rules, so that SQL can tell its result."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypost.operators import batching, enrich, quality
from waypost.plans import oracle as O
from waypost.plans.catalog import register
from waypost.sources import answers, buckets, clients
from waypost.sources.places import places
from waypost.sources.scratch import filed, scratch
from waypost.streaming import favourites
from waypost.streaming import run as run_stream
from waypost.streaming.enrichment import enrich_stream

COLUMNS = ["naam", "provincie", "prijs", "stroom", "wifi", "sanitair"]
#: Batches of five that a file of ``stream_run`` may hold.
FILE_BATCHES = 10_000


def answer(prompt: str) -> str:
    """First pass: a list of an object for each row of the prompt; no list where the first row's name is a farm's."""
    rows = [json.loads(line.removeprefix("Data: ")) for line in prompt.split("\n") if line.startswith("Data: ")]
    if rows[0]["naam"].startswith("Boerderij"):
        return "geen idee"
    said = [
        {
            "naam": r["naam"], "provincie": r["provincie"], "prijs": "Onbekend",
            "stroom": "Nee" if "Parking" in r["naam"] else "Onbekend",
            "wifi": "Ja" if "Camping" in r["naam"] else "Onbekend", "sanitair": "Onbekend"
        }
        for r in rows
    ]
    return "```json\n" + json.dumps(said, ensure_ascii=False) + "\n```"


def answer_again(prompt: str) -> str:
    """Second pass: one object."""
    return "Gevonden: " + json.dumps({"sanitair": "Ja", "wifi": "Nee", "prijs": "onbekend", "extra": "x"})


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    base = places(spark, d).select("place_id", *COLUMNS, "photos", "ai_gecheckt")
    scraped = base.filter("place_id % 11 <> 0").select(
        "place_id", F.lit("").alias("site_text"), (F.col("place_id") % 4 != 0).alias("changed"),
        (F.col("place_id") % 500).alias("total_len"),
        F.when(F.col("place_id") % 5 == 0, F.array(F.lit("a.jpg"), F.lit("b.jpg"))).alias("photos")
    )
    return base, scraped


_RUN = f""", todo AS (
  SELECT *, (row_number() OVER (ORDER BY place_id) - 1) // 5 AS batch, place_id % 11 <> 0 AND place_id % 4 = 0 AND lower(ai_gecheckt) = 'ja' AS skipped, CASE WHEN place_id % 11 <> 0 THEN place_id % 500 ELSE 0 END AS total_len
  FROM places WHERE ai_gecheckt <> 'Ja'
),
asked AS (SELECT *, first_value(naam) OVER (PARTITION BY batch ORDER BY place_id) LIKE 'Boerderij%' AS failed FROM todo WHERE NOT skipped),
said AS (
  SELECT place_id, naam, provincie, CASE WHEN contains(naam, 'Parking') THEN 'Nee' ELSE 'Onbekend' END AS stroom, CASE WHEN contains(naam, 'Camping') THEN 'Ja' ELSE 'Onbekend' END AS wifi,
    total_len < 250 OR 2 + (lower(trim(naam)) = 'onbekend')::INT + (lower(trim(provincie)) = 'onbekend')::INT + (NOT contains(naam, 'Parking'))::INT + (NOT contains(naam, 'Camping'))::INT > 4 AS fallback
  FROM asked WHERE NOT failed
),
run AS (
  SELECT place_id, naam, {O.province("provincie")} AS provincie, 'Onbekend' AS prijs, stroom, CASE WHEN wifi = 'Onbekend' AND fallback THEN 'Nee' ELSE wifi END AS wifi, CASE WHEN fallback THEN 'Ja' ELSE 'Onbekend' END AS sanitair, fallback,
    CASE WHEN stroom = 'Nee' THEN 'Nee (geen stroom)' END AS stroom_prijs, CASE WHEN place_id % 5 = 0 AND place_id % 11 <> 0 THEN '["a.jpg","b.jpg"]' END AS photos
  FROM said
)"""
_NEW = ", ".join(f"coalesce(r.{c}, p.{c}) AS {c}" for c in (*COLUMNS, "photos"))


_ENRICHED = (
    O.places(
        "p.place_id, "
        + _NEW
        + ", coalesce(r.stroom_prijs, 'Onbekend') AS stroom_prijs, CASE WHEN r.place_id IS NOT NULL OR s.place_id IS NOT NULL THEN 'Ja' ELSE ai_gecheckt END AS ai_gecheckt",
        "p LEFT JOIN run r USING (place_id) LEFT JOIN (SELECT place_id FROM todo WHERE skipped) s USING (place_id)",
        _RUN
    )
)


@register("batch_enrichment", _ENRICHED)
def batch_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """The whole run, applied to the places."""
    base, scraped = _inputs(spark, d)
    return enrich.applied(base, enrich.batch_run(base, scraped, answer, answer_again, COLUMNS))


_OUTCOMES = O.places(
    "count(*) AS processed, count(r.place_id) AS succeeded, count(*) FILTER (WHERE skipped) AS skipped, count(*) FILTER (WHERE fallback) AS fallback, round(count(r.place_id) / greatest(count(*), 1) * 100, 1) AS pct",
    "JOIN todo USING (place_id) LEFT JOIN run r USING (place_id)", _RUN
)


@register("batch_outcomes", _OUTCOMES)
def batch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """The counters of that run."""
    base, scraped = _inputs(spark, d)
    run = enrich.batch_run(base, scraped, answer, answer_again, COLUMNS)
    return quality.run_counters(run.withColumn("naam", F.when(F.col("succeeded"), F.col("naam"))))


@register("observed_outcomes", _OUTCOMES)
def observed_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """The same counters, observed while the run's results are written."""
    base, scraped = _inputs(spark, d)
    run = enrich.batch_run(base, scraped, answer, answer_again, COLUMNS)
    run = run.withColumn("naam", F.when(F.col("succeeded"), F.col("naam")))
    return quality.run_observed(run, lambda df: df.write.parquet(scratch(spark, "outcomes")))


@register("unprocessed_first", O.places("place_id, naam", "WHERE ai_gecheckt <> 'Ja' ORDER BY place_id LIMIT 40"))
def unprocessed_first(spark: SparkSession, d: str) -> DataFrame:
    """O3: the limit of a run is the feature."""
    return batching.first_unprocessed(places(spark, d), 40).select("place_id", "naam")


def _endpoint(name: str, silent: tuple[str, ...], failure: type[Exception]):
    """An endpoint that fails for the names of some kinds of places."""

    def call(query: str) -> str:
        if query.strip().startswith(silent):
            raise failure(name)
        return f"{name}: {query}"

    return call


@register(
    "failover_fetch",
    O.places(
        "place_id, CASE WHEN naam LIKE 'Hotel%' THEN '' WHEN naam LIKE 'Jachthaven%' THEN 'c: ' || naam WHEN naam LIKE 'Parking%' THEN 'b: ' || naam ELSE 'a: ' || naam END AS site_text, CASE WHEN naam LIKE 'Hotel%' THEN 'no endpoint answered in 5 tries' END AS error"
    )
)
def failover_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Each row asks three endpoints in turn, ten rows at a time; a row that none answers has an error."""
    calls = [
        _endpoint("a", ("Parking", "Jachthaven", "Hotel"), clients.Busy), _endpoint("b", ("Jachthaven", "Hotel"), TimeoutError),
        _endpoint("c", ("Hotel",), ValueError)
    ]
    asked = enrich.fetched(places(spark, d).select("place_id", "naam"), clients.failover(calls, sleep=lambda _: None), "naam")
    return asked.select("place_id", "site_text", "error")


@register("stream_run", _ENRICHED)
def stream_run(spark: SparkSession, d: str) -> DataFrame:
    """The run of ``batch_enrichment`` as a stream of four lots; stopped after the second, and resumed."""
    base, scraped = _inputs(spark, d)
    source, store, progress, checkpoint = (scratch(spark, f"run-{name}") for name in ("in", "table", "progress", "state"))
    buckets.create(base, store, buckets=16)
    todo = batching.numbered(base.filter("ai_gecheckt <> 'Ja'").select("place_id"))
    lots = todo.join(scraped, "place_id", "left")
    batches = todo.agg(F.max("batch")).first()[0] or 0
    lots = filed(lots.withColumn("lot", F.floor(F.col("batch") * 4 / F.lit(batches + 1))).drop("position"), "lots")
    # a lot is one file, or several of whole batches, which are then taken together
    files = max(1, -(-(batches + 1) // (4 * FILE_BATCHES)))
    schema = "place_id long, site_text string, changed boolean, total_len long, photos array<string>"
    for lot in range(4):
        rows = lots.filter(F.col("lot") == lot)
        rows = rows.coalesce(1) if files == 1 else rows.repartition(files, "batch")
        rows.drop("lot", "batch").write.mode("append").parquet(source)
    steps = []

    def stop() -> bool:
        steps.append(1)
        return len(steps) > 2

    job = run_stream.Run(spark, store, progress, answer, answer_again, COLUMNS, stop=stop)
    assert not run_stream.run(job, source, schema, checkpoint, files)
    job.stop = lambda: False
    assert run_stream.run(job, source, schema, checkpoint, files)
    return buckets.read(spark, store)


@register("upsert_buckets", O.places("place_id, CASE WHEN place_id % 100 = 7 THEN 'nieuw' ELSE prijs END AS prijs, CASE WHEN place_id % 100 = 7 THEN 'stil' ELSE 'Onbekend' END AS rust, CASE WHEN place_id % 100 = 7 THEN 'Ja' ELSE ai_gecheckt END AS ai_gecheckt"))
def upsert_buckets(spark: SparkSession, d: str) -> DataFrame:
    """One row of a hundred changes; only the buckets of these are rewritten, and the upsert is run twice."""
    path = scratch(spark, "table")
    base = places(spark, d).select("place_id", "prijs", "ai_gecheckt")
    buckets.create(base, path, buckets=64)
    updates = base.filter("place_id % 100 = 7").select("place_id", F.lit("nieuw").alias("prijs"), F.lit("stil").alias("rust"))
    for _ in range(2):
        buckets.upsert_stored(spark, path, updates)
    return buckets.read(spark, path)


_EVENTS = "event_id, ts, user_id % 40 AS user_id, event_type AS naam, event_id % 7 <> 0 AS adds"


@register(
    "favourites_stream",
    f"""WITH marked AS (SELECT {_EVENTS} FROM events),
removed AS (SELECT user_id, naam, max((ts, event_id)) FILTER (WHERE NOT adds) AS gone FROM marked GROUP BY 1, 2),
kept AS (SELECT m.user_id, m.naam, min((ts, event_id)) AS since FROM marked m JOIN removed r USING (user_id, naam) WHERE adds AND (gone IS NULL OR (ts, event_id) > gone) GROUP BY 1, 2)
SELECT user_id, naam, row_number() OVER (PARTITION BY user_id ORDER BY since) AS rank FROM kept"""
)
def favourites_stream(spark: SparkSession, d: str) -> DataFrame:
    """Additions and removals that arrive out of order in three lots, with a restart after each."""
    source, target, checkpoint = (scratch(spark, f"favourites-{name}") for name in ("in", "out", "state"))
    events = spark.read.parquet(f"{d}/events.parquet").selectExpr(*_EVENTS.split(", "))
    for lot in (2, 0, 1):
        events.filter(F.col("event_id") % 3 == lot).write.mode("append").parquet(source)
        favourites.follow(spark, source, target, checkpoint, files=100).awaitTermination()
    return favourites.favourites(spark, target)


@register(
    "stored_answers",
    O.places(
        "place_id, CASE WHEN provincie = '-' THEN '' ELSE 'over ' || provincie END AS site_text, CASE WHEN provincie = '-' THEN 'niets gevonden' END AS error"
    )
)
def stored_answers(spark: SparkSession, d: str) -> DataFrame:
    """Every place's question is answered from the store; the second run's client, which only fails, isn't asked."""
    path = scratch(spark, "answers")

    def told(question: str) -> str:
        if question == "-":
            raise ValueError("niets gevonden")
        return f"over {question}"

    rows = places(spark, d).select("place_id", "provincie")
    answers.asked(rows, "provincie", "gids", told, path, 3600)
    again = answers.asked(rows, "provincie", "gids", _endpoint("x", ("",), ValueError), path, 3600)
    return again.select("place_id", "site_text", "error")


_STREAMED = (
    "CASE WHEN lower(trim(stroom)) = 'onbekend' AND regexp_matches(lower(naam), 'parking|parkeer') THEN 'Nee' ELSE stroom END"
)
_WASHED = (
    "CASE WHEN lower(trim(sanitair)) <> 'onbekend' THEN sanitair "
    "WHEN regexp_matches(lower(naam), 'parking|parkeer') THEN 'Nee' "
    "WHEN regexp_matches(lower(naam), 'jachthaven|marina|camping|vakantiepark') THEN 'Ja' ELSE sanitair END"
)


@register(
    "stream_enrichment",
    O.places(
        f"place_id, naam, {O.province('provincie')} AS provincie, {_STREAMED} AS stroom, {_WASHED} AS sanitair, "
        f"CASE WHEN lower({_STREAMED}) = 'nee' THEN 'Nee (geen stroom)' END AS stroom_prijs"
    ),
)
def stream_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Rows arrive in two lots; the second run of the stream takes only what is new."""
    source, target, checkpoint = (scratch(spark, f"stream-{name}") for name in ("in", "out", "state"))
    rows = places(spark, d).select("place_id", "naam", "provincie", "stroom", "sanitair")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    for lot in (0, 1):
        rows.filter(F.col("place_id") % 2 == lot).write.mode("append").parquet(source)
        enrich_stream(spark, source, schema, target, checkpoint).awaitTermination()
    return spark.read.parquet(target)
