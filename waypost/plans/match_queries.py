"""Queries that find what belongs together: misspelt names, review pages, stored places near a point."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypost.operators import fuzzy, geo, linkage
from waypost.plans import oracle as O
from waypost.plans.catalog import register
from waypost.sources import spatial, trigrams
from waypost.sources.places import places
from waypost.sources.scratch import scratch

_T, _I = "lower(trim(naam))", "CAST(1 + place_id % length(trim(naam)) AS INT)"
#: A place's name with no, one or two edits, in SQL that Spark and DuckDB read alike.
_MISSPELT = f"""CASE place_id % 5 WHEN 0 THEN {_T} WHEN 1 THEN substr({_T}, 1, {_I} - 1) || substr({_T}, {_I} + 1)
  WHEN 2 THEN substr({_T}, 1, {_I} - 1) || 'x' || substr({_T}, {_I}) WHEN 3 THEN substr({_T}, 1, {_I} - 1) || 'q' || substr({_T}, {_I} + 1)
  ELSE substr({_T}, 1, {_I} - 1) || 'zz' || substr({_T}, {_I} + 1) END || CASE WHEN place_id % 2 = 0 THEN ', Nederland' ELSE '' END"""


@register(
    "geocode_misspelt",
    O.places(
        "place_id, m.found AS found, m.d AS edits, spot.lat AS lat, spot.lon AS lon",
        "JOIN asked USING (place_id) LEFT JOIN best USING (asked) LEFT JOIN known ON known.found = m.found",
        f""", asked AS (SELECT place_id, lower({_MISSPELT}) AS asked FROM places),
known AS (SELECT lower(trim(naam)) AS found, min({{'lat': {O.number('latitude')}, 'lon': {O.number('longitude')}}}) AS spot FROM places
  WHERE {O.number('latitude')} IS NOT NULL AND {O.number('longitude')} IS NOT NULL GROUP BY 1),
forms AS (SELECT DISTINCT asked, unnest([asked, regexp_replace(asked, ', nederland$', '')]) AS a FROM asked),
best AS (SELECT asked, min({{'d': levenshtein(a, found)::INT, 'found': found}}) AS m FROM forms, known WHERE levenshtein(a, found) <= CASE WHEN length(a) <= 2 THEN 0 WHEN length(a) <= 5 THEN 1 ELSE 2 END GROUP BY asked)"""
    )
)
def geocode_misspelt(spark: SparkSession, d: str) -> DataFrame:
    """Every place's name, spelt wrong, finds a place; all pairs decide in SQL."""
    rows = places(spark, d)
    known = geo.with_coordinates(rows).filter("lat_d is not null and lon_d is not null")
    names = known.select(F.col("naam").alias("name"), F.col("lat_d").alias("lat"), F.col("lon_d").alias("lon"))
    return fuzzy.geocode(rows.selectExpr("place_id", f"{_MISSPELT} AS query"), names).drop("query")


#: Review pages about places, by other orders of words and with unknown provinces.
_TITLE = "CASE place_id % 4 WHEN 0 THEN 'Reviews ' || naam WHEN 1 THEN upper(naam) WHEN 2 THEN naam || ' NL' ELSE naam END"
_REVIEWS = [
    "CAST(1000000 + place_id AS BIGINT) AS page_id", f"{_TITLE} AS title",
    "CASE WHEN place_id % 7 = 0 THEN 'Onbekend' ELSE provincie END AS provincie"
]


def review_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a review site, derived from two thirds of the places."""
    return places(spark, d).filter("place_id % 3 <> 0").selectExpr(*_REVIEWS)


_WORDS = lambda c: f"list_sort(list_distinct(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')))"
_LINKS = f""", review AS (SELECT {', '.join(_REVIEWS)} FROM places WHERE place_id % 3 <> 0),
rows AS (
  SELECT 'p' AS side, place_id AS id, {_WORDS('naam')} AS words, {O.province('provincie')} AS province FROM places
  UNION ALL SELECT 'q', page_id, {_WORDS('title')}, {O.province('provincie')} FROM review
),
named AS (SELECT *, min(id) OVER (PARTITION BY side, words, province) AS class, row_number() OVER (PARTITION BY side, words, province ORDER BY id) - 1 AS nth FROM rows WHERE len(words) > 0),
classes AS (SELECT side, class, any_value(words) AS words, any_value(province) AS province, count(*) AS n FROM named GROUP BY 1, 2),
weights AS (SELECT word, round(ln(1 + (SELECT count(*) FROM named) / count(*)) * 1000000)::BIGINT AS w FROM (SELECT unnest(words) AS word FROM named) GROUP BY word),
items AS (SELECT side, class, word, w FROM (SELECT side, class, unnest(words) AS word FROM classes) JOIN weights USING (word)),
totals AS (SELECT side, class, sum(w) AS total FROM items GROUP BY 1, 2),
common AS (SELECT a.class AS p, b.class AS q, sum(a.w) AS i FROM items a JOIN items b USING (word) WHERE a.side = 'p' AND b.side = 'q' GROUP BY 1, 2),
links AS (
  SELECT p, q, a.n AS np, b.n AS nq, round(i / (t.total + u.total - i), 6) AS score
  FROM common JOIN classes a ON a.side = 'p' AND a.class = p JOIN classes b ON b.side = 'q' AND b.class = q JOIN totals t ON t.side = 'p' AND t.class = p JOIN totals u ON u.side = 'q' AND u.class = q
  WHERE (a.province = b.province OR a.province = 'Onbekend' OR b.province = 'Onbekend') AND round(i / (t.total + u.total - i), 6) >= 0.6
)"""
_MATCHES = _LINKS + """,
walk AS (
  SELECT p, q, score, np AS cp, nq AS cq, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS k FROM links
  UNION ALL
  SELECT p, q, score, CASE WHEN now THEN cp ELSE cp - kp END, CASE WHEN now THEN cq ELSE cq - kq END, CASE WHEN now THEN a ELSE a + kp END, CASE WHEN now THEN b ELSE b + kq END, CASE WHEN now THEN least(cp, cq) ELSE 0 END
  FROM (
    SELECT *, max(CASE WHEN now THEN least(cp, cq) ELSE 0 END) OVER (PARTITION BY p) AS kp, max(CASE WHEN now THEN least(cp, cq) ELSE 0 END) OVER (PARTITION BY q) AS kq
    FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY score DESC, p, q) = 1 AND row_number() OVER (PARTITION BY q ORDER BY score DESC, p, q) = 1 AS now FROM walk WHERE k = 0)
  ) WHERE now OR (cp > kp AND cq > kq)
),
units AS (SELECT p, q, score, a + i AS nth_p, b + i AS nth_q FROM (SELECT *, unnest(range(k)) AS i FROM walk WHERE k > 0))"""


@register("review_links", O.places("p AS place_id, q AS page_id, score", "JOIN links ON p = place_id", _LINKS))
def review_links(spark: SparkSession, d: str) -> DataFrame:
    """Similar classes of places and review pages; all pairs decide in SQL."""
    return linkage.similar(places(spark, d), review_pages(spark, d))


@register(
    "review_matches",
    O.places(
        "a.id AS place_id, b.id AS page_id, score",
        "JOIN named a ON a.side = 'p' AND a.class = p AND a.nth = nth_p JOIN named b ON b.side = 'q' AND b.class = q AND b.nth = nth_q", _MATCHES
    ).replace("WITH places", "WITH RECURSIVE places").replace("FROM places JOIN named a", "FROM units JOIN named a")
)
def review_matches(spark: SparkSession, d: str) -> DataFrame:
    """Each place with its review page, one to one."""
    return linkage.link(places(spark, d), review_pages(spark, d))


_HOME = (52.3, 5.3)
_KM = O.distance(*_HOME)


def _stored(spark: SparkSession, d: str) -> str:
    path = scratch(spark, "spatial")
    spatial.save(places(spark, d).select("place_id", "naam", "latitude", "longitude"), path, files=64)
    return path


@register("radius_stored", O.places(f"place_id, naam, round({_KM}, 3) AS km", f"WHERE ({_KM}) <= 10"))
def radius_stored(spark: SparkSession, d: str) -> DataFrame:
    """Places stored along a curve; only the files whose box the circle touches are opened."""
    near = spatial.within(spark, _stored(spark, d), _HOME, 10.0)
    return near.select("place_id", "naam", F.round("afstand_km", 3).alias("km"))


@register("nearest_stored", O.places(f"place_id, naam, round({_KM}, 3) AS km", f"ORDER BY {_KM}, place_id LIMIT 25"))
def nearest_stored(spark: SparkSession, d: str) -> DataFrame:
    """O1: the nearest 25 of the stored places, by growing rings; the number is the feature."""
    near = spatial.nearest_stored(spark, _stored(spark, d), *_HOME, 25)
    return near.select("place_id", "naam", F.round("afstand_km", 3).alias("km"))


def _indexed(name: str, query: str) -> None:
    t = query.strip().lower()
    stage = f"CASE WHEN {O.says('naam', t)} THEN 1 WHEN {O.says('provincie', t)} THEN 2 END"

    @register(
        name,
        O.places(
            "place_id, best IS NULL AS use_ai", "JOIN staged USING (place_id) CROSS JOIN best WHERE best IS NULL OR stage = best",
            f", staged AS (SELECT place_id, {stage} AS stage FROM places), best AS (SELECT min(stage) AS best FROM staged)"
        )
    )
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Q1 by posting lists."""
        path, rows = scratch(spark, "trigrams"), places(spark, d).select("place_id", "naam", "provincie")
        trigrams.save(rows, path, files=32)
        return trigrams.cascade(rows, path, query)


_indexed("indexed_search_name", " Jachthaven b")
_indexed("indexed_search_province", "Zeeland")
_indexed("indexed_search_short", "Hi")
_indexed("indexed_search_none", "zxqj")
