"""Names that are nearly equal: an index of their deletions, verified by edit distance.

Two texts within ``k`` edits (an insertion, a deletion or a replacement of a
letter) become equal by deleting at most ``k`` letters of each. So every text
is filed under the hash of what is left after each choice of up to ``k``
deletions, texts that share one are candidates, and the Levenshtein distance
decides. Nothing is compared that shares no key, and no pair within ``k`` edits
is missed. A text of n letters has about n ** k / k! keys, so this is meant for names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.operators.search import geocode_query


def _one_less(text: Column) -> Column:
    """What is left of a text after each single deletion."""
    n = F.length(text)
    cut = lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), cut)).otherwise(
        F.array().cast("array<string>")
    )


def deletions(text: Column, k: int = 2) -> Column:
    """The distinct texts left after up to ``k`` deletions, the text itself included."""
    level = F.array(text)
    found = [level]
    for _ in range(k):
        level = F.array_distinct(F.flatten(F.transform(level, _one_less)))
        found.append(level)
    return F.array_distinct(F.flatten(F.array(*found)))


def allowed(text: Column, k: int = 2) -> Column:
    """How many edits a text of its length may be off: none up to 2 letters, one up to 5, else ``k``."""
    n = F.length(text)
    return F.when(n <= 2, 0).when(n <= 5, min(1, k)).otherwise(k)


def near(left: DataFrame, right: DataFrame, k: int = 2) -> DataFrame:
    """(a, b, distance): the different texts ``a`` of ``left`` and ``b`` of ``right`` within ``k`` edits.

    Both have one column of texts. Texts are taken once however often they
    occur, so what is frequent costs no more than what is rare. Spark judges a
    table by its size before its rows are spread over their keys, and would
    broadcast hundreds of keys a text through the driver; so the join is by
    shuffles, and texts are dealt out again, by another hash and to a given
    number of tasks (or Spark would make one of these), before they are spread.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = lambda df, name: df.toDF(name).filter(F.col(name).isNotNull()).distinct().repartition(parts, F.xxhash64(name)).select(
        name, F.explode(F.transform(deletions(F.col(name), k), lambda x: F.xxhash64(x))).alias("key")
    )
    pairs = keyed(left, "a").hint("merge").join(keyed(right, "b"), "key")
    distance = F.levenshtein("a", "b", k)  # -1 beyond k
    return pairs.select("a", "b", distance.alias("distance")).filter("distance >= 0").distinct()


def geocode(queries: DataFrame, names: DataFrame, query: str = "query", k: int = 2) -> DataFrame:
    """``queries`` with the place (name, lat, lon) they name, spelt right or up to ``k`` edits off.

    Compared are lower-cased, trimmed texts, a query with and without the
    country that ``geocode_query`` adds. The fewest edits win, then the least
    name, then the smallest coordinates; short queries may be off by less
    (``allowed``). Adds ``found`` (the name as compared), ``edits``, lat and lon,
    null where nothing is near.
    """
    known = names.select(F.lower(F.trim("name")).alias("found"), F.struct("lat", "lon").alias("at")).groupBy("found").agg(
        F.min("at").alias("at")
    ).filter("found is not null")
    asked = F.lower(F.trim(F.col(query)))
    full = F.lower(F.trim(geocode_query(F.col(query))))
    bare = F.regexp_replace(full, r",\s*nederland$", "")
    texts = queries.select(asked.alias("asked")).distinct()
    forms = queries.select(asked.alias("asked"), F.explode(F.array_distinct(F.array(asked, bare))).alias("a")).distinct()
    pairs = near(forms.select("a"), known.select("found"), k).filter(F.col("distance") <= allowed(F.col("a"), k))
    best = forms.join(pairs, "a").groupBy("asked").agg(F.min(F.struct("distance", "b")).alias("m"))
    placed = texts.join(best, "asked").select("asked", F.col("m.b").alias("found"), F.col("m.distance").alias("edits")).join(known, "found")
    out = placed.select(F.col("asked").alias("asked_"), "found", "edits", F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"))
    return queries.withColumn("asked_", asked).join(out, "asked_", "left").drop("asked_")
