"""Places and pages about them, linked by name and province.

1. Rows with the same set of words and the same province are one class, so a
   name that thousands share is compared once.
2. A word weighs ln(1 + rows / rows with it), in whole millionths. Classes are
   similar by the weight of their common words over that of all their words
   (weighted Jaccard). Provinces must be equal, or one of them unknown.
3. Words are ordered by falling weight. What two classes have in common lies
   at or after their first common word, so a pair of similarity t has that
   word where at least t of a class's weight is still to come: only these rare
   words make blocks, and no pair is lost. A block with many classes is dealt
   to several tasks: each place class to one, each page class to all of them.
4. Each pair is judged once, at its first common word.
5. One-to-one: pairs that are the best of both sides are taken, as many rows as
   both have left, and what is used up goes; then again. This gives what taking
   all pairs by falling similarity would give (ties: least ids), in a few rounds.

Within two classes the least ids meet. Rows without words are linked with nothing.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.functions.clean import UNKNOWN
from waypost.functions.normalize import province
from waypost.operators.batching import ranked
from waypost.sources.scratch import filed

MICRO = 1_000_000
#: Place classes of one word that a task gets at most.
DEAL = 4096


def words(name: Column) -> Column:
    """The distinct words of a name, lower-cased, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{N}]+"), 0)))


def _rows(df: DataFrame, key: str, name: str) -> DataFrame:
    """id, words, province of rows with words."""
    return df.select(
        F.col(key).alias("id"), words(F.col(name)).alias("words"), province(F.col("provincie")).alias("province")
    ).filter(F.size("words") > 0)


def _classes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("words", "province").agg(F.min("id").alias("class"), F.count("*").alias("n"))


def _weighted(classes: DataFrame, weights: DataFrame) -> DataFrame:
    """class, province, n, total, items: (w, word) by falling weight, and ``rare``: the words that make blocks."""
    each = classes.select("class", "province", "n", F.explode("words").alias("word")).join(weights, "word")
    return each.groupBy("class", "province", "n").agg(
        F.sort_array(F.collect_list(F.struct("w", "word")), False).alias("items"), F.sum("w").alias("total")
    )


def _rare(classes: DataFrame, threshold: float) -> Column:
    """The words of ``items`` at which at least ``threshold`` of the total is still to come."""
    start = F.struct(F.col("total").alias("left"), F.array().cast("array<string>").alias("out"))
    step = lambda done, x: F.struct(
        (done["left"] - x["w"]).alias("left"),
        F.when(done["left"] >= F.col("total") * threshold, F.array_append(done["out"], x["word"])).otherwise(done["out"]).alias("out")
    )
    return F.aggregate("items", start, step, lambda done: done["out"])


def _weights(sides: list[DataFrame]) -> DataFrame:
    """word, w: the words' weights over the rows of all sides."""
    counts = functools.reduce(DataFrame.unionByName, [s.select("n", "words") for s in sides])
    rows = counts.agg(F.sum("n")).first()[0] or 0
    seen = counts.select("n", F.explode("words").alias("word")).groupBy("word").agg(F.sum("n").alias("df"))
    return seen.select("word", F.round(F.ln(1 + F.lit(rows) / F.col("df")) * MICRO).cast("long").alias("w"))


def _pairs(left: DataFrame, right: DataFrame, threshold: float, deal: int) -> DataFrame:
    """p, q, np, nq, score of the classes that are similar enough."""
    block = lambda df, names: df.select(
        *[F.col(c).alias(x) for c, x in zip(("class", "province", "n", "items", "total"), names, strict=True)],
        F.explode(_rare(df, threshold)).alias("word")
    )
    a = block(left, ("p", "pp", "np", "pi", "pt"))
    b = block(right, ("q", "qp", "nq", "qi", "qt"))
    sizes = a.groupBy("word").agg(F.ceil(F.count("*") / deal).cast("int").alias("tasks"))
    a = a.join(sizes, "word").withColumn("task", F.pmod(F.xxhash64("p"), F.col("tasks")).cast("int"))
    b = b.join(sizes, "word").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    met = a.drop("tasks").join(b.drop("tasks"), ["word", "task"]).filter(
        (F.col("pp") == F.col("qp")) | (F.col("pp") == UNKNOWN) | (F.col("qp") == UNKNOWN)
    )
    names = F.transform("qi", lambda x: x["word"])
    common = F.filter("pi", lambda x: F.array_contains(names, x["word"]))
    met = met.withColumn("common", common).filter(F.col("common")[0]["word"] == F.col("word"))
    both = F.aggregate("common", F.lit(0).cast("long"), lambda s, x: s + x["w"])
    score = F.round(both / (F.col("pt") + F.col("qt") - both), 6)
    return met.select("p", "q", "np", "nq", score.alias("score")).filter(F.col("score") >= threshold)


def _matched(edges: DataFrame) -> DataFrame:
    """p, q, k, a, b: how many rows of two classes meet, from the a-th and b-th of each on."""
    taken, left = [], filed(edges.select("p", "q", "score", F.col("np").alias("cp"), F.col("nq").alias("cq"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), "edges")
    while not left.isEmpty():
        best = F.struct((-F.col("score")).alias("s"), "p", "q")
        for_p, for_q = (left.groupBy(c).agg(F.min(best).alias("m")).select("m.p", "m.q") for c in ("p", "q"))
        now = left.join(for_p.intersect(for_q), ["p", "q"])
        now = filed(now.withColumn("k", F.least("cp", "cq")), "matched")
        taken.append(now.select("p", "q", "k", "a", "b"))
        used_p, used_q = (now.select(c, F.col("k").alias(f"k_{c}")) for c in ("p", "q"))
        rest = left.join(used_p, "p", "left").join(used_q, "q", "left").na.fill(0, ["k_p", "k_q"])
        rest = rest.select(
            "p", "q", "score", (F.col("cp") - F.col("k_p")).alias("cp"), (F.col("cq") - F.col("k_q")).alias("cq"),
            (F.col("a") + F.col("k_p")).alias("a"), (F.col("b") + F.col("k_q")).alias("b")
        )
        left = filed(rest.filter("cp > 0 and cq > 0"), "edges")
    if not taken:
        return left.select("p", "q", F.col("cp").alias("k"), "a", "b")
    return functools.reduce(DataFrame.unionByName, taken)


def _members(rows: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """class as ``name``, nth (from 0, by id) and id of all rows; numbered by ranges, so a large class isn't one task's."""
    own = rows.join(classes.select("words", "province", "class"), ["words", "province"]).select("class", "id")
    order = filed(ranked(own, F.col("class"), F.col("id")), "members")
    first = order.groupBy("class").agg(F.min("rank").alias("first"))
    return order.join(first, "class").select(F.col("class").alias(name), (F.col("rank") - F.col("first")).alias("nth"), "id")


def _prepared(places: DataFrame, pages: DataFrame, threshold: float, deal: int) -> tuple:
    rows = _rows(places, "place_id", "naam"), _rows(pages, "page_id", "title")
    classes = [filed(_classes(r), "classes") for r in rows]
    weights = filed(_weights(classes), "weights")
    edges = filed(_pairs(*[_weighted(c, weights) for c in classes], threshold, deal), "links")
    return rows, classes, edges


def similar(places: DataFrame, pages: DataFrame, threshold: float = 0.6, deal: int = DEAL) -> DataFrame:
    """place_id, page_id (the least of each class), score: classes of places (naam, provincie) and pages (title, provincie) that are similar."""
    _, _, edges = _prepared(places, pages, threshold, deal)
    return edges.select(F.col("p").alias("place_id"), F.col("q").alias("page_id"), "score")


def link(places: DataFrame, pages: DataFrame, threshold: float = 0.6, deal: int = DEAL) -> DataFrame:
    """place_id, page_id, score: each place with at most one page and each page with at most one place."""
    rows, classes, edges = _prepared(places, pages, threshold, deal)
    matched = _matched(edges).join(edges.select("p", "q", "score"), ["p", "q"])
    units = matched.select("p", "q", "score", "a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i"))
    units = units.select("p", "q", "score", (F.col("a") + F.col("i")).alias("nth_p"), (F.col("b") + F.col("i")).alias("nth_q"))
    one, two = (_members(r, c, x) for r, c, x in zip(rows, classes, ("p", "q"), strict=True))
    met = units.join(one.withColumnsRenamed({"nth": "nth_p", "id": "place_id"}), ["p", "nth_p"])
    return met.join(two.withColumnsRenamed({"nth": "nth_q", "id": "page_id"}), ["q", "nth_q"]).select("place_id", "page_id", "score")
