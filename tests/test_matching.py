"""Tolerant geocoding and record linkage against all pairs by brute force."""

import itertools
import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from waypost.operators import batching, fuzzy, linkage


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_deletions(spark):
    rows = spark.createDataFrame([("abca",), ("",), ("a",), ("éé",)], "t string")
    got = {r.t: set(r.d or ()) for r in rows.select("t", fuzzy.deletions(F.col("t"), 2).alias("d")).collect()}
    for t, d in got.items():
        want = {"".join(c) for n in range(3) for c in itertools.combinations(t, len(t) - n)} if len(t) > 1 else {t, ""}
        assert d == want, (t, d)


def test_near_equals_all_pairs(spark):
    rng = random.Random(2)
    texts = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(0, 7))) for _ in range(250)})
    left, right = texts[::2], texts[1::2]
    make = lambda x: spark.createDataFrame([(t,) for t in [*x, *x[:9], None]], "t string")
    for k in (1, 2):
        found = fuzzy.near(make(left), make(right), k)
        assert {tuple(r) for r in found.collect()} == {(a, b, n) for a in left for b in right if (n := distance(a, b)) <= k}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_geocode_ties_and_short_names(spark):
    names = spark.createDataFrame([("Oss", 1.0, 1.0), ("Ede", 2.0, 2.0), ("Zwolle", 4.0, 9.0), ("zwolle ", 3.0, 9.0), ("Zwelle", 5.0, 5.0)], "name string, lat double, lon double")
    asked = spark.createDataFrame([("Zwole",), ("zwxlle, Nederland",), ("Od",), ("Osse",), (" ede",), ("nergens",), (None,), ("",)], "query string")
    got = {r.query: (r.found, r.edits, r.lat) for r in fuzzy.geocode(asked, names).collect()}
    assert got == {
        "Zwole": ("zwolle", 1, 3.0), "zwxlle, Nederland": ("zwelle", 1, 5.0), "Od": (None, None, None), "Osse": ("oss", 1, 1.0),
        " ede": ("ede", 0, 2.0), "nergens": (None, None, None), None: (None, None, None), "": (None, None, None)
    }


def brute(places, pages, threshold):
    """Greedy one-to-one matching of all pairs by falling similarity."""
    from waypost.functions.normalize import OFFICIAL  # noqa: F401  provinces here are official names

    def side(rows):
        out = defaultdict(list)
        for i, name, province in rows:
            words = tuple(sorted(set("".join(c if c.isalnum() else " " for c in (name or "").lower()).split())))
            if words:
                out[words, province].append(i)
        return {k: sorted(v) for k, v in out.items()}

    left, right = side(places), side(pages)
    seen = Counter()
    for s in (left, right):
        for (words, _), ids in s.items():
            seen.update({w: len(ids) for w in words})
    n = sum(len(v) for s in (left, right) for v in s.values())
    weigh = lambda ws: sum(round(math.log(1 + n / seen[w]) * 1e6) for w in ws)
    edges = []
    for (a, pa), ia in left.items():
        for (b, pb), ib in right.items():
            if pa == pb or "Onbekend" in (pa, pb):
                both = weigh(set(a) & set(b))
                score = round(both / (weigh(a) + weigh(b) - both), 6)
                if score >= threshold:
                    edges.append((-score, ia[0], ib[0], ia, ib))
    links = {(p, q, -s) for s, p, q, _, _ in edges}
    free, pairs = {i for s in (left, right) for v in s.values() for i in v}, set()
    for s, _, _, ia, ib in sorted(edges):
        for p, q in zip([i for i in ia if i in free], [i for i in ib if i in free], strict=False):
            pairs.add((p, q, -s))
            free -= {p, q}
    return links, pairs


def tables(spark, seed, n, words):
    rng = random.Random(seed)
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))
    province = lambda: rng.choice(["Drenthe", "Zeeland", "Onbekend"])
    places = [(i, name(), province()) for i in range(n)]
    pages = [(10_000 + i, name(), province()) for i in range(n)]
    return places, pages, spark.createDataFrame(places, "place_id long, naam string, provincie string"), spark.createDataFrame(pages, "page_id long, title string, provincie string")


def test_linkage_equals_all_pairs(spark):
    words = ["Camping", "de", "Hoeve", "Zon", "Parking", "strand", "bos", "Oude", "haven", "meer"]
    for seed, threshold in ((1, 0.5), (2, 0.8)):
        places, pages, left, right = tables(spark, seed, 120, words)
        links, pairs = brute(places, pages, threshold)
        assert {(r.place_id, r.page_id, r.score) for r in linkage.similar(left, right, threshold).collect()} == links
        assert {(r.place_id, r.page_id, r.score) for r in linkage.link(left, right, threshold).collect()} == pairs
        assert len({p for p, _, _ in pairs}) == len({q for _, q, _ in pairs}) == len(pairs) > 20


def test_hot_words_are_dealt(spark):
    """A word that every name has makes no block of its own, and one that it does make is split; results don't change."""
    places, pages, left, right = tables(spark, 3, 150, ["Camping", "a1"] * 3 + [f"w{i}" for i in range(9)])
    want = brute(places, pages, 0.6)
    for deal in (3, 4096):
        assert {(r.place_id, r.page_id, r.score) for r in linkage.link(left, right, 0.6, deal).collect()} == want[1]


def test_linkage_of_copies_and_empty_tables(spark):
    places = spark.createDataFrame([(i, "Camping De Zon", "Zeeland") for i in range(500)], "place_id long, naam string, provincie string")
    pages = spark.createDataFrame([(i, "de zon CAMPING!", "Zeeland") for i in range(900, 1200)], "page_id long, title string, provincie string")
    got = {(r.place_id, r.page_id) for r in linkage.link(places, pages).collect()}
    assert got == {(i, 900 + i) for i in range(300)}
    assert linkage.link(places.limit(0), pages).count() == 0 == linkage.link(places, pages.limit(0)).count()


def test_numbers_without_skew(spark):
    """An outlier or a hot value doesn't put all rows in one range."""
    ids = [*range(10_000), 10**12]
    df = spark.createDataFrame([(i,) for i in ids], "place_id long")
    rows = batching.numbered(df).collect()
    assert sorted((r.place_id, r.position, r.batch) for r in rows) == [(x, i, i // 5) for i, x in enumerate(ids)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or Spark makes one of so few rows
    parts = df.orderBy("place_id").groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in parts) < 6000
    nulls = spark.createDataFrame([(None,), (3,), (None,), (-5,)], "place_id long")
    assert sorted((r.position, r.place_id) for r in batching.numbered(nulls).collect()) == [(0, -5), (1, 3), (2, None), (3, None)]


def test_keys_are_not_broadcast(spark):
    """Few texts make many keys, which must not pass through the driver, and are spread by several tasks."""
    texts = spark.range(2000).select(F.concat(F.lit("jachthaven de "), F.col("id").cast("string")).alias("t"))
    found = fuzzy.near(texts, texts, 1)
    assert found.filter("distance = 0").count() == 2000
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert plan.count("REPARTITION_BY_NUM") >= 2
