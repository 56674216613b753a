"""Searches by posting lists against the search of all texts."""

import random

import pytest
from pyspark.sql import functions as F
from waypost.operators import search
from waypost.sources import trigrams


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé %_") for _ in range(rng.randint(0, 12)))
    rows = [(i, word(), rng.choice(["Drenthe", "abc", "Zeeland", None])) for i in range(600)]
    rows += [(600 + i, "Camping De Zon", "Zeeland") for i in range(300)] + [(900, None, None), (901, "İstanbul", "x"), (902, "aaaaaaa", "y")]
    df = spark.createDataFrame(rows, "place_id long, naam string, provincie string")
    path = str(tmp_path_factory.mktemp("trigrams") / "a")
    trigrams.save(df, path, 24)
    return df, path


@pytest.mark.parametrize("query", ["a", "é", "ab", " CA ", "abc", "abca", "bcab c", "Camping De Zon", "camping  de", "zeeland", "%", "a_", "aaaa", "aaaaaaaa", "nothing here", "", "  ", "stanbul"])
def test_equals_the_cascade(spark, indexed, query):
    df, path = indexed
    want = {(r.place_id, r.use_ai) for r in search.cascade(df, query).select("place_id", "use_ai").collect()}
    got = trigrams.cascade(df, path, query)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_reads_posting_lists_only(spark, indexed):
    df, path = indexed
    total = spark.read.parquet(f"{path}/manifest").count()
    assert total > 12
    found = trigrams.holding(spark, path, "de zon")
    files = trigrams.files_of(spark, path, [g for _, g in trigrams.covering("de zon")])
    assert 0 < len(files) <= total / 3 and all("/rows/" in f for f in found.inputFiles()) and len(found.inputFiles()) == len(files)
    assert spark.read.parquet(f"{path}/manifest").agg(F.max("rows")).first()[0] < 4000  # a letter that is everywhere fills several files


def test_covering():
    for n in range(1, 15):
        text = "abcdefghijklmno"[:n]
        grams = trigrams.covering(text)
        assert {i + j for i, g in grams for j in range(len(g))} == set(range(n)) and all(text[i:].startswith(g) for i, g in grams)


def test_empty_table(spark, tmp_path, indexed):
    none = indexed[0].limit(0)
    trigrams.save(none, str(tmp_path / "none"), 4)
    assert trigrams.cascade(none, str(tmp_path / "none"), "a").count() == 0


def test_texts_are_filed_once_and_files_grow_in_number(spark, tmp_path, monkeypatch):
    """Copies of a name add members and no postings; more rows make more files, not larger ones."""
    one = spark.range(50).select(F.col("id").alias("place_id"), F.concat(F.lit("Camping "), F.col("id")).alias("naam"), F.lit("Zeeland").alias("provincie"))
    many = one.crossJoin(spark.range(40).toDF("i")).select((F.col("place_id") + 50 * F.col("i")).alias("place_id"), "naam", "provincie")
    assert trigrams.postings(many).count() == trigrams.postings(one).count()
    monkeypatch.setattr(trigrams, "ROWS", 200)
    trigrams.save(many, str(tmp_path / "many"), 4)
    for manifest in ("manifest", "members-manifest"):
        assert spark.read.parquet(str(tmp_path / "many" / manifest)).agg(F.max("rows")).first()[0] < 600
    assert {r.place_id for r in trigrams.cascade(many, str(tmp_path / "many"), "g 17").collect()} == {17 + 50 * i for i in range(40)}
    hits = trigrams.holding(spark, str(tmp_path / "many"), "g 17")
    opened = trigrams.members(spark, str(tmp_path / "many"), hits).inputFiles()
    assert 0 < len([f for f in opened if "/members/" in f]) <= 2
    assert trigrams.cascade(many, str(tmp_path / "many"), "zeeland").count() == 2000
