"""Clashing column names, floods of rows without doc_id, repeated rows and very long texts, for all text operators."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.fixtures import documents, table
from waypost.llm import decontaminate, mixing, near_dup, quality, substring, token_files, toxicity
from waypost.llm.catalog import tokenizer_path

CLASHES = [
    "row_", "id_", "bad_", "unnamed_", "copies_", "copy_", "words_", "size", "a", "b", "n", "q", "u", "nth", "name",
    "doc", "shard", "position", "salt", "kept", "score", "predicted", "hits", "items", "rep", "key"
]


def clashing(spark):
    rows = [
        *documents(families=3), (None, "no id one"), (None, "no id two"), (4, "twice the same row"),
        (4, "twice the same row")
    ]
    docs = table(spark, rows)
    return docs.select(*[c for c in docs.columns if c not in CLASHES], *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(1009)], "doc_id long, toxic int")


@pytest.mark.parametrize(
    "stage",
    [
        lambda spark, d: toxicity.without_toxic(d, labels(spark)),
        lambda spark, d: near_dup.near_duplicates(d),
        lambda spark, d: decontaminate.clean(d, spark.createDataFrame([(1, "ONE")], "item_id long, text string")),
        lambda spark, d: mixing.mixed(d, whole=True),
        lambda spark, d: mixing.mixed(d),
    ],
)
def test_stages_keep_clashing_columns(stage, spark):
    docs = clashing(spark)
    out = stage(spark, docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHES)


def test_operators_ignore_clashing_columns(spark):
    docs = clashing(spark)
    n = docs.count()
    for out in (
        mixing.mix(docs), near_dup.link(docs), substring.remove_repeats(docs), quality.host_rules(docs),
        toxicity.score(docs, labels(spark)), token_files.tokens_of(spark, docs, tokenizer_path()),
        decontaminate.contamination(docs, docs.select(F.col("doc_id").alias("item_id"), "text", "hits", "n"))
    ):
        assert out.count() == n


def test_rows_without_id_fill_many_shards(spark):
    texts = [f"text {i}" for i in range(600)]
    docs = table(spark, [*((None, t) for t in texts), (1, "named")])
    manifest = token_files.write_tokens(docs, tokenizer_path(), shards=6)
    assert manifest.count() > 3 and manifest.agg(F.max("docs")).first()[0] < 400
    got = token_files.read_tokens(manifest).orderBy("start").collect()
    own = token_files.Encoder(tokenizer_path())
    assert got[-1].doc_id == 1 and {r.doc_id for r in got[:-1]} == {None}
    end = np.array([2], "<u4").tobytes()
    wide = lambda raw: np.frombuffer(raw, own.type).astype("<u4").tobytes()
    assert Counter(bytes(r.ids) for r in got) == Counter(wide(x) + end for x in own.encode([*texts, "named"]))
    shards = mixing._placed(
        docs, shard_docs=50, keep=()
    ).filter("doc_id is null").select("position", "shard").distinct().count()
    assert shards > 5


@pytest.fixture(scope="module")
def long_docs(spark):
    words = " ".join(f"word{i % 5000}" for i in range(400_000))
    return table(
        spark,
        [
            (1, words), (2, words.upper()), (3, "x" * 3_000_000), (4, "\n" * 2_000_000), (5, "#" * 1_000_000),
            (6, "short one")
        ]
    )


def test_very_long_texts(spark, long_docs):
    from tokenizers import Tokenizer

    tokens = {
        r.doc_id: r
        for r in token_files.tokens_of(spark, long_docs.filter("doc_id in (1, 6)"), tokenizer_path())
        .withColumn("crc", F.crc32("ids"))
        .collect()
    }
    text = {r.doc_id: r.text for r in long_docs.collect()}
    ids = np.array([*Tokenizer.from_file(tokenizer_path()).encode(text[1], add_special_tokens=False).ids, 2], "<u4")
    assert tokens[1].n_tokens == len(ids) and tokens[1].crc == zlib.crc32(ids.tobytes())
    hit = decontaminate.contamination(
        long_docs,
        spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(10, 30)))], "item_id long, text string")
    )
    assert {r.doc_id: r.n_hit for r in hit.collect()} == {1: 1600, 2: 1600, 3: 0, 4: 0, 5: 0, 6: 0}
    rules = {r.doc_id: r for r in quality.host_rules(long_docs).collect()}
    assert rules[1].n_repeat_words == 400_000 and rules[3].word_chars == 3_000_000 and rules[5].n_symbols == 1_000_000 and rules[4].n_words == 0
    left = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(long_docs).collect()}
    assert left[1] == (400_000, 0) and left[2] == (400_000, 0) and left[4] == (0, 0)
    assert {
        r.doc_id: r.size for r in mixing.mix(long_docs).collect()
    } == {1: 400_000, 2: 400_000, 3: 1, 4: 0, 5: 1, 6: 2}
    scores = toxicity.score(
        long_docs, spark.createDataFrame([(1, 0), (3, 1), (6, 1), (5, 0)], "doc_id long, toxic int")
    ).collect()
    assert len(scores) == 6 and all(0 <= r.score <= 1 for r in scores)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from waypost.sources import scratch

    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn", getConf=lambda: conf))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        scratch.shared_folder(cluster)


def test_passing_tables_go(spark):
    from waypost.llm.shared import lasting, passing, stored

    df = spark.range(3)
    with passing():
        gone = stored(df, "gone")
        with passing():
            left = lasting(df, "inner")
            inner = stored(df, "inner")
        assert gone.count() == left.count() == 3
    files = lambda x: [f.removeprefix("file://") for f in x.inputFiles()]
    import os

    assert not any(os.path.exists(f) for x in (gone, inner, left) for f in files(x))
