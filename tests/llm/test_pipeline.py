"""Every stage of the pipeline against brute force over its own input."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests.llm.fixtures import SCHEMA, table, words
from tests.llm.test_files_and_mix import levels
from tests.llm.test_kneser_ney import Plain
from tests.llm.test_near_dup import brute
from tests.llm.test_text_operators import contaminated
from waypost.llm import toxicity
from waypost.llm.catalog import tokenizer_path


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean and toxic documents, exact and near copies, benchmark passages, rows without id or text."""
    rng = random.Random(11)
    vocabulary = [
        "".join(rng.choice(["ka", "lo", "mi", "ru", "te", "é"]) for _ in range(rng.randint(2, 4))) for _ in range(900)
    ]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(12 + i % 9))) for i in range(15)] + [(77, "Short one"), (78, None)]
    rows, toxic = [], {}
    for i in range(260):
        own = some(rng.randint(40, 160))
        toxic[i] = rng.random() < 0.25
        if toxic[i]:
            for _ in range(5):
                own[rng.randrange(len(own))] = rng.choice(["vermin", "Worthless!", "scumbag", "scumbags"])
        elif i % 13 == 0:
            own[20:20] = items[i % 15][1].split()
        rows.append((i, " ".join(own)))
    for i in range(0, 60, 3):
        copy = rows[i][1].split()
        if i % 2:
            copy[rng.randrange(len(copy))] = "changed"
        rows.append((1000 + i, " ".join(copy)))
    rows += [
        (None, "a row without id " + " ".join(some(30))), (None, "vermin scumbag worthless vermin"), (2000, None),
        (2001, ""), (2002, "Short one"), (7, rows[7][1])
    ]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = table(spark, rows)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(
        [(i, 1, int(t)) for i, t in toxic.items()], "doc_id long, quality int, toxic int"
    ).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, rows, toxic, items


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def key(row):
    return (row[0] is not None, row[0] or 0, row[1] or "")


def test_stages_against_brute_force(spark, corpus):
    import corpus_pipeline as pipeline

    folder, docs, rows, toxic, items = corpus
    stage = dict(pipeline.STAGES)
    assert list(stage) == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]

    # toxicity: plain Kneser-Ney features under the fitted curve
    plain = Plain([(i, t) for i, t in rows if i in toxic and zlib.crc32(str(i).encode()) % 4 != 2], toxic)
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    z = lambda t: sum(
        (a - c) / s * w for a, c, s, w in zip(plain.features(t), model.centre, model.spread, model.weights)
    ) + model.weights[-1]
    bad = {i for i, t in rows if i is not None and 1 / (1 + np.exp(-z(t))) >= 0.3}
    want = sorted(
        [(i, t) for i, t in rows if (i not in bad if i is not None else 1 / (1 + np.exp(-z(t))) < 0.3)], key=key
    )
    got = stage["toxicity"](spark, docs, folder)
    assert got.columns == docs.columns and sorted(rows_of(got), key=key) == want
    assert len([i for i in bad if toxic.get(i)]) > 0.9 * sum(toxic.values()) and len(want) > 150

    # near duplicates: all pairs
    named = [(i, t) for i, t in want if i is not None]
    kept = {i for i, (_, c) in brute(named, 5).items() if i == c}
    want = [(i, t) for i, t in want if i is None or i in kept]
    got = stage["near_duplicates"](spark, spark.createDataFrame(got.collect(), SCHEMA), folder)
    assert got.columns == docs.columns and sorted(rows_of(got), key=key) == want and len(want) < len(named)

    # decontamination: all windows
    hit = {i for i, (_, n, _) in contaminated([x for x in want if x[0] is not None], items).items() if n}
    hit |= {i for i, t in want if i is None and contaminated([(0, t)], items)[0][1]}
    want = [(i, t) for i, t in want if i not in hit]
    got = stage["decontamination"](spark, spark.createDataFrame(got.collect(), SCHEMA), folder)
    assert got.columns == docs.columns and sorted(rows_of(got), key=key) == want and hit

    # mixing: whole documents, none more than twice, each source near its target
    source = {(r.doc_id, r.text): r.source for r in got.collect()}
    mixed = stage["mixing"](spark, spark.createDataFrame(got.collect(), SCHEMA), folder)
    copies = Counter(rows_of(mixed))
    before = Counter(want)
    assert mixed.columns == docs.columns and set(copies) <= set(before) and all(
        n <= 2 * before[x] for x, n in copies.items()
    )
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for x in want:
        sizes[source[x]] += len(words(x[1]))
        longest[source[x]] = max(longest[source[x]], len(words(x[1])))
    for x, n in copies.items():
        taken[source[x]] += n * len(words(x[1]))
    target = levels(sizes, (3, 1, 2), 1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - target[s]) <= longest[s] + 16 for s in sizes)

    # token files: the tokenizer on whole texts
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    read = stage["token_files"](spark, mixed, folder).orderBy("start").collect()
    base, crcs = 0, defaultdict(Counter)
    for i, t in rows_of(mixed):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        crcs[i][len(ids), zlib.crc32(ids.tobytes())] += 1
    for r in read:
        assert r.start == base and crcs[r.doc_id][r.n_tokens, r.ids_crc32] > 0
        crcs[r.doc_id][r.n_tokens, r.ids_crc32] -= 1
        base += r.n_tokens
    assert len(read) == sum(copies.values()) and [r.doc_id for r in read] == sorted(
        (r.doc_id for r in read), key=lambda i: (i is not None, i or 0)
    )


def test_run_gives_what_the_stages_give(spark, corpus):
    import corpus_pipeline as pipeline

    folder, docs, *_ = corpus
    for _, step in pipeline.STAGES:
        docs = step(spark, docs, folder)
    assert Counter(map(tuple, docs.collect())) == Counter(map(tuple, pipeline.run(spark, folder).collect()))
