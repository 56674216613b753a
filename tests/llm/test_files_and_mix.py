"""Round trips of token files and archives, and the mix."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.fixtures import documents, empty, table, words
from waypost.llm import mixing, token_files, warc
from waypost.llm.catalog import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_units_encode_like_whole_texts(tokenizer):
    odd = [
        "a  b\n\n c\t\td ' 's don't  ", "x\xa0y z", "a　b", "<|endoftext|> hi<|endoftext|>", "  lead", "trail  ", "",
        "\n", "a\r\nb", "é è w 123abc!!! ...", "don't,can't 'tis a'b's", "x…,y—z;", "abc123 1,234.5 ½¾ ñ́a",
        "日本語,テスト abc日本", "×÷ a×b", "a\x0bb c\x1cd"
    ]
    encoder = token_files.Encoder(tokenizer_path())
    for _ in range(2):
        assert encoder.encode(odd) == [
            np.array(x.ids, dtype="<u2").tobytes() for x in tokenizer.encode_batch(odd, add_special_tokens=False)
        ]


def test_token_files_round_trip(spark, tokenizer):
    rows = [*documents(), (None, "no id"), (7, "again")]
    manifest = token_files.write_tokens(table(spark, rows), tokenizer_path(), shards=5)
    got = token_files.read_tokens(manifest).orderBy("start").collect()
    base, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, base, len(ids), np.array(ids, dtype="<u4").tobytes()))
        base += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got] == want
    total = manifest.agg(F.sum("tokens")).first()[0]
    assert total == base
    shard = manifest.first()
    mapped = token_files.Shard(shard.path, shard.width)
    assert isinstance(mapped.mapped, np.memmap) and mapped.offsets[-1] == shard.tokens
    assert token_files.read_tokens(token_files.write_tokens(empty(spark), tokenizer_path())).count() == 0


PAGES = [
    (1, "u", "<p>a</p>"), (2, None, "<p>a</p>"), (2, "v", "<p>a</p>"), (3, "x\r\ny", None), (4, "", ""),
    (None, "n", "<p>a</p>"), (9, "é", "é" * 1000)
]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame(
        [(*p, "clash") for p in PAGES], "page_id long, url string, html string, record_type string"
    )
    index = warc.write_archive(pages)
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    a, none, e = b"<p>a</p>", b"", ("é" * 1000).encode()
    got = Counter(tuple(r) for r in warc.summaries(index).collect())
    assert got == Counter(
        [
            (1, 8, sha(a), "response", None), (2, 8, sha(a), "revisit", 1), (2, 8, sha(a), "revisit", 1),
            (None, 8, sha(a), "response", None), (3, 0, sha(none), "response", None), (4, 0, sha(none), "revisit", 3),
            (9, 2000, sha(e), "response", None)
        ]
    )
    payloads = Counter((r.page_id, bytes(r.payload)) for r in warc.reconstructed(index).collect())
    assert payloads == Counter((i, (h or "").encode()) for i, _, h in PAGES)
    stored = index.filter("record_type = 'response'").count()
    assert stored == 4
    assert warc.summaries(warc.write_archive(pages.limit(0))).count() == 0


def test_min_bytes_and_repeats_of_one_row(spark):
    pages = spark.createDataFrame(
        [(1, "u", "ab"), (1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")],
        "page_id long, url string, html string"
    )
    kinds = lambda n: Counter(
        (r.page_id, r.record_type) for r in warc.summaries(warc.write_archive(pages, min_bytes=n)).collect()
    )
    assert kinds(0) == Counter(
        {(1, "response"): 1, (1, "revisit"): 1, (2, "revisit"): 1, (3, "response"): 1, (4, "revisit"): 1}
    )
    assert kinds(5) == Counter({(1, "response"): 2, (2, "response"): 1, (3, "response"): 1, (4, "revisit"): 1})


def test_damaged_archives_are_refused(spark, tmp_path):
    import gzip
    import io

    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"
    with pytest.raises(ValueError, match="length"):
        list(warc.records(io.BytesIO(gzip.compress(record))))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records(io.BytesIO(gzip.compress(record)[:-12])))


def levels(sizes, weights, total):
    """Water filling by rounds, as the contract tells it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, total
    while True:
        free = [s for s in names if s not in full]
        if not free:
            return full
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 2 * sizes[s]
        left = total - sum(full.values())


@pytest.mark.parametrize("shard_docs", [20_000, 3])
def test_mix_hits_its_targets(spark, shard_docs):
    rows = [*documents(families=12), (None, "a b c"), (7, "again again")]
    docs = table(spark, rows)
    got = mixing.mix(docs, shard_docs=shard_docs).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
    want = levels(sizes, (3, 1, 2), 1.5 * sum(sizes.values()))
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s, target in want.items():
        assert abs(taken[s] - target) <= 8 * (1 + len(rows) / shard_docs)
    again = mixing.mix(docs.repartition(7), shard_docs=shard_docs).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(empty(spark)).count() == 0


def test_sainte_lague_is_highest_quotients(spark):
    votes = {1: 53.0, 2: 24.0, 3: 23.0, 4: 0.0, 5: 7.5, 6: 7.5}
    items = spark.createDataFrame(
        [(0, k, v, n) for n in (1,) for k, v in votes.items()], "g int, item int, votes double, seats long"
    )
    for seats in (0, 1, 7, 40, 1001):
        got = {
            r.item: r.quota
            for r in mixing.sainte_lague(
                items.withColumn("seats", F.lit(seats).cast("long")), ["g"], "item", "votes", "seats"
            ).collect()
        }
        ranked = sorted(((-v / (2 * k + 1), i) for i, v in votes.items() if v for k in range(seats + 1)))[:seats]
        assert got == {i: sum(x == i for _, x in ranked) for i in votes}


def test_mixed_rows_carry_what_is_taken(spark):
    rows = documents(families=12)
    docs = table(spark, rows)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    want = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
    assert dict(got) == want
    assert zlib.crc32(b"") == 0


def test_no_mixed_text_is_a_beginning(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(40 + i % 60))) for i in range(300)]
    docs = table(spark, [*rows, (None, "a b c"), (None, "d e f g"), (7, "again again"), (900, None)])
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    kept = mixing.mixed(docs, whole=True).collect()
    copies = Counter((r.doc_id, r.text) for r in kept)
    assert set(copies) <= set(texts) and all(c <= 2 for c in copies.values())
    assert len({r.doc_id for r in kept}) < 300 and max(copies.values()) == 2
    taken, got, longest = Counter(), Counter(), defaultdict(int)
    for r in mixing.mix(docs).collect():
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for r in kept:
        got[r.source] += len(words(r.text))
    assert all(abs(got[s] - taken[s]) <= longest[s] + 16 for s in taken)
    cut = [r for r in mixing.mixed(docs).collect() if (r.doc_id, r.text) not in texts]
    assert cut and any(not (dict(rows)[r.doc_id] + " ").startswith(r.text + " ") for r in cut)
    assert mixing.mixed(empty(spark), whole=True).count() == 0


def test_texts_with_added_tokens_are_encoded_whole():
    own = token_files.Encoder(tokenizer_path())
    texts = ["x\n\n<|endoftext|>y", "a  <|endoftext|> b", "plain words"]
    assert own.encode(texts) == own._raw(texts)


def test_files_below_a_named_root_keep_their_tables(spark, tmp_path):
    """Manifest and index stay with the files; a payload of megabytes comes back whole."""
    root = f"file://{tmp_path}"
    docs = table(spark, [(1, "one two"), (2, None)])
    manifest = token_files.write_tokens(docs, tokenizer_path(), root=f"{root}/tokens")
    again = spark.read.parquet(f"{root}/tokens/manifest")
    assert sorted(map(str, again.collect())) == sorted(map(str, manifest.collect())) and token_files.read_tokens(again).count() == 2
    long = "<p>" + "long payload " * 500_000
    pages = spark.createDataFrame([(1, "http://a/", long), (2, "http://b/", long), (3, "http://c/", "x")], "page_id long, url string, html string")
    index = warc.write_archive(pages, root=f"{root}/warc")
    assert spark.read.parquet(f"{root}/warc/index").count() == 3
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.summaries(index).collect()}
    assert got == {1: (len(long), "response", None), 2: (len(long), "revisit", 1), 3: (1, "response", None)}
    assert {r.page_id: bytes(r.payload).decode() for r in warc.reconstructed(index).collect()} == {1: long, 2: long, 3: "x"}
