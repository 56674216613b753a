"""Windows, benchmark passages and quality rules against plain Python."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.fixtures import ALNUM, documents, empty, table, words
from waypost.llm import decontaminate, near_dup, quality, substring
from waypost.llm import words as W


def test_words_and_windows_of_a_batch():
    texts = ["Ab  c\td", None, "", "é\x0bx", "last"]
    found = W.words_of(pa.array(texts), fold=True)
    assert [
        bytes(found.data[a:b]).decode() for a, b in zip(found.start, found.end)
    ] == ["ab", "c", "d", "é", "x", "last"]
    assert found.counts.tolist() == [3, 0, 0, 2, 1]
    assert W.window_starts(found.first, 2).tolist() == [0, 1, 3]
    h = found.hashes()
    again = W.words_of(pa.array(["zz ab c", "c d"])).hashes()
    assert W.rolling(h, 2)[0] == W.rolling(again, 2)[1] and W.rolling(h, 2)[1] == W.rolling(again, 2)[3]


def test_long_words_hash_by_content():
    long = "a" * (3 * W.LONG + 5)
    for second in (False, True):
        h = W.words_of(pa.array([f"x {long} y", f"{long}", long[:-1] + "b"])).hashes(second)
        assert h[1] == h[3] and h[1] != h[4]


def test_words_of_all_lengths_hash_apart():
    some = [c * n for n in range(1, 2 * W.LONG) for c in "ab\xe9"] + [f"{i:x}" for i in range(50_000)]
    some = sorted(set(some))
    for second in (False, True):
        found = W.words_of(pa.array([" ".join(some)]))
        assert len(np.unique(found.hashes(second))) == len(some)
        alone = [int(W.words_of(pa.array([f"z {w}"])).hashes(second)[1]) for w in some[::997]]
        assert alone == found.hashes(second)[::997].tolist()


@pytest.mark.parametrize("k", [1, 2, 5, 8, 10, 50, 64])
def test_rolling_is_the_polynomial(k):
    h = np.random.default_rng(k).integers(0, 2**64, size=40_000, dtype=np.uint64)
    for second in (False, True):
        got, base = W.polynomials(h, k, second), W._BASES[second]
        for i in (0, 1, 32_767, 32_768, len(got) - 1):
            assert int(got[i]) == sum(int(x) * pow(base, t, W.PRIME) for t, x in enumerate(h[i : i + k].tolist())) % W.PRIME


def mirrored(n, letters="ab"):
    """A Thue-Morse word of ``n`` letters and its complement: any polynomial of them modulo 2 ** 64 is the same."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


@pytest.mark.parametrize("n", [512, 1024, 2048])
def test_mirrored_words_differ_everywhere(spark, n):
    """Operators 3, 7, 8, 9 and 10 tell apart words, and sequences of words, that modular hashes take for equal."""
    one, two = mirrored(n)
    assert W.words_of(pa.array([f"{one} {two}"])).hashes().tolist()[0] != W.words_of(pa.array([two])).hashes()[0]
    common = " ".join(f"w{i}" for i in range(49))
    docs = table(spark, [(1, f"{common} {one}"), (2, f"{common} {two}")])
    assert [r.n_removed for r in substring.remove_repeats(docs).collect()] == [0, 0]
    short = table(spark, [(1, one), (2, two)])
    assert {r.doc_id: r.component_id for r in near_dup.link(short, shingle_words=2).collect()} == {1: 1, 2: 2}
    items = spark.createDataFrame([(1, f"a b c d e f g h i {one}"), (2, one)], "item_id long, text string")
    hit = decontaminate.contamination(table(spark, [(1, f"a b c d e f g h i {two}"), (2, two)]), items)
    assert [r.n_hit for r in hit.collect()] == [0, 0]
    lines = table(spark, [(1, f"{one}\n{two}\n"), (2, " ".join([*"abcdefg", one, *"abcdefg", two]))])
    assert {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in quality.host_rules(lines).collect()} == {1: (0, 0), 2: (0, 0)}
    _, names = np.unique(W.words_of(pa.array([f"{one} {two} {one}"])).hashes(), return_inverse=True)
    assert names[0] == names[2] != names[1]  # as the toxicity models number words
    said = [" ".join(x) for x in mirrored(n)]
    texts = spark.createDataFrame([(1, said[0]), (2, said[1])], "doc_id long, text string")
    assert [r.n_removed for r in substring.remove_repeats(texts, k=n).collect()] == [0, 0]


def removed(rows, k):
    first, texts = {}, {i: words(t) for i, t in rows}
    for i in sorted(texts):
        for j in range(len(texts[i]) - k + 1):
            first.setdefault(tuple(texts[i][j : j + k]), i)
    out = {}
    for i, w in texts.items():
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone.update(range(j, j + k))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("k", [50, 7])
def test_repeated_windows_go(spark, k):
    rows = documents()
    got = substring.remove_repeats(table(spark, rows), k=k).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == removed(rows, k)
    for r in got:
        assert sum(x.to_word - x.from_word for x in r.removed) == r.n_removed


def test_repeats_small_blocks_and_odd_rows(spark, monkeypatch):
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(None, same), (4, same), (4, same), (6, same), (8, None)]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(table(spark, rows)).collect())
    assert got == Counter({(None, 60, 0): 1, (4, 60, 0): 2, (6, 60, 60): 1, (8, 0, 0): 1})
    assert substring.remove_repeats(empty(spark)).count() == 0


def test_packed_columns_come_back():
    a, b = np.array([1, 2**63, 5], dtype=np.uint64), np.array([-1, 0, 7], dtype=np.int64)
    x, y = substring.unpack(substring.pack(a, b), np.uint64, np.int64)
    assert x.tolist() == a.tolist() and y.tolist() == b.tolist()


def contaminated(rows, items, n=10):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t, ALNUM, True)
        m = min(n, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[j : j + m])].add(i)
    out = {}
    for i, t in rows:
        w, hit, names = words(t, ALNUM, True), set(), set()
        for m in {len(x) for x in windows}:
            for j in range(len(w) - m + 1):
                if found := windows.get(tuple(w[j : j + m])):
                    hit.update(range(j, j + m))
                    names |= {str(x) for x in found if x is not None}
        out[i] = (len(w), len(hit), sorted(names))
    return out


def benchmark_of(rows):
    texts = [t for _, t in rows if t and len(t.split()) > 50]
    items = [(i, " ".join(t.split()[i : i + 15 + i])) for i, t in enumerate(texts[:12])]
    return [*items, (77, "One"), (78, None), (79, ""), (3, "two words"), (None, texts[3]), (80, "Two, words!")]


@pytest.mark.parametrize("broadcast_bytes", [1 << 24, 0])
def test_benchmark_windows(spark, broadcast_bytes):
    rows = documents()
    items = benchmark_of(rows)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = decontaminate.contamination(table(spark, rows), bench, broadcast_bytes=broadcast_bytes).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == contaminated(rows, items)


def test_benchmark_joined_as_broadcast(spark):
    """Copies of texts and of items, and the intervals of hits, come out of the joins as out of a broadcast."""
    rows = [(i + 1000 * copy, t) for copy in range(3) for i, t in documents()] + [(None, "one and One"), (5, None)]
    items = benchmark_of(documents()) * 2 + [(900 + i, "One") for i in range(40)]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), table(spark, rows)
    both = [
        Counter((r.doc_id, r.n_words, r.n_hit, str(r.hits), tuple(r["items"])) for r in decontaminate.contamination(docs, bench, broadcast_bytes=size).collect())
        for size in (1 << 24, 0)
    ]
    assert both[0] == both[1] and len(both[0]) > 100
    assert decontaminate.clean(docs, bench, broadcast_bytes=0).count() == decontaminate.clean(docs, bench).count() < docs.count()
    assert decontaminate.contamination(empty(spark), bench, broadcast_bytes=0).count() == 0


def test_benchmark_edges(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = table(spark, documents())
    assert decontaminate.contamination(docs, bench).filter("n_hit > 0").count() == 0
    assert decontaminate.clean(docs, bench).count() == docs.count()
    one = spark.createDataFrame([(1, "one")], "item_id long, text string")
    left = decontaminate.clean(table(spark, [(1, "ONE more"), (1, "else"), (None, "one"), (2, "none")]), one)
    assert [r.doc_id for r in left.collect()] == [2] and left.columns == docs.columns
    assert decontaminate.contamination(empty(spark), one).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_winnowing_keeps_a_fingerprint_in_every_window(seed):
    rng = np.random.default_rng(seed)
    first = np.array([0, 40, 40, 49, 120])
    hashes = rng.integers(0, 2**64, 120, dtype=np.uint64)
    starts = W.window_starts(first, 5)
    chosen = set(starts[decontaminate.winnowed(first, W.rolling(hashes, 5)[starts], starts, 5, 10)].tolist())
    for s in W.window_starts(first, 10):
        assert any(int(s) + i in chosen for i in range(6))


def measured(text, k=8):
    w = words(text)
    grams = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    repeated = {j for i in range(len(w) - k + 1) if grams[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(
        c in "#*$%&|<>" for c in text or ""
    ), len(lines) - len(set(lines)), len(repeated)


def test_quality_measures(spark):
    rows = documents()
    got = {
        r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        for r in quality.measures(table(spark, rows)).collect()
    }
    assert got == {i: measured(t) for i, t in rows}


def test_host_verdicts(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "short"
    rows = [
        (i, bad if i % 10 else good) for i in range(100)
    ] + [(100 + i, good) for i in range(100)] + [(300, bad), (301, good)]
    source = lambda i: "bad" if i < 100 else "good" if i < 200 else None
    got = {r.doc_id: r for r in quality.host_rules(table(spark, rows, source)).collect()}
    assert not got[0].base_failed and got[0].host_rejected and not got[0].kept
    assert got[150].kept and got[301].kept and not got[300].kept
    assert quality.host_rules(empty(spark)).count() == 0


def test_rows_without_doc_id_are_cleaned_one_by_one(spark):
    item = " ".join(f"word{i}" for i in range(12))
    docs = table(spark, [(None, item), (None, "something else"), (1, item), (2, "two words")])
    kept = decontaminate.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.text for r in kept.collect()) == ["something else", "two words"] and kept.columns == docs.columns


@pytest.mark.parametrize("ranges", [1, 16])
def test_repeats_of_many_documents_in_ranges(spark, monkeypatch, ranges):
    """Blocks of few windows, so that ranges get rows of many blocks; rows without doc_id in great number."""
    monkeypatch.setattr(substring, "RANGES", ranges)
    rng = np.random.default_rng(4)
    passages = [" ".join(f"p{j}x{i}" for i in range(9)) for j in range(5)]
    rows = [
        (
            int(i),
            " ".join(
                [
                    *(f"d{i}w{x}" for x in range(6)), passages[i % 5], *(f"e{i}w{x}" for x in range(4)),
                    passages[int(rng.integers(5))]
                ]
            )
        )
        for i in rng.permutation(400)
    ]
    flood = [(None, passages[0] + f" n{i}") for i in range(200)]
    got = substring.remove_repeats(table(spark, [*rows, *flood]).repartition(6), k=7).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got if r.doc_id is not None} == removed(rows, 7)
    assert sum(r.doc_id is None and r.n_removed == 0 for r in got) == 200
