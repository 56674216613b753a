"""The toxicity model against a plain reading of class-conditional Kneser-Ney."""

import random
import zlib
from collections import Counter, defaultdict
from math import log

import pyarrow as pa
import pytest
from tests.llm.fixtures import ALNUM, table, words
from waypost.llm import toxicity

N = 6


def grams(word):
    raw = b"\x01" * (N - 1) + word.encode() + b"\x02"
    return [raw[i : i + N] for i in range(len(raw) - N + 1)]


class Plain:
    def __init__(self, rows, toxic):
        count = {True: Counter(), False: Counter()}
        for i, text in rows:
            for word in set(words(text, ALNUM, fold=True)):
                count[toxic[i]].update(grams(word))
        every = set(count[True]) | set(count[False])
        self.shared = [{}]
        for order in range(1, N):
            longer = {g[-order - 1 :] for g in every}
            seen = Counter(g[1:] for g in longer)
            once, twice = sum(c == 1 for c in seen.values()), sum(c == 2 for c in seen.values())
            d = once / (once + 2 * twice) if once else 0.5
            total, kinds = Counter(), Counter()
            for g, c in seen.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            lower = lambda g, order=order: self.shared[order - 1][g[1:]] if order > 1 else 1 / 256
            self.shared.append(
                {
                    g: max(c - d, 0) / total[g[:-1]] + d * kinds[g[:-1]] / total[g[:-1]] * lower(g) for g,
                    c in seen.items()
                }
            )
        least = min(sum(c.values()) for c in count.values())
        self.known, self.context = defaultdict(float), defaultdict(float)
        for sign, own in ((1, count[True]), (-1, count[False])):
            share = least / sum(own.values())
            total, over = Counter(), Counter()
            for g in every:
                total[g[:-1]] += own[g] * share
                over[g[:-1]] += max(own[g] * share - 1.5, 0)
            rest = {c: min(1, max(1e-6, 1 - over[c] / max(total[c], 1e-9))) for c in {g[:-1] for g in every}}
            for g in every:
                c = g[:-1]
                self.known[g] += sign * log(
                    max(own[g] * share - 1.5, 0) / max(total[c], 1e-9) + rest[c] * self.shared[N - 1][g[1:]]
                )
            for c, r in rest.items():
                self.context[c] += sign * log(r)

    def features(self, text):
        values = sorted(
            (
                sum(self.known[g] if g in self.known else self.context.get(g[:-1], 0.0) for g in grams(w))
                for w in set(words(text, ALNUM, fold=True))
            ),
            reverse=True
        )
        return [sum(values) / max(1, len(values)), *(sum(values[:k]) / k for k in (1, 3, 8, 20))]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    sound = ["an", "er", "tion", "the", "re", "ing", "é", "zz"]
    word = lambda: "".join(rng.choice(sound) for _ in range(rng.randint(1, 4)))
    rows, toxic = [], {}
    for i in range(160):
        own = [word() for _ in range(rng.randint(3, 60))]
        toxic[i] = rng.random() < 0.35
        if toxic[i]:
            own += [rng.choice(["IDIOT", "idiots!", "qukz"]) for _ in range(3)]
        rows.append((i, " ".join(own)))
    rows += [
        (500, None), (501, ""), (502, "?! --"), (503, "unheard-of idiocy " * 3), (7, "a repeated id"), (504, "tie tie"),
        (505, "tie")
    ]
    labels = [(i, int(t), "clash") for i, t in toxic.items()] + [
        (3, 1, "again"), (3, 0, "again"), (900, 1, "no document"), (None, 1, "no id"), (4, None, "no label"),
        (500, 1, "empty")
    ]
    toxic[3], toxic[500] = True, True
    return rows, toxic, table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, text string")


@pytest.mark.parametrize("max_grams", [2_000_000, 10])
def test_features_and_scores(tables, max_grams):
    rows, toxic, docs, labels = tables
    learned = [(i, t) for i, t in rows if i in toxic and zlib.crc32(str(i).encode()) % 4 != 2]
    plain = Plain(learned, toxic)
    model = toxicity.train(docs, labels, max_grams=max_grams)
    want = [plain.features(t) for _, t in rows]
    if isinstance(model, toxicity.Model):
        assert set(model.grams.tolist()) == {int.from_bytes(g, "big") for g in plain.known}
        assert model.features(pa.array([t for _, t in rows])).ravel().tolist() == pytest.approx(
            [x for row in want for x in row], abs=1e-4
        )
    curve = lambda x: 1 / (
        1
        + 2.718281828459045 ** -(
            sum((a - c) / s * w for a, c, s, w in zip(x, model.centre, model.spread, model.weights)) + model.weights[-1]
        )
    )
    got = defaultdict(list)
    for r in toxicity.score(docs, labels, max_grams=max_grams).collect():
        got[r.doc_id].append(r.score)
    wanted = defaultdict(list)
    for (i, _), x in zip(rows, want, strict=True):
        wanted[i].append(curve(x))
    assert {i: sorted(x) for i, x in got.items()} == {i: pytest.approx(sorted(x), abs=1e-3) for i, x in wanted.items()}
    assert got[500] == got[501] == got[502] and got[504] == got[505]
