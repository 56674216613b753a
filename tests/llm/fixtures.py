"""Small tables with the awkward cases, and plain-Python readings of the contracts."""

from __future__ import annotations

import random
import re

UPPER = {c: c + 32 for c in range(65, 91)}
SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, key int, size string"


def words(text, pattern=SPACED, fold=False):
    text = text or ""
    return re.findall(pattern, text.translate(UPPER) if fold else text)


def documents(seed=3, families=6):
    """(doc_id, text) rows: copies, near copies, shared passages, nulls, blanks, long and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, texts = some(60), []
    for _ in range(families):
        base = some(rng.randint(60, 140))
        texts.append(" ".join(base))
        for changes in (0, 1, 3, 6, 12):
            own = list(base)
            for _ in range(changes):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    texts += [
        " ".join(some(30) + passage + some(20)), "\n".join(some(5) + passage) + "\n", " ".join(passage),
        " ".join(some(3000)), "x " * 200, "A B a b A B"
    ]
    texts += [
        None, "", "   \t\n", "one", "ONE", "two words", "\x00 odd \x0b\x0c chars #*$%&|<>",
        "line\nline\n\nline\n other", "é" * 50
    ]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    return rows


def table(spark, rows, source=lambda i: None if i is None or i % 5 == 0 else f"s{i % 3}"):
    whole = [(i, t, "en", source(i), len(t or ""), "clash", 1, "clash") for i, t in rows]
    return spark.createDataFrame(whole, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
