"""The style tree against a plain reading of it, on random sites."""

import random
from collections import Counter, defaultdict
from math import log

import pytest
from waypost.llm import html_text as H


def site(rng, host, n):
    """``n`` pages of one template; of each part the text is fixed, drawn from few, or new on every page."""
    tags = [
        "div", "section", "p", "aside", "nav", "article", "div class='menu'", "div class='text'", "main",
        "span class='share'", "header", "ul", "li"
    ]

    def part(depth):
        kids = [part(depth + 1) for _ in range(rng.randint(1, 3))] if depth < 3 and rng.random() < 0.6 else []
        return rng.choice(tags), rng.choice(
            ["fixed", "few", "new", "new"]
        ), rng.randint(1, 30), kids, rng.random() < 0.2

    def written(x, page):
        tag, kind, size, kids, optional = x
        if optional and rng.random() < 0.4:
            return ""
        key = {"fixed": 0, "few": page % 3, "new": page * 1000 + rng.randrange(999)}[kind]
        words = " ".join(f"{tag[:3].strip()}{size}w{key}x{i}" for i in range(size))
        return f"<{tag}>{words}{''.join(written(k, page) for k in kids)}</{tag.split()[0]}>"

    top = [part(0) for _ in range(rng.randint(2, 5))]
    return [
        (f"https://{host}/{i}", "<html><body>" + "".join(written(x, i) for x in top) + "</body></html>")
        for i in range(n)
    ]


def entropy(counts, base):
    total = sum(counts)
    return -sum(c / total * log(c / total) for c in counts) / log(base)


def plain(pages, threshold=0.2):
    """Texts of (url, html) rows of one host, by dictionaries of nodes."""
    cut = [H.parsed(html) for _, html in pages]
    lane = lambda b: [*b.chain, ("leaf", b.chain[-1] if b.chain else b.role)]
    has, orders, texts, words, blocks = defaultdict(set), defaultdict(dict), defaultdict(
        lambda: defaultdict(set)
    ), Counter(), Counter()
    below = defaultdict(set)
    for i, page in enumerate(cut):
        for b in page:
            way = lane(b)
            n = len(b.text.split())
            for j, x in enumerate(way):
                has[x].add(i)
                words[x] += n
                blocks[x] += 1
                below[x].add(way[-1])
                if j < len(way) - 1:
                    order = orders[x].setdefault(i, [])
                    if not order or order[-1] != way[j + 1]:
                        order.append(way[j + 1])
                else:
                    orders[x][i] = [*orders[x].get(i, []), "block"]
            texts[way[-1]][b.text].add(i)
    value = {}
    for x, on in has.items():
        m = len(on)
        if m < 2:
            continue
        content = lambda y: 1 - sum(
            entropy([1] * len(p), len(has[y])) for p in texts[y].values()
        ) / len(texts[y]) if len(has[y]) > 1 else 1.0
        shown = entropy(Counter(map(repr, orders[x].values())).values(), m)
        value[x] = 0.9 * sum(words[y] * content(y) for y in below[x]) / words[x] + 0.1 * shown
    out = []
    for page in cut:
        landmark = any(b.role == 2 for b in page)
        around = {x for b in page if b.role == 2 for x in lane(b) if x[1] != 2 and x[0] != "leaf"}

        def weak(x, role):
            if x in around:
                return False
            if role == 2:
                return x in value and (value[x] * len(has[x]) + 4) / (len(has[x]) + 4) < threshold
            if role == 1 and not landmark:
                return x in value and value[x] < threshold
            prior = {0: 0.24, 1: 0.4, 3: 0.26 if landmark else 0.3, 4: 0.1}[role]
            size = words[x] / blocks[x]
            return x not in value or prior * value[x] * size / (size + 8) < threshold

        judged = []
        for b in page:
            roles = [*(r for _, r in b.chain), b.role]
            lows = [r for x, r in zip(lane(b), roles) if weak(x, r)]
            judged.append((b, any(r != 2 for r in lows), 2 in lows))
        lively = any(b.role == 2 and not gone and not faded for b, gone, faded in judged)
        out.append("\n".join(b.text for b, gone, faded in judged if not gone and not (lively and faded)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_pages_of_random_sites(spark, seed):
    rng = random.Random(seed)
    sites = {f"h{k}.org": site(rng, f"h{k}.org", rng.choice([1, 2, 9, 25])) for k in range(12)}
    rows = [(k * 1000 + i, url, html) for k, pages in enumerate(sites.values()) for i, (url, html) in enumerate(pages)]
    want = {k * 1000 + i: text for k, pages in enumerate(sites.values()) for i, text in enumerate(plain(pages))}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.main_text(pages).collect()}
    assert got == want
    assert {r.page_id: r.text for r in H.main_text(pages, max_nodes=0).collect()} == want
    # the tree decides: with the mark-up alone other texts come out
    alone = {i: "\n".join(b.text for b in H.parsed(html) if b.role in (1, 2)) for i, _, html in rows}
    assert got != alone


def test_low_branches_go_with_what_is_below(spark):
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    notice = "Fixed words that every page has, many of them, " * 6
    rows = [
        (
            i, f"http://h/{i}",
            f"<article><p>{words(i)}</p><div class='box'><p>{notice}</p><ul><li>new {i}</ul></div></article>"
        )
        for i in range(60)
    ]
    got = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: words(i) for i in range(60)}


def test_deep_and_long_pages(spark):
    deep = "<div>" * 5000 + "core" + "</div>" * 5000
    long = "<article>" + "<p>" + "word " * 200_000 + "</p>" + "<p>more</p>" * 20_000 + "</article>"
    open_ = "<b><i class='x'>" * 20_000 + "end"
    rows = [(1, "http://h/1", deep), (2, "http://h/2", long), (3, None, open_), (3, None, open_)]
    got = sorted(
        (r.page_id, r.text)
        for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    )
    assert got[0] == (1, "core") and got[2:] == [(3, "end"), (3, "end")]
    assert len(got[1][1].split()) == 220_000
