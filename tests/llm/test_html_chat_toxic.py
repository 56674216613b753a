"""Main text, tool calls, toxicity and the pipeline."""

import json
import random

import pytest
from tests.conftest import SF
from tests.llm.fixtures import SCHEMA, empty, table
from waypost.llm import html_text, tool_calls, toxicity

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body class="home">
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home {i}</a></ul></nav><div id="cookie-notice">We use cookies {i}</div>
<article><header><h1>Head {i}</h1></header><p>First &amp; <b>bold {i}<br>text</b>
 more&nbsp;here<p>Second &lt;b&gt; {i}<aside>side {i}</aside><div class="share-buttons">share {i}</div><section id="comments"><p>comment {i}</section></article>
<aside class="sidebar">aside {i}</aside><form><input value="x">Sign up {i}</form><div class="ad">Buy {i}</div><footer>&copy; {i}</footer></body></html>"""


def test_article_without_the_rest(spark):
    rows = [(i, f"https://h.org/{i}", PAGE.replace("{i}", str(i)), "clash") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert got == {i: f"Head {i}\nFirst & bold {i} text more here\nSecond <b> {i}" for i in range(8)}


def test_style_tree_drops_what_repeats(spark):
    body = '<div class="x">Welcome to our site</div><div class="c"><p>Story {i} begins</p><p>and ends {i}</p></div><div class="y">All rights</div>'
    rows = [
        (i, f"http://h/{i}", body.replace("{i}", str(i))) for i in range(12)
    ] + [(50, "http://one/", body), (51, None, body)]
    got = {
        r.page_id: r.text
        for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    }
    assert got[3] == "Story 3 begins\nand ends 3"
    assert got[50].startswith("Welcome") and got[51].startswith("Welcome")


def texts_of(spark, body, n=20):
    long = lambda i, k: " ".join(f"word{i}x{k}x{j}" for j in range(60))
    rows = [
        (i, f"http://h/{i}", body.replace("{i}", str(i)).replace("{long}", long(i, 0)).replace("{other}", long(i, 1)))
        for i in range(n)
    ]
    got = {
        r.page_id: r.text
        for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    }
    return got[3].replace(long(3, 0), "LONG").replace(long(3, 1), "OTHER")


def test_style_tree_overrules_the_mark_up_both_ways(spark):
    teaser = '<article class="card"><h3>Teaser {i}</h3></article><div class="text"><p>{long}</p></div><div class="date">today {i}</div>'
    assert texts_of(spark, teaser) == "Teaser 3\nLONG"
    assert texts_of(
        spark, '<article><p>{long}</p><div class="box9">Read our magazine every week</div></article>'
    ) == "LONG"
    assert texts_of(spark, '<div class="widget"><p>{long}</p></div><div class="widget">more {i}</div>') == "LONG"


@pytest.mark.parametrize(
    "body",
    [
        "<article class='post tag-politics'><p>{long}</p></article>",
        "<div class='content no-sidebar'><p>{long}</p></div>", "<main class='comments-open'><p>{long}</p></main>",
        "<article class='related'><p>{long}</p></article>",
        "<div class='sidebar'><nav>menu {i}</nav><article><p>{long}</p></article></div>"
    ]
)
def test_hints_are_whole_names_and_yield_to_articles(body):
    html = body.replace("{long}", "story")
    assert [b.text for b in html_text.parsed(html) if b.role in (1, 2)] == ["story"]


def test_headlines_in_articles_stay():
    html = "<article><header class='entry-header'><h1 class='post-header'>Head</h1></header><p>a</p><div class='share-buttons'>share</div></article><div class='site-header'>Site</div><div class='comment-list'><article class='comment'>c</article></div>"
    assert [(b.role, b.text) for b in html_text.parsed(html)] == [
        (2, "Head"), (2, "a"), (4, "share"), (3, "Site"), (4, "c")
    ]


def test_copied_articles_stay(spark):
    rows = [(i, f"http://h/{i}", "<article><p>Same story.</p></article>") for i in range(6)]
    assert {
        r.text
        for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    } == {"Same story."}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("a < b &am; <", "a < b &am; <"),
        ("<!-- x", ""), ("<p>a</p><foo", "a"), ("<ul><li>x<li>y</ul>z", "x\ny\nz"), ("<script>a<b", ""),
        ("</p></div>q", "q"), ("<p title='a>b'>c</p>", "c")
    ]
)
def test_odd_markup(html, text):
    assert "\n".join(b.text for b in html_text.parsed(html or "") if b.role) == text


def test_empty_pages(spark):
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


CHAT = [
    (1, 0, "user", 'hi "x"\n'),
    (1, 1, "assistant", json.dumps({"content": "ok", "tool_calls": [{"id": "a", "name": "add", "arguments": {"y": 2, "x": 1}}, {"id": "b", "function": {"name": "add", "arguments": '{"x": "1"}'}}]})),
    (1, 2, "tool", '{"tool_call_id": "a", "content": "3"}'),
    (1, 3, "tool", '{"tool_call_id": "zz", "content": "3"}'),
    (2, 0, "tool", '{"tool_call_id": "q", "content": "early"}'),
    (2, 1, "assistant", '{"tool_calls": [{"id": "q", "name": "add", "arguments": {"x": 1, "y": 2.5}}, {"id": "q", "name": "nope", "arguments": "bad"}]}'),
    (3, 0, "user", '{"content": "a"} and more'),
    (None, None, None, None),
    (3, 0, "user", "{not json"),
]


def test_tool_calls(spark):
    schemas = tool_calls.tool_schemas(
        spark,
        {
            "add": {
                "type": "object", "properties": {"x": {"type": "integer"}, "y": {"type": "number"}},
                "required": ["x", "y"]
            }
        }
    )
    messages = spark.createDataFrame(
        [(*c, 0) for c in CHAT], "conv_id long, turn long, role string, text string, valid int"
    )
    got = tool_calls.events(messages, schemas).orderBy("conv_id", "order_turn", "order_kind", "order_index").collect()
    assert [(r.conv_id, r.turn, r.kind, r.call_id, r.linked, r.valid) for r in got] == [
        (None, None, "message", None, None, None),
        (1, 0, "message", None, None, None),
        (1, 1, "message", None, None, None),
        (1, 1, "call", "a", True, True),
        (1, 1, "call", "b", False, False),
        (1, 2, "result", "a", True, None),
        (1, 3, "result", "zz", False, None),
        (2, 1, "message", None, None, None),
        (2, 1, "call", "q", True, True),
        (2, 1, "call", "q", False, False),
        (2, 0, "result", "q", True, None),
        (3, 0, "message", None, None, None),
        (3, 0, "message", None, None, None),
    ]
    for r in got:
        assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
    assert tool_calls.events(messages.limit(0), schemas).count() == 0


def abusive(seed=1, n=700):
    rng = random.Random(seed)
    syllables = ["an", "er", "tion", "the", "re", "ing", "on", "st", "ou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        own = [word() for _ in range(rng.randint(20, 200))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(2, 6)):
                own[rng.randrange(len(own))] = rng.choice(["idiot", "qukz" + word(), "Worthless,"])
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = abusive()
    truth = dict(labels)
    table_of_labels = spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int")
    docs = table(spark, [*rows, (None, "idiot"), (5000, None), (5001, "")])
    got = toxicity.score(docs, table_of_labels).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert {r.predicted for r in got if r.doc_id in (5000, 5001)} == {0}


def test_toxicity_counts_all_grams_at_any_size(spark):
    rows, labels = abusive(n=300)
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = table(spark, [*rows, (5000, None), (5001, ""), (5002, "zzzyx idiot")])
    small, large = (
        {r.doc_id: r.score for r in toxicity.score(docs, labels, max_grams=n).collect()} for n in (2_000_000, 100)
    )
    assert large == pytest.approx(small, abs=1e-3)
    assert len(toxicity.train(docs, labels).grams) == len(toxicity.train(docs, labels, max_rows=20).grams)


def test_rows_without_doc_id_are_judged_one_by_one(spark):
    rows, labels = abusive(n=300)
    docs = table(spark, [*rows, (None, "idiot idiot"), (None, "the ring on"), (None, None)])
    kept = toxicity.without_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == docs.columns
    assert sorted(str(r.text) for r in kept.filter("doc_id is null").collect()) == ["None", "the ring on"]


def test_held_out_labels_are_never_read(spark):
    import zlib

    rows, labels = abusive(n=300)
    docs = table(spark, rows)
    flip = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    scores = [
        {r.doc_id: r.score for r in toxicity.score(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()}
        for x in (labels, flip)
    ]
    assert scores[0] == scores[1]


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(table(spark, [(1, "a")]), none).collect()} == {0.0}
    assert toxicity.score(empty(spark), none).count() == 0


def test_pipeline_runs_and_each_stage_keeps_the_columns(spark):
    import corpus_pipeline as pipeline

    from waypost.llm.shared import stored
    from waypost.llm.shared import table as read

    docs = read(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
    assert 0 < docs.select("doc_id").distinct().count() <= n
    out = pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
