"""Names, raw elements and broken tags of real mark-up: what the article keeps and what it doesn't."""

import random

import pytest
from waypost.llm import html_text

DROPPED = """user-comments comment-body post-comments fb-comments commentlist comments-area disqus_thread comment-form ad-slot google-ad
ads-wrapper adsbygoogle sponsored-content promo-box advert-text cookie-policy-bar cookie-notice gdpr-consent newsletter-form newsletter
subscribe-box post-footer article-footer footer-links site-footer post-navigation main-menu navbar-inner breadcrumb-trail share-buttons
social-links related-posts recommended sidebar-right login-form contact-form popup-inner top-notice alert-banner commentBody adUnit""".split()
KEPT = """article-body entry-content post-text story lead intro summary caption quote chapter section-title has-sidebar no-ads comments-open
ad-free with-menu menu-open entry-header article-header post-title paragraph recipe-steps content-inner layout-left column-main wrapper
body-text adagio admin shadow loads header-text formula platform informed commentary-free navy-blue socialism-essay""".split()


def page(i, names, rng):
    """(html, text): an article with a block of each name in it and after it."""
    say = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 12, 60])))
    inner, outer, text = [], [], []
    for name in names:
        words = say()
        attribute = rng.choice(["class", "id"])
        inner.append(f"<div {attribute}='{name}'>{words}</div>")
        if name in KEPT:
            text.append(words)
        else:
            outer.append(f"<section {attribute}={name}><p>{say()}</p></section>")
    first, last = say(), say()
    html = f"<html><body class='has-sidebar'><div id=wrapper><article><p>{first}</p>{''.join(inner)}<p>{last}</p></article>{''.join(outer)}</div></body></html>"
    return html, "\n".join([first, *text, last])


WORDS = [f"{a}{b}" for a in ("ka", "to", "mi", "re", "su") for b in ("lo", "nen", "dar", "vi", "pos", "tul")]


@pytest.mark.parametrize("hosts", [1, 40])
def test_names_of_real_markup(spark, hosts):
    """Pages of one host and of many: each name is dropped or kept, whatever its texts."""
    assert len(DROPPED) + len(KEPT) >= 60
    rng = random.Random(hosts)
    rows, want = [], {}
    for i in range(40):
        html, want[i] = page(i, rng.sample(DROPPED, 8) + rng.sample(KEPT, 8), rng)
        rows.append((i, f"https://h{i % hosts}.org/{i}", html, "own", "own"))
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string, nodes string")
    assert {r.page_id: r.text for r in html_text.main_text(docs).collect()} == want


@pytest.mark.parametrize("name", DROPPED)
def test_outright_names(name):
    assert html_text._outright(name) or html_text._hints(name.lower())


@pytest.mark.parametrize("name", KEPT)
def test_other_names(name):
    assert not html_text._outright(name) and not html_text._hints(name)


@pytest.mark.parametrize(
    "html, text",
    [
        ("<script src='a'/>alert(1)</script>story", "story"), ("<style/>p{color:red}</style>story", "story"),
        ("<p>a <svg viewBox='0 0 1 1'/> b</p>", "a b"), ("<math/>x<p>y", "x\ny"), ("<video/>no film</video>story", "story"),
        ('<a title="bad>text</a> more', "text more"), ("<p class='x>one<p>two", "one\ntwo"), ('<b title="a > b">bold</b>', "bold"),
        ("<label>Your name</label>story", "story"), ("a < b and c > d", "a < b and c > d"), ("<p>x</p><textarea/>y</textarea>z", "x\nz"),
        ("<article class='sponsored'>story</article>", "story"), ("<div class=comments><article>story</article></div>", "story"),
        ("<div id='main' class='main has-sidebar'>story</div>", "story"), ("<h1 class='entry-header'>head</h1>", "head"),
    ]
)
def test_raw_elements_and_broken_tags(spark, html, text):
    docs = spark.createDataFrame([(1, "https://a.org/", html)], "page_id long, url string, html string")
    assert [r.text for r in html_text.main_text(docs).collect()] == [text]
