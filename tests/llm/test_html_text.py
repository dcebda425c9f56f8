import random
import time

import pytest

from quillstream.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{x:1}}</style><script>var t="</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href="/a">Home</a></li><li>About {0}</li></ul></nav><div class="ad">Buy {0}</div><article><h1>Head {0}</h1><p>First&nbsp;&amp; <b>second</b>
  third {0}.<br><p>Same words on all pages.</p><form><input>Mail</form><section class="comments"><p>Nice!</p></section></article>
<aside>Side {0}</aside><footer>&copy; {0}</footer></body></html>"""


def extract(spark, rows):
    return {(r.page_id, r.url): r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}


def test_keeps_the_article_alone(spark):
    rows = [(i, f"http://a.org/en/{i}?q=1", PAGE.format(i), "x") for i in range(30)] + [(99, "http://b.org/", PAGE.format(99), "x")]
    found = extract(spark, rows)
    for i, url, *_ in rows:
        assert found[i, url] == f"Head {i}\nFirst & second third {i}.\nSame words on all pages."


def test_shared_lines_go_where_nothing_marks_the_article(spark):
    page = "<body><div>Welcome to us</div><div>{0} is told here at length.</div><div>And more of {0}.</div><div>Contact us</div></body>"
    found = extract(spark, [(i, f"http://a.org/{i}", page.format(f"Story {i}"), "") for i in range(5)])
    assert found[2, "http://a.org/2"] == "Story 2 is told here at length.\nAnd more of Story 2."
    copy = extract(spark, [(i, f"http://a.org/{i}", page.format("One story"), "") for i in range(2)])
    assert copy[0, "http://a.org/0"].count("\n") == 3  # a copy of its neighbour is no furniture


def test_differencing_decides_in_pages_with_an_article(spark):
    page = "<body><nav>Home</nav><article><h1>Head {0}</h1><p>Of {0} is told.</p><p>{1}</p><div class='more'>{2}</div></article></body>"
    rows = [(i, f"http://a.org/{i}", page.format(i, "A passage that all have.", "Read on at our site"), "") for i in range(3)] + [(9, "http://b.org/9", page.format(9, "A passage that all have.", "Read on at our site"), "")]
    found = extract(spark, rows)
    assert found[1, "http://a.org/1"] == "Head 1\nOf 1 is told.\nA passage that all have."  # running text stays, the shared box goes
    assert found[9, "http://b.org/9"].endswith("\nRead on at our site")  # no neighbour shows what is furniture


@pytest.mark.parametrize("open_tags", ['<div class="content has-sidebar"><article>', '<article class="post comments-open">', '<article class="share-price">', '<div id="wrapper" class="nav-open"><main>', '<div class="sidebar"><article class="comment">'])
def test_names_never_delete_the_only_article(open_tags):
    page = f'<body><div class="site-footer">Foot</div>{open_tags}<h1>Head</h1><p>Text of it.</p><section class="comment-list">Nice!</section>'
    assert h.main_text(h.lines_of(page), []) == "Head\nText of it."


def test_names_are_believed_where_another_article_is_left():
    page = '<body><div class="related-box"><article><p>Teaser</p></article></div><div class="cookie_banner">Ok?</div><article><p>Text.</p><article class="comment">Nice!</article></article>'
    assert h.main_text(h.lines_of(page), []) == "Text."


@pytest.mark.parametrize("part", ["<a ", "<a '", '<a "', "<div>x", "</p>", "<", "<!--", "<script ", "</script ", "<a \"'>", "<div></p>", "<p class='menu-menu-", "&amp", "<title>"])
def test_broken_markup_takes_one_pass(part):
    began = time.perf_counter()
    h.main_text(h.lines_of("<p>one</p>" + part * (1_000_000 // len(part))), [])
    assert time.perf_counter() - began < 5


def test_quotes_comments_and_raw_text():
    page = """<p title="a > b">one</p><!-- <p>no</p> --><p data-x='"'>two</p><script>if (a < b) "</p>"</script ><p>3 < 4 &lt; 5</p><p>six <b"""
    assert [x.text for x in h.lines_of(page)] == ["one", "two", "3 < 4 < 5", "six <b"]


def test_pages_of_one_address_differ(spark):
    rows = [(1, "http://a/1", f"<p>Text {k} of the one address.</p>", None) for k in range(3)] + [(None, "http://a/1", "<p>No id.</p>", None)]
    out = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(r.text for r in out) == ["No id.", *(f"Text {k} of the one address." for k in range(3))]


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("bits", [h.TRACE_BITS, 20])
def test_common_is_a_longest_common_subsequence(seed, bits, monkeypatch):
    monkeypatch.setattr(h, "TRACE_BITS", bits)
    rng = random.Random(seed)
    a, b = ([rng.randrange(5) for _ in range(rng.randrange(30))] for _ in range(2))
    places = sorted(h.common(a, b))
    part, it = [a[i] for i in places], iter(b)
    assert all(x in it for x in part) and len(part) == lcs(a, b)


def test_awkward_pages(spark):
    rows = [(1, None, None, None), (2, "http://a/1", "", None), (3, "no url", "plain &lt;b&gt; text", None), (4, "http://a/2", "<p>unclosed <b>tag", None), (5, "http://a/2", "<!-- open", None),
            (6, "HTTP://A/3", "<p>" * 2000 + "x", None), (7, "http://a/4", "<script>alert(1)", None), (8, "http://a/4", "<p>dup</p>", None), (8, "http://a/4", "<p>dup</p>", None), (None, "http://a/5", "<p>no id</p>", None)]
    out = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, rank string")).collect()
    by = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and by[1] == "" and by[2] == "" and by[3] == "plain <b> text" and by[4] == "unclosed tag" and by[7] == "" and by[6] == "x"
    assert all(r.n_chars == len(r.text) for r in out)
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
