"""Main text of pages: golden markup, alignment and pairing against plain Python, and truth known from the markup."""

import html
import os
import random
import re
from functools import cache

import pytest

from trapline.llm import page_text
from trapline.llm.urls import split_url

A = "<article>{}</article>"
GOLDEN = [
    ("", ""),
    ("no markup  at\n all", "no markup at all"),
    ("<article><h1>T &amp; U</h1><p>a  b\n\tc<p>d &lt;b&gt; &#233;&eacute;&nbsp;x</article>", "T & U\na b c\nd <b> éé x"),
    ("<nav><ul><li><a>m</a></ul></nav>" + A.format("<p><b>one<br><p>two") + "<footer>f</footer>", "one\ntwo"),
    ("<header>h</header><main><p>x</p><aside>s</aside><form>q<input><button>go</button></form><p>y</main>", "x\ny"),
    (A.format("<p>a</p><div class='post ad-box'>buy</div><div id=cookieNotice>ok?</div><p>b") + "<div class=comments><article>r</article></div>", "a\nb"),
    (A.format("<p>x<script>var t='</p><p>no';</script>y<style>p{}</style><!-- <p>c</p> --><noscript><p>n</noscript> z"), "x y z"),
    ("<head><title>t</title><meta x='>'></head><body>" + A.format("a<sup>2</sup> b<i>c</i>"), "a2 bc"),
    ("<div class=sidebar-left><article><p>kept</article></div><article>second</article>", "kept\nsecond"),
    (A.format("<header><h1>Title</h1><p>by me</p></header><p>t"), "Title\nt"),
    (A.format("<ul><li>a<li>b<ul><li>c</ul><li class=ad>n<li>d</ul>"), "a\nb\nc\nd"),
    (A.format("<table><tr><td>1<td>2<tr><td>3</table>"), "1\n2\n3"),
    (A.format("1 < 2 &amp;lt; &unknown; &copy"), "1 < 2 &lt; &unknown; ©"),
    (A.format("<p class=notice>gone<p>stays"), "stays"),
    (A.format("<p>a<span class='ad'>b</span>c"), "a\nc"),
    ("<article class=comment>r</article><article>a</article>", "a"),
    ("<body><p>a<div hidden>h</div><p>b<p> </p><!-- open", "a\nb"),
    ("<script>never closed <p>x", ""),
    ("<head><title>a</title><body><p>b", "b"),
]


@pytest.mark.parametrize("page, text", GOLDEN)
def test_lines(page, text):
    assert "\n".join(page_text.main_lines(page, [])) == text


def test_long_page():
    page = A.format("".join(f"<p>line {i} <b>&amp;</b>" for i in range(20_000)))
    assert page_text.main_lines(page, []) == [f"line {i} &" for i in range(20_000)]


def brute_length(a, b):
    @cache
    def longest(i, j):
        if i == len(a) or j == len(b):
            return 0
        return longest(i + 1, j + 1) + 1 if a[i] == b[j] else max(longest(i + 1, j), longest(i, j + 1))

    return longest(0, 0)


def test_longest_common_subsequence():
    rng = random.Random(0)
    for n in (0, 1, 2, 5, 30):
        for _ in range(60):
            a, b = ([rng.randrange(6) for _ in range(rng.randrange(n + 1))] for _ in range(2))
            found = page_text.shared(a, b)
            rest = iter(b)
            assert sorted(set(found)) == found and all(a[i] in rest for i in found) and len(found) == brute_length(a, b)


def brute_template(pages):
    """Template lines of every page: neighbours of its path in plain Python, alignment by ``shared``."""
    by_host = {}
    for url, page in pages:
        host, path = split_url(url)
        by_host.setdefault(host, {}).setdefault(path, []).append(page)
    out = []
    for url, page in pages:
        host, path = split_url(url)
        paths = sorted(by_host[host], key=str.encode)
        at = paths.index(path)
        near = [paths[i] for i in (at - 1, at + 1) if 0 <= i < len(paths)] if host else []
        near.sort(key=lambda p: -len(os.path.commonprefix([p, path])))
        mine = [line for line, _ in page_text.lines_of(page or "")]
        gone = []
        for p in near:
            assert len(set(by_host[host][p])) == 1
            other = [line for line, _ in page_text.lines_of(by_host[host][p][0] or "")]
            found = page_text.shared(mine, other)
            size = lambda lines: sum(len(x.encode()) for x in lines)
            if 100 * size([mine[i] for i in found]) < page_text.VERSIONS * max(size(mine), size(other)):
                gone = found
                break
        out.append(page_text.main_lines(page or "", gone))
    return out


def texts_of(spark, pages):
    rows = [(i, u, h, "x") for i, (u, h) in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, key string").repartition(4)
    got = page_text.main_text(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {r.page_id: r for r in got.collect()}
    assert all(found[i].url == u and found[i].n_chars == len(found[i].text) for i, (u, _) in enumerate(pages))
    return [found[i].text for i in range(len(pages))]


def test_differencing(spark):
    """Pages without any declared element: the host's lines go, each page's own lines stay."""
    rng = random.Random(3)
    pages, wanted = [], []
    for host in ("one.example", "two.example", "lonely.example"):
        top, bottom = [f"{host} menu {k}" for k in range(3)], [f"{host} imprint {k}" for k in range(2)]
        for n in range(1 if host == "lonely.example" else 25):
            own = [f"{host} text {n} line {k} " + " ".join(rng.choices("abcdefgh", k=20)) for k in range(rng.randrange(4, 9))]
            pages.append((f"http://{host.upper()}/a/{n}.html?x={n}", "".join(f"<div>{html.escape(x)}</div>" for x in [*top, *own, *bottom])))
            wanted.append("\n".join(own if host != "lonely.example" else [*top, *own, *bottom]))
    got = texts_of(spark, pages)
    assert got == wanted == ["\n".join(x) for x in brute_template(pages)]


def test_versions_and_articles_keep_shared_lines(spark):
    same = "".join(f"<p>line {k} of a long text that both pages hold" for k in range(9))
    pages = [("http://h/a", same), ("http://h/b", same + "<p>new"), ("http://h/c", same), ("http://h/c", same)]
    pages += [("http://g/1", "<div>menu</div><article><p>shared passage<p>one</article>"), ("http://g/2", "<div>menu</div><article><p>shared passage<p>two</article>")]
    pages += [("no host", "<p>x"), ("no host", "<p>x"), (None, "<p>y"), ("http://h/z", None), ("http://h/zz", "")]
    got = texts_of(spark, pages)
    text = "\n".join(f"line {k} of a long text that both pages hold" for k in range(9))
    assert got == [text, text + "\nnew", text, text, "shared passage\none", "shared passage\ntwo", "x", "x", "y", "", ""]


def test_pages(spark, folder):
    """The given pages say where their article is, so the truth can be read from them by another path."""
    rows = spark.read.parquet(f"{folder}/pages.parquet")
    found = {r.page_id: r.text for r in page_text.main_text(rows).collect()}
    for row in rows.collect():
        article = row.html[row.html.index("<article>") + 9 : row.html.rindex("</article>")]
        blocks = [html.unescape(re.sub(r"<[^>]*>", "", b)) for b in re.split(r"</?(?:p|h1)>", article)]
        assert found[row.page_id] == "\n".join(" ".join(b.split()) for b in blocks if b.strip())


def test_no_rows(spark):
    assert page_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
