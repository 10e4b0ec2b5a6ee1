import html
import math
import re
from collections import Counter, defaultdict

from issuelens.llm import html_extract as M

SF = "/root/testdata/sf0.01"
PAGE = "page_id long, url string, html string, text string"


def test_presentation_is_removed():
    page = """<!DOCTYPE html><HTML><head><title>T</title><script>var a = "</p><b>";</script></head><body>
    <header class="site"><a href=x>Home</a></header><div class="cookie-notice">Accept</div><nav><ul><li>m<li>n</ul></nav>
    <div id=main><article><header><h1>A &amp;  B</h1></header><p>One &lt;b&gt; two<br>three<p>Fo<b>u</b>r <!-- no --> five
    <ul><li>x<li>y</ul><aside>see also</aside><form>mail <input> <button>ok</button></form>
    <section class="comments"><p>first!</p></section><div class="share-bar">s</div><p hidden>h</p></article></div>
    <div class="sidebar">side</div><footer>&copy; us</footer>"""
    assert M.main_text(page) == "A & B\nOne <b> two three\nFour five\nx\ny"


def test_broken_and_empty_pages():
    assert M.main_text(None) == M.main_text("") == M.main_text("<p>") == M.main_text("<script>x") == ""
    assert M.main_text("just text &am") == "just text &am"
    assert M.main_text("<p>a < b</p><div>c<span>d</div>e</span>") == "a < b\ncd\ne"
    assert M.main_text('<p title="a>b">x<p title="open>y') == "x\ny"
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert M.main_text(deep) == "x"


def expected(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in M.query(spark, SF).collect():
        assert r.text == expected(pages[r.page_id]) and r.n_chars == len(r.text)


def test_style_tree_removes_what_a_host_repeats(spark):
    def page(i, host):
        # nothing names the second div's purpose: only its sameness on the host's pages does
        return (i, f"http://{host}/{i}", f"<html><body><div class=c><p>text {i} of {host}</p><p>more {i * 7}</p></div>"
                f"<div class=x><p>All about our shop</p></div></body></html>", "clash")

    rows = [page(i, "a.example") for i in range(8)] + [page(8, "b.example")]
    rows += [(20 + i, "http://copies.example/", "<html><body><div><p>same</p></div></body></html>", None) for i in range(6)]
    got = {r.page_id: r.text for r in M.extract(spark, spark.createDataFrame(rows, PAGE)).collect()}
    assert got[3] == "text 3 of a.example\nmore 21"
    assert got[8] == "text 8 of b.example\nmore 56\nAll about our shop"
    assert got[22] == "same"


def test_words_do_not_remove_what_differs_on_every_page(spark):
    def page(i, host):
        return (i, f"http://{host}/{i}", f"<html><body><div class=elementor-widget><p>text {i}</p>"
                f"<section id=related-work><p>work {i * 7}</p></section><span class=share>Share this</span>"
                "<div class=social><p>Follow us</p></div></div></body></html>", "")

    rows = [page(i, "a.example") for i in range(8)] + [page(8, "b.example")]
    rows += [(9, "http://c.example/", "<body><p>text</p><div class=widget>more</div></body>", "")]
    got = {r.page_id: r.text for r in M.extract(spark, spark.createDataFrame(rows, PAGE)).collect()}
    assert [got[i] for i in range(8)] == [f"text {i}\nwork {i * 7}" for i in range(8)]
    # one page of a host: words decide, unless they would take everything
    assert got[8] == "text 8\nwork 56"
    assert got[9] == "text"


def test_comments_and_notices_go_though_they_differ_on_every_page(spark):
    def page(i, inner):
        return (i, f"http://a.example/{i}", f"<html><body>{inner}</body></html>", "")

    rows = [page(i, f"<article><p>text {i}</p><p>more {i * 3}</p><section class=comments><p>reader {i} says {i * i}</p></section>"
                    f"</article><div class=cookie-notice>Accept {i} cookies</div>") for i in range(8)]
    rows += [page(10 + i, f"<article><p>story {i}</p><div class='share-box n{i}'>shared {i * 7} times</div></article>"
                          f"<div class=comments>reader 1{i} says no</div><div id=sponsored>buy {i}</div>") for i in range(8)]
    got = {r.page_id: r.text for r in M.extract(spark, spark.createDataFrame(rows, PAGE)).collect()}
    assert [got[i] for i in range(8)] == [f"text {i}\nmore {i * 3}" for i in range(8)]
    assert [got[10 + i] for i in range(8)] == [f"story {i}" for i in range(8)]
    # all that a page has stays, whatever it is called
    assert M.main_text("<body><div class=comments><p>only this</p></div></body>") == "only this"


def test_odd_rows(spark):
    long = "<article><p>" + "word " * 200_000 + "</p></article>"
    rows = [(1, None, None, "x"), (2, "", "", "x"), (None, "nonsense", "<p>a</p>", "x"), (3, "http://h/", long, "x"), (3, "http://h/", long, "x")]
    df = spark.createDataFrame(rows, PAGE)
    got = sorted(((r.page_id, r.n_chars) for r in M.extract(spark, df).collect()), key=str)
    assert got == sorted([(1, 0), (2, 0), (None, 1), (3, 999_999), (3, 999_999)], key=str)
    assert M.extract(spark, df.limit(0)).count() == 0


def test_importances_equal_plain_entropies(spark):
    def body(i):
        menu = "".join(f"<li>entry {k}</li>" for k in range(3 + (i % 4 == 0)))
        return (f"<html><body><ul class=menu>{menu}</ul><div id=story><h1>title {i}</h1><p>text {i // 2}</p></div>"
                f"<div class=footer2>{'old' if i % 3 else 'new'} words</div></body></html>")

    rows = [(i, f"https://{'a' if i < 9 else 'b'}.example/{i}", body(i), "") for i in range(15)]
    seen = defaultdict(Counter)
    for i, url, page, _ in rows:
        for path, (text, shape, named) in M.style_nodes(M.parse(page)).items():
            host = url[8:].split("/")[0]
            seen[host, path, named, "text"][text] += 1
            seen[host, path, named, "shape"][shape] += 1

    def entropy(c):
        m = sum(c.values())
        return -sum(n / m * math.log(n / m) for n in c.values()) / math.log(m) if m > 1 else 1.0

    want = {}
    for (host, path, named, kind), c in seen.items():
        if kind == "text" and sum(c.values()) >= M.MIN_PAGES:
            want[host, path, named] = (sum(c.values()), (1 - M.SHAPE_SHARE) * entropy(c)
                                       + M.SHAPE_SHARE * entropy(seen[host, path, named, "shape"]))
    got = {(r.host, bytes(r.path), r.named): (r.pages, r.importance) for r in M.style_tree(
        spark.createDataFrame(rows, PAGE)).collect() if bytes(r.path) != M.HOST}
    assert set(got) == set(want) and len(want) > 10
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
