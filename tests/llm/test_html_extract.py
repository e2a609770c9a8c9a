"""Main texts of pages: markup cases, wrapper induction, and whole tables."""

import html as library
import re
import time
from collections import Counter

import pytest
from conftest import SMALL

from assayline.llm import html_extract as h


def text_of(page):
    tree = h.parse(page)
    return h.content(tree, h.induce([tree])[0])


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("no markup, 1 < 2 & so", "no markup, 1 < 2 & so"),
        ("<article><h1>T&amp;c</h1><p>a  b\n c</p><p>d<br>e</article>", "T&c\n\na b c\n\nd e"),
        ("<article><p><b>One.<br><p>Two <i>and</i> three&nbsp;x</p></article><footer>f</footer>", "One.\n\nTwo and three x"),
        ("<nav><a href=/x>menu</a></nav><p>before<article>in</article><aside>s</aside>", "in"),
        ("<body><div class=ad>buy</div><p>text</p><div id='cookie-notice'>ok</div></body>", "text"),
        ("<main><p>t</p><section class='reader-comments'><article>c</article></section></main>", "t"),
        ("<article>a<script>var t='</p>';</script><style>p{}</style>b<!-- no > --><form>q</form></article>", "ab"),
        ("<form action=/x><article><p>page in a form</p></article></form>", "page in a form"),
        ("<article><header><p>by</p><h1>Head</h1></header><p>x</p></article>", "Head\n\nx"),
        ("<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>", "one\n\ntwo\n\na\n\nb\n\nc"),
        ("<p title='it's>quote</p><p class=\"a>b\">c</p>", "quote\n\nc"),
        ("<script>never ended <p>x", ""),
        ("&lt;b&gt; &#233; &eacute; &bogus; &#x1F600;", "<b> é é &bogus; 😀"),
        ("<div hidden>h</div><p>shown</p><div role=navigation>n</div>", "shown"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<p><a href=/a>all</a> <a href=/b>links</a></p><p>a text with <a href=/c>one</a></p>", "a text with one"),
        ("<div class='share-price'>12 EUR</div><div id='notice-board-history'>h</div><h2><a href=/x>T</a></h2>", "12 EUR\n\nh\n\nT"),
        ("<div class='cookie-notice'>c</div><div id=reader_comments>r</div><ul><li><a href=/m>m</a></ul><p>x</p>", "x"),
    ],
)
def test_markup(page, text):
    assert text_of(page) == text


def page_of(i, site="Acme news, the daily", legal="All rights reserved by Acme"):
    return (
        f"<html><body><div class=top><p>{site}</p></div><div class=body><h2>Story {i}</h2>"
        + "".join(f"<p>Sentence {j} of story number {i * 37 % 101}.</p>" for j in range(3 + i % 4))
        + "</div><div class=bottom><p>" + legal + "</p><p>Printed in town</p></div></body></html>"
    )


def wanted(i):
    return "\n\n".join([f"Story {i}", *(f"Sentence {j} of story number {i * 37 % 101}." for j in range(3 + i % 4))])


def test_constant_nodes_are_template_and_varying_ones_content():
    trees = [h.parse(page_of(i)) for i in range(12)]
    found = [h.content(t, x) for t, x in zip(trees, h.induce(trees), strict=True)]
    assert found == [wanted(i) for i in range(12)]


def texts_of(pages):
    trees = [h.parse(x) for x in pages]
    return [h.content(t, x) for t, x in zip(trees, h.induce(trees), strict=True)]


ODD = "<html><body><div class=top><p>Acme news, the daily</p></div><h1>404</h1><p>not found</p></body></html>"


@pytest.mark.parametrize("n", [4, 7, 12, 90])
@pytest.mark.parametrize("legal", ["All rights reserved by Acme", "A long legal line that says much. " * 40])
@pytest.mark.parametrize("odd", [[], [""], [ODD], ["", ODD, "just text"]])
def test_odd_pages_and_heavy_frames(n, legal, odd):
    """A null page, an error page, one without a frame, a frame longer than the articles: the others lose their frame all the same."""
    odd = odd[: max(1, n // 4)] if odd else []
    found = texts_of([page_of(i, legal=legal) for i in range(n)] + odd)
    assert found[:n] == [wanted(i) for i in range(n)]
    assert all(("not found" in t) == ("404" in x) for t, x in zip(found[n:], odd, strict=True))


def test_copies_tell_nothing():
    """Thirty near copies of one story and some others: the story stays, the frame goes."""
    near = [page_of(3).replace("Sentence 1 ", f"Sentence 1 ({k}) ") for k in range(30)]
    found = texts_of(near + [page_of(i) for i in range(8, 16)] + [page_of(3)] * 20)
    assert found[30:38] == [wanted(i) for i in range(8, 16)] and found[38:] == [wanted(3)] * 20
    assert found[:30] == [wanted(3).replace("Sentence 1 ", f"Sentence 1 ({k}) ") for k in range(30)]


def test_long_flat_pages_are_aligned_in_a_band():
    flat = lambda k, n: h.parse("<p>head</p>" + "".join(f"<p>post {k} {i}</p>" for i in range(n)) + "<div>foot</div><p>end</p>")
    started = time.process_time()
    _, pairs = h.match(flat(1, 2000), flat(2, 2200))
    assert time.process_time() - started < 5
    assert len(pairs) == 2003 and {"head", "foot", "end"} == {a.text for a, b in pairs if a.text == b.text}
    assert sorted(int(a.text.split()[2]) for a, _ in pairs if a.text.startswith("post")) == list(range(2000))


def test_equal_blocks_are_anchors():
    """Blocks that both pages have once are aligned wherever they are, between thousands of others."""
    one = "".join(f"<p>{i if i % 50 else f'same {i}'}</p>" for i in range(3000))
    other = "<p>new</p>" * 700 + "".join(f"<p>{-i if i % 50 else f'same {i}'}</p>" for i in range(3000))
    _, pairs = h.match(h.parse(one), h.parse(other))
    assert sum(a.text == b.text for a, b in pairs) == 60


def test_alignment_is_exact_where_all_is_compared():
    """Against matchings tried by brute force, on small lists of children."""

    def best(a, b):
        if not a or not b:
            return 0.0
        most = max(best(a[1:], b), best(a, b[1:]))
        return max(most, best(a[1:], b[1:]) + h._score(a[0], b[0])) if a[0].label == b[0].label else most

    tags = ["p", "ul", "div", "p"]
    for seed in range(60):
        rows = [[(seed * 31 + i * 17 + k * 7 + i * i * seed) % 11 for i in range(5)] for k in (1, 2)]
        one, other = (h.parse("".join(f"<{tags[x % 4]}>{x % 3}</{tags[x % 4]}>" for x in row)) for row in rows)
        pairs = h._aligned(one.children, other.children)
        assert sum(h._score(a, b) for a, b in pairs) == pytest.approx(best(one.children, other.children))
        assert h.match(one, other)[0] == pytest.approx(1 + best(one.children, other.children)) or one.digest == other.digest


def best_sum(a, b):
    """Of an alignment, from the table of all cells."""
    row = [0.0] * (len(b) + 1)
    for x in a:
        new = [0.0]
        for j, y in enumerate(b):
            new.append(max(new[j], row[j + 1], row[j] + h._score(x, y) if x.label == y.label else 0.0))
        row = new
    return row[-1]


def long_lists():
    """Hundreds of children, of which equal ones stand far from each other's places, and elements of many nodes."""
    entry = lambda k, i: f"<li><p>by {k} {i}</p><p>Reply</p><ul>{'<li>x</li>' * (i % 5)}<li>{k * i % 7}</ul></li>"
    common = "".join(f"<p>{i % 3}</p>" for i in range(150))
    yield common + "<div>a</div>" * 160, "<div>b</div>" * 160 + common
    yield "".join(entry(1, i) for i in range(190)), "".join(entry(2, i * 3) for i in range(40, 260))
    yield common + "".join(f"<p>mine {i}</p><h2>{i % 4}</h2>" for i in range(80)), "<h2>2</h2>" * 90 + common + "<ul><li>z</ul>" * 90


@pytest.mark.parametrize("case", range(3))
def test_long_lists_are_aligned_exactly(case, monkeypatch):
    one, other = (h.parse(x) for x in list(long_lists())[case])
    mine, theirs = one.children, other.children
    pairs = h._aligned(mine, theirs)
    assert sum(h._score(a, b) for a, b in pairs) == pytest.approx(best_sum(mine, theirs))
    ids = [(id(a), id(b)) for a, b in pairs]
    for name, value in (("HELD_CELLS", 500), ("SHORT", 1 << 30), ("KNOWN_SCORES", 3)):
        monkeypatch.setattr(h, name, value)
        assert [(id(a), id(b)) for a, b in h._aligned(mine, theirs)] == ids


def test_large_elements_are_compared_by_their_best_alignment():
    """Of two elements of one label the one with more in common below it is met, though both have the same labels."""
    rows = lambda *texts: "".join(f"<div><p>{t}</p><p>{t} too</p></div>" for t in texts)
    one = h.parse(f"<section>{rows(*'abcdef')}</section>")
    other = h.parse(f"<section>{'<p>u</p>' * 12}</section><section>{rows(*'xbcdey')}</section>")
    assert {a.text for a, b in h.match(one, other)[1] if a.text == b.text} == {x + y for x in "bcde" for y in ("", " too")}


def test_many_long_entries_in_bounded_time_and_memory():
    page = lambda k: h.parse("".join(f"<li><p>{k} {i}</p><p>Reply</p></li><hr>" for i in range(6000)) + f"<p>{k}</p>")
    started = time.process_time()
    _, pairs = h.match(page(1), page(2))
    assert len(pairs) == 12001 and time.process_time() - started < 20


def test_too_few_or_equal_pages_have_no_template():
    few = [h.parse(page_of(i)) for i in range(3)]
    assert h.induce(few) == [set()] * 3
    same = [h.parse(page_of(3)) for _ in range(30)]
    assert h.induce(same) == [set()] * 30


def test_matching_keeps_parents_and_order():
    one, other = h.parse("<div><p>a</p><p>b</p></div><ul><li>c</ul>"), h.parse("<div><p>b</p></div><p>x</p><ul><li>z<li>c</ul>")
    _, pairs = h.match(one, other)
    assert [(a.text, b.text) for a, b in sorted(pairs, key=lambda x: x[0].text)] == [("b", "b"), ("c", "c")]


def test_a_third_of_all_rows_alike(spark):
    """Repeated rows, and rows without id and url: one of each is read in a block, and all are returned."""
    rows = [(i, f"https://acme.example/{i}", page_of(i)) for i in range(40)] + [(None, None, "<p>no id</p>")] * 600
    rows += [(7, "https://acme.example/7", page_of(7))] * 500 + [(None, None, f"<p>none {i}</p>") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    got = Counter((r.page_id, r.text) for r in h.extract(df, block_pages=40).collect())
    assert got.pop((7, wanted(7))) == 501 and got.pop((None, "no id")) == 600
    assert got == Counter([*[(i, wanted(i)) for i in range(40) if i != 7], *[(None, f"none {i}") for i in range(300)]])


def test_pages_of_a_host(spark):
    rows = [(i, f"https://acme.example/{i}", page_of(i), "x") for i in range(40)]
    rows += [(i, f"http://www.other.example/{i}", page_of(i, f"Number {i}"), "x") for i in range(40, 44)]
    rows += [(50, None, "<p>no url</p>", None), (51, "nonsense", None, None), (None, "https://acme.example/x", page_of(3), None)]
    rows += [rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    got = {}
    for r in h.extract(df, block_pages=20).collect():
        got.setdefault(r.page_id, []).append((r.url, r.text))
    assert all(got[i] == [(f"https://acme.example/{i}", wanted(i))] for i in range(1, 40))
    assert got[0] == [("https://acme.example/0", wanted(0))] * 2
    assert got[41][0][1].startswith("Number 41\n\n")  # varies from page to page
    assert got[50] == [(None, "no url")] and got[51] == [("nonsense", "")]
    assert got[None] == [("https://acme.example/x", wanted(3))]
    assert h.extract(df.filter("false")).count() == 0


def test_whole_table(spark, on_table):
    """The pages of the test data mark their article and have only these tags in it."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    found = on_table("op10_html_extract", pages, spark).collect()
    source = {r.page_id: r for r in pages.collect()}
    assert len(found) == len(source)
    for r in found:
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id].html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(library.unescape(re.sub("</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(x for x in blocks if x)
        assert r.n_chars == len(r.text) and r.url == source[r.page_id].url
