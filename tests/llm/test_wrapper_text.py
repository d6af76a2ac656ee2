import random

import pytest

from panelyard.llm import wrapper_text as W


@pytest.mark.parametrize("page, want", [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\nb"), ("<article><h1>T</h1><p>x <b>y</b>\n z<br>w</p></article><p>out</p>", "T\nx y z w"),
    ("<nav>n</nav><div>d</div><footer>f</footer>", "d"), ("<body><header>h</header><div id='sidebar-left'>s</div><p>t</p><form>f</form></body>", "t"),
    ("<article><p>a</p><section class='comments'><p>c</p></section><div class=ad>x</div><p>b</p></article>", "a\nb"),
    ("<script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes &#233;&#xE9;&eacute;", "yes ééé"), ("<p>cut of<a href='x", "cut of"),
    ("<main><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></main>", "1\n2\n3\n4"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"), ("<article><p>x</article></p></div>tail", "x"), ("<p title='a>b'>q</p>", "q")])
def test_blocks_of_a_page(page, want):
    root = W.parse(page)
    W.number(root)
    assert "\n".join(t for _, t in W.blocks(root)) == want


def test_matching_aligns_as_many_nodes_as_possible():
    a, b = W.parse("<div><p>1</p><ul><li>x</ul><p>2</p></div>"), W.parse("<div><ul><li>y<li>z</ul><p>3</p></div>")
    W.number(a), W.number(b)
    pairs = {}
    assert W.matching(a, b, pairs) == 5 == len(pairs)


@pytest.fixture
def site(spark):
    def page(k):
        return (f"<html><body><div><p>Welcome to the site</p></div><div><h2>Story {k}</h2><p>Body {k} &amp; more</p>"
                f"{'<p>extra</p>' if k % 2 else ''}</div><div><p>Call us now</p></div></body>")

    rows = [(k, "http://Host.org/a?b", page(k)) for k in range(8)] + [(100, "http://one.org/", page(1)), (101, None, None), (102, "http://e.org", ""), (None, "http://f.org", "<p>x")]
    return spark.createDataFrame([(*r, "h", 1, []) for r in rows], "page_id bigint, url string, html string, host string, node int, blocks array<string>")


def test_what_a_host_repeats_is_template(site):
    got = {r.page_id: r for r in W.main_text(site).collect()}
    for k in range(8):
        assert got[k].text.split("\n")[:2] == [f"Story {k}", f"Body {k} & more"] and got[k].n_chars == len(got[k].text)
        assert "Welcome" not in got[k].text and "Call us" not in got[k].text
    assert got[100].text.startswith("Welcome to the site\nStory 1")  # one page has no pattern
    assert got[101].text == got[102].text == "" and got[None].text == "x"
    assert W.main_text(site.where("false")).count() == 0


def test_copies_of_a_page_are_no_template(site, spark):
    copies = spark.createDataFrame([(k, "http://c.org/x", "<p>same</p><p>text</p>") for k in range(9)], "page_id bigint, url string, html string")
    assert {r.text for r in W.main_text(copies).collect()} == {"same\ntext"}


def test_template_is_what_the_pages_say_not_one_reference(spark):
    """An empty page, one without the notice and one broken off must not decide for the host."""
    def page(k):
        return f"<body><div><p>Read our terms</p></div><div><h2>Story {k}</h2><p>Body {k}</p></div><section><p>Call us now</p></section></body>"

    rows = [(k, page(k)) for k in range(40)] + [(40, ""), (41, "<body><div><p>Gone</p>"), (42, "<body><div><h2>Story 42</h2><p>Body 42</p></div></body>")]
    for salt in range(3):  # other hashes, so that another page has the smallest
        pages = spark.createDataFrame([(k, "http://h.org/x", f"<!--{salt}-->{h}" if h else h) for k, h in rows], "page_id bigint, url string, html string")
        got = {r.page_id: r.text for r in W.main_text(pages).collect()}
        assert got == {**{k: f"Story {k}\nBody {k}" for k in [*range(40), 42]}, 40: "", 41: "Gone"}


def test_a_reference_that_says_something_else_hides_no_template():
    assert [b["slot"] for b in W.aligned("<p>a</p><p>b</p>", ["<p>x</p><p>y</p>", "<p>a</p>"])] == [1, 2]
    assert [b["slot"] for b in W.aligned("<p>a</p><ul><li>b</ul>", ["<p>x</p>", "<ul><li>y</ul>"])] == [1, 1 << 32 | 2]
    assert [b["slot"] for b in W.aligned("<p>a</p><ul><li>b</ul>", ["<p>x</p>"])] == [1, -2]


@pytest.mark.parametrize("page, want", [
    ("<div id=page class=right-sidebar><p>one</p><p>two</p></div>", "one\ntwo"),
    ("<article><div class=entry-header><h1>Title</h1></div><p>text</p></article>", "Title\ntext"),
    ("<article class='post comments-open'><h1>T</h1><p>text</p></article>", "T\ntext"),
    ("<main><p>The long text of this page.</p></main><article>teaser</article>", "The long text of this page."),
    ("<article>teaser</article><div><p>The long text of this page, which has no main.</p></div>", "teaser\nThe long text of this page, which has no main."),
    ("<form action=x><div class=nav>n</div><h2>Head</h2><p>All of the page</p></form>", "Head\nAll of the page"),
    ("<article><h1>T</h1><p>short</p></article><div class=ad>an advert with more words than that</div>", "T\nshort"),
    ("<p>a <span class=share>s</span>b</p>", "a b")])
def test_names_are_a_weak_sign(page, want):
    root = W.parse(page)
    W.number(root)
    assert "\n".join(t for _, t in W.blocks(root)) == want


def test_alignment_decides_before_names(spark):
    """A long constant text outside the wrapper leaves the wrapper most of what varies."""
    def page(k):
        return (f"<body><div><p>{'Welcome to all readers of the site. ' * 9}</p></div><div class=has-sidebar><p>Body of story {k}</p></div>"
                f"<div class=sidebar><p>tip {k}</p></div></body>")

    pages = spark.createDataFrame([(k, "http://h.org/x", page(k)) for k in range(8)], "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in W.main_text(pages).collect()} == {k: f"Body of story {k}" for k in range(8)}


def test_depth_changes_no_text():
    deep = "<div>" * 300
    for page, want in [(f"{deep}<p>one</p><p>two</p>", "one\ntwo"), (f"{deep}<p>a<b>b</b>c</p>", "abc"), (f"{deep}<nav>menu</nav><p>x</p><footer>f</footer>", "x"),
                       ("<b>" * 3000 + "<p>one</p><p>t<i>w</i>o</p><form>f</form>", "one\ntwo")]:
        root = W.parse(page)
        W.number(root)
        assert "\n".join(t for _, t in W.blocks(root)) == want


def best(a, b):
    """The most nodes that match, by the plain table."""
    if a.tag != b.tag:
        return 0
    x, y = a.children(), b.children()
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            table[i + 1][j + 1] = max(table[i][j] + best(x[i], y[j]), table[i][j + 1], table[i + 1][j])
    return 1 + table[-1][-1]


@pytest.mark.parametrize("cells", [W.CELLS, 4])
def test_long_lists_are_aligned_whole(monkeypatch, cells):
    monkeypatch.setattr(W, "CELLS", cells)
    r = random.Random(cells)

    def tree(depth):
        tag = r.choice(["div", "ul", "section"])
        return f"<{tag}>{''.join(tree(depth - 1) for _ in range(r.randrange(7)))}</{tag}>" if depth else f"<{tag}></{tag}>"

    for _ in range(60):
        a, b = W.parse("".join(tree(2) for _ in range(8))), W.parse("".join(tree(2) for _ in range(8)))
        W.number(a), W.number(b)
        pairs = {}
        assert W.matching(a, b, pairs) == best(a, b) == len(pairs) == len(set(pairs.values()))


def test_constant_block_amid_long_lists_has_its_partner():
    page = lambda n, tag: "<i>x</i>" * n + "<hr>" + "<b>y</b>" * 150 + "<section>same</section>" + f"<{tag}>z</{tag}>" * 90 + "<u>u</u>"
    a, b = W.parse(page(200, "b")), W.parse(page(170, "i"))
    of = {n.tag: n.number for n in W.number(a)}
    at = {n.tag: n.number for n in W.number(b)}
    pairs = {}
    W.matching(a, b, pairs)
    assert pairs[of["section"]] == at["section"]
