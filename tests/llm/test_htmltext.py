import pytest
from llm_tables import pages

from crestline.llm.htmltext import extract, main_text, smoothed, threshold

PARAGRAPHS = [f"Paragraph {n} of the article has many words, so that its line is dense &amp; long." for n in range(5)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TEXT = "\n\n".join(p.replace("&amp;", "&") for p in PARAGRAPHS)


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("<html><head><title>t</title></head><body></body></html>", ""),
    ("no markup  at\nall", "no markup at all"),
    (f"<nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>T</h1>{BODY}</article><footer>&copy; us</footer>", "T\n\n" + TEXT),
    (f"<header><p>Site name and claim</p></header><main><header><h1>T</h1></header>{BODY}<aside>See also</aside></main>", "T\n\n" + TEXT),
    (f"<div id='cookie-notice'>We use cookies, which you should accept now.</div><div class='story'>{BODY}</div>"
     "<div class='comments'><p>A reader says that this is a long comment.</p></div><form><p>Write to us</p></form>", TEXT),
    (f"<article>{BODY}<article class='comment'><p>I do not agree at all with this one.</p></article></article>", TEXT),
    (f"<article>{BODY}<section id='disqus_thread'><p>Some reader</p></section></article>", TEXT),
    (f"<div class='sideBar'>Links</div><script>var a = '<p>no</p>';</script><style>p{{}}</style><article>{BODY}", TEXT),
    ("<article><p>one<br>two&nbsp;  three &lt;b&gt; &eacute;<p>next<div>block</div>tail</article>", "one two three <b> é\n\nnext\n\nblock\n\ntail"),
    (f"<article><p class='ad'>Buy this<p>{PARAGRAPHS[0]}</article>", PARAGRAPHS[0].replace("&amp;", "&")),
    (f"<article><p hidden>secret</p><p style='display: none'>x</p>{BODY}</article>", TEXT),
])
def test_pages(html, text):
    assert main_text(html) == text


LONG = "".join(f"<p>{p} It goes on for some time, so that the page has text.</p>" for p in PARAGRAPHS)
LONG_TEXT = "\n\n".join(f"{p} It goes on for some time, so that the page has text." for p in TEXT.split("\n\n"))


@pytest.mark.parametrize("wrapper", [
    "<div class='has-sidebar'>", "<div class='content no-sidebar'>", "<div id='page-with-nav'>", "<div class='post share-enabled'>",
    "<div class='widget-page'>", "<div class='wrap social'>", "<form id='aspnetForm'>", "<form><div class='widget'>", "<x-app class='sidebar'>",
    "<div class='share'><div class='tags'>"])
def test_marked_wrappers_hide_nothing(wrapper):
    assert main_text(f"<body><nav>Menu</nav>{wrapper}<article>{BODY}</article></form></div></body>") == TEXT
    assert main_text(f"<body><nav>Menu</nav>{wrapper}<div>{LONG}</div></form></div></x-app><p>Contact</p></body>") in (
        LONG_TEXT, LONG_TEXT + "\n\nContact")
    assert main_text(f"<article><h1>T</h1>{wrapper}{LONG}</form></div></x-app></article>") == "T\n\n" + LONG_TEXT


@pytest.mark.parametrize("html,text", [
    (f"<div class='related'><article><p>A teaser</p></article></div><article>{BODY}</article>", TEXT),
    (f"<div class='has-sidebar'><article>{BODY}</article><div class='sidebar'>{BODY}</div><div class='comments'>{BODY}</div></div>", TEXT),
    (f"<article>{BODY}<div class='comments'>{BODY}{BODY}</div></article>", TEXT),
    (f"<article>{BODY}<p>Said so. <span class='share'>share</span></p></article>", TEXT + "\n\nSaid so."),
    ("".join(f"<div class='entry social'><article>{BODY}</article></div>" for _ in range(3)), "\n\n".join([TEXT] * 3)),
])
def test_marked_blocks(html, text):
    assert main_text(html) == text


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


@pytest.mark.parametrize("blocks", [
    [("p", words(50)), ("p", words(45, "a")), ("p", words(1300, "long")), *[("p", words(50, f"p{n}")) for n in range(6)]],
    [("h1", "Title"), ("h2", "By the way"), *[("p", words(60, f"p{n}")) for n in range(4)], ("h2", "End"), ("p", "Bye."), ("p", "All.")],
    [("p", words(60)), ("li", "one"), ("li", "two"), ("p", words(40)), ("td", "1"), ("td", "2"), ("blockquote", "So it is."), ("p", "Yes.")],
])
def test_pages_without_landmarks_are_whole(blocks):
    outer = {"li": "ul", "td": "table"}
    body = "\n\n".join(f"<{outer.get(t, 'div')}><{t}>{x}</{t}></{outer.get(t, 'div')}>" if t in outer else f"<{t}>{x}</{t}>" for t, x in blocks)
    page = f"<body><header>Site</header><div id='nav'><a href='/'>Home</a></div><div class='x'>{body}</div><div class='comments'>No</div></body>"
    assert main_text(page) == "\n\n".join(x for _, x in blocks)


@pytest.mark.parametrize("html,text", [
    (f"<main><h1>Short</h1><p>Yes.</p></main><div><p>{words(20)}</p></div>", "Short\n\nYes."),  # 23 in the landmark, at most ten times outside
    (f"<div><h1>T</h1>{LONG}</div><article class='x'><p>Buy</p></article>", f"T\n\n{LONG_TEXT}"),
    (f"<div>{LONG}</div><div class='comments'><article><p>{words(50)}</p></article></div>", f"{LONG_TEXT}\n\n{words(50)}"),
])
def test_landmarks_and_the_rest(html, text):
    assert main_text(html) == text


def test_many_regions():
    assert main_text("<div><p>a b c</p>" * 20_000).count("a b c") == 20_000


def test_many_nested_marks():
    assert main_text("<div class='nav'>" * 20_000 + BODY) == TEXT


@pytest.mark.parametrize("html", ["<![foo", "<!", "<", "a<b", "&#x0;", "<![if x]>a", "</p></div></article>", "<div " * 50, "<b>" * 3000])
def test_broken_markup_does_not_throw(html):
    main_text(html)


def test_deep_and_long():
    assert len(main_text("<div>" * 5000 + "word " * 200_000)) == 5 * 200_000 - 1


def test_table(spark):
    df = extract(pages(spark, [(1, "u", f"<article>{BODY}</article>"), (2, None, None), (1, "u", "é"), (None, "x", "z")]))
    assert sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in df.collect()), key=str) == sorted(
        [(1, "u", TEXT, len(TEXT)), (2, None, "", 0), (1, "u", "é", 1), (None, "x", "z", 1)], key=str)
    assert extract(pages(spark, [])).count() == 0


def test_smoothing_and_clusters():
    import numpy as np
    values = np.array([0, 0, 0, 90, 100, 95, 0, 0.0])
    assert smoothed(values).shape == values.shape and smoothed(values)[4] > smoothed(values)[2]
    assert 10 < threshold(values) < 90 and threshold(np.zeros(3)) == 0
