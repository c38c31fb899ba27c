from __future__ import annotations

import pytest

from devpulse.llm.html_text import render

CASES = {
    "<p>a<p>b  c": "a\n\nb c",
    "one<br>two<div>three</div>four": "one\ntwo\nthree\nfour",
    "<ul><li>x<li>y<ol start=3><li>q<li>r</ol></ul>": "- x\n- y\n  3. q\n  4. r",
    "<ol><li>a<li value=7>b<li>c</ol>": "1. a\n7. b\n8. c",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<table><tr><th>A<th>Bee<tr><td>long cell<td>2</table>": "A         | Bee\nlong cell | 2",
    "<table><tr><td colspan=2>wide<td>z<tr><td>1<td>2<td>3</table>": "wide |   | z\n1    | 2 | 3",
    "<table><tr><td rowspan=2>r<td>s<tr><td>t</table>": "r | s\n  | t",
    "<table><td>1<td>2<tr><td>3</table>": "1 | 2\n3",
    "<table><tr><td><p>a<p>b<td>c</table>": "a | c\n\nb",
    "<table><caption>T</caption><tr><td>x</table>after": "T\nx\n\nafter",
    "<table><tr><td>o<table><tr><td>i<td>j</table><td>p</table>": "o     | p\n\ni | j",
    "<pre>  a\n   b</pre>c": "  a\n   b\n\nc",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "<h1>H</h1>x<h2>I": "H\n\nx\n\nI",
    "<script>var t='</p>';</script>v<style>p{}</style><!-- c -->w": "vw",
    "<head><title>t</title></head><body>b": "b",
    "<div hidden>n</div><p style='color:red; DISPLAY : none'>n</p><p style='visibility:hidden'>n</p>y": "y",
    "<details><summary>S</summary>no<p>no</p></details><details open><summary>T</summary>yes</details>": "S\nT\nyes",
    "&amp;&lt;x&gt; &copy; &#65;&nbsp;b": "&<x> © A b",
    "<b>bo</b>ld<i> it</i> <a href='x>y'>li</a>nk": "bold it link",
    "a</p>b</div></li></td>c": "a\n\nbc",
    "<textarea> k <b>\n l</textarea>": " k <b>\n l",
    "<p>x <!-- unclosed": "x",
    "<p title=\"unclosed>rest": "unclosed>rest",
    "a < b <3 &": "a < b <3 &",
    "<select><option>a<option>b</select>": "a\nb",
    "<input type=submit value=Go><input value=no>": "Go",
    "<ul><li><li>x</ul>": "-\n- x",
}


@pytest.mark.parametrize("html", CASES)
def test_rendered(html):
    assert render(html) == CASES[html]


def test_text_between_all_tags_is_kept():
    import random

    rng = random.Random(3)
    tags = "p div ul li ol table tr td th b i span h1 blockquote pre dl dt dd a section br em".split()
    for _ in range(300):
        html, words = [], []
        for k in range(rng.randrange(40)):
            t = rng.choice(tags)
            html.append(rng.choice([f"<{t}>", f"</{t}>", f"<{t} class='x'>"]))
            words.append(f"w{k}q")
            html.append(f" w{k}q ")
        text = render("".join(html))
        assert sorted(w for w in text.replace("|", " ").split() if w.startswith("w")) == sorted(words), html


def test_long_input_takes_linear_time():
    import time

    for piece in ("<div>", "<li>", "<p>x", "<td>y", "<a b=\"", "<!-- ", "</p>", "&amp;", "<table><tr><td>"):
        start = time.perf_counter()
        render(piece * 20_000)
        assert time.perf_counter() - start < 20, piece


STRAY_QUOTES = {
    '<div class="a"">Text</div><p class="b">More</p>': "Text\n\nMore",
    "<a title=Bob's>Bob's page</a>": "Bob's page",
    '<div "quoted">a</div>': "a",
    '<a href=x?y="z>w</a>': "w",
    "<p title=x'hidden>a</p>": "a",
    '<a x = "p>q" y=\'r>s\'>t</a>': "t",
    "<p hidden=>a</p>b": "b",
}


@pytest.mark.parametrize("html", STRAY_QUOTES)
def test_stray_quotes_in_a_tag_swallow_nothing(html):
    rest = '<div class="c">w1</div>' * 500 + "<p title='d'>w2</p>" * 500
    assert render(html) == STRAY_QUOTES[html]
    assert render(html + rest).split() == STRAY_QUOTES[html].split() + ["w1"] * 500 + ["w2"] * 500


NOTHING_LOST = {
    "<!-->a": "a",
    "<!--->a": "a",
    "<!-- x --!>a": "a",
    "<!-- x -- > y -->a": "a",
    "<svg><style/></svg>a": "a",
    "<svg><title/><path d=\"x=1\"/></svg>a": "a",
    "<svg/><p>a</p>": "a",
    "<svg><style>p{}</style><title>t</title></svg>a": "a",
    "<pre>\n a</pre>": " a",
    "<textarea>\r\na</textarea>": "a",
    "<b>" * 3000 + "<script>var a=1;</script>a": "a",
    "<div><b>" * 3000 + "<p hidden>n</p><ol><li>x<li>y</ol>": "1. x\n2. y",
}


@pytest.mark.parametrize("html", NOTHING_LOST, ids=range(len(NOTHING_LOST)))
def test_no_text_is_lost_after_odd_markup(html):
    assert render(html) == NOTHING_LOST[html]
    rest = "<div>w1</div><!-- c --><p>w2</p>" * 500
    assert render(html + rest).split() == NOTHING_LOST[html].split() + ["w1", "w2"] * 500


def test_the_rest_of_a_page_is_plain():
    assert render("a<plaintext>\n<b>x</b>\n&amp;") == "a\n<b>x</b>\n&amp;"


def test_long_spans():
    rows = "".join(f"<tr><td>{k}" for k in range(300))
    shown = render(f"<table><tr><th rowspan=301>H<td>x{rows}</table>").split("\n")
    assert shown[0] == "H | x" and all(line.startswith("  | ") for line in shown[1:]) and len(shown) == 301
    shown = render("<table><tr><td colspan=5000>a<td>b<tr><td>c</table>")
    assert shown == "a | b\nc"


def test_deep_pages_keep_their_text_in_linear_time():
    import time

    for piece in ("<ul><li>w ", "<table><tr><td>w ", "<div><b>w ", "<blockquote>w ", "<b>w ", "<svg>w "):
        start = time.perf_counter()
        assert render(piece * 10_000).replace("|", " ").split().count("w") == 10_000, piece
        assert time.perf_counter() - start < 20, piece
