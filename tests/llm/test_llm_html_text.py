"""HTML to text: layout cases, and words against the standard parser."""

import random
from html.parser import HTMLParser

import pytest
from plain import SMALL
from slatecast.llm.html_text import extract_text, render

CASES = {
    "<p>One<p>Two <b>x<i>y</b> z</i><br>next": "One\n\nTwo xy z\nnext",
    "<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>": "- a\n- b\n  3. c\n  4. d",
    "<div>a</div><div>b <div>c": "a\nb\nc",
    "<table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td colspan=2>both<tr><td rowspan=2>two<td>1<tr><td>2</table>": "Name   Qty\napple  3\nboth\ntwo    1\n       2",
    "<table><td>lone<td><table><tr><td>in<td>ner</table></table>after": "lone  in  ner\n\nafter",
    "<pre>  a\n   b</pre>": "  a\n   b",
    "<blockquote>q</blockquote>": "  q",
    "a<script>x<y</script><style>p{}</style><!-- <b>no</b> -->b": "ab",
    "<style>.ad,#z{display:none}</style><p class='x AD'>no</p><p id=z>no</p>yes": "yes",
    "<p hidden>no</p><p style='visibility:hidden'>no <b style='visibility:visible'>yes</b></p>": "yes",
    "a &lt;b&gt; &amp;amp; 3 < 4": "a <b> &amp; 3 < 4",
    "<select><option>a<option>b</select><input type=submit value=Go>": "a\nb\nGo",
    "text <a href='unended": "text",
    "<p>a</div></li></p></table>b": "a\n\nb",
}


@pytest.mark.parametrize("html", CASES)
def test_layout(html):
    assert render(html) == CASES[html]


SHOWN = {
    "<style>@media print{nav{display:none}} @media (max-width:600px){.side{display:none}}</style><nav>n</nav><p class=side>s": "n\n\ns",
    "<style>@supports not (display:grid){#z{display:none}}</style><p id=z>s": "s",
    "<style>@charset 'utf-8';@media screen{@layer a{.ad{display:none}}}/*}*/.q::after{content:'}'}.x{display:none}</style><p class=ad>no<p class=x>no<p>s": "s",
    "<style>.a{color:red;@media print{display:none}.b{display:none}}</style><p class=a>s<p class=b>t": "s\n\nt",
    "<style media=print>p{display:none}</style><style media='screen, tv'>.x{display:none}</style><p>s<p class=x>no": "s",
    "<style>@media print{.x{display:none}</style><p class=x>s": "s",
    "a <svg><title/><title>no</title><desc>no</desc>no<defs><text>no</text></defs><path d='M0'/><text>one</text><text>two</text><foreignObject><p>html</p></foreignObject></svg> b": "a\none\ntwo\n\nhtml\n\nb",
    "<svg><path><p>after": "after",
    "<svg/>a<math><semantics><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></mrow><annotation>no</annotation></semantics></math>": "ax= 1 2",
    "<p>a<xmp><b>x</b> &amp;</xmp>b": "a\n\n<b>x</b> &amp;\n\nb",
}


@pytest.mark.parametrize("html", SHOWN)
def test_text_that_a_screen_shows(html):
    assert render(html) == SHOWN[html]


class Words(HTMLParser):
    def __init__(self):
        super().__init__()
        self.words, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("head", "script", "style")
        self.words.append(" " if tag not in ("b", "a", "i") else "")

    def handle_endtag(self, tag):
        self.skip -= tag in ("head", "script", "style")
        self.words.append(" " if tag not in ("b", "a", "i") else "")

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def test_driver_pages(llm):
    pages = llm.read.parquet(f"{SMALL}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in extract_text(pages).collect():
        plain = Words()
        plain.feed(html[r["page_id"]])
        assert [w for w in r["text"].split() if w != "-"] == [w for w in "".join(plain.words).split() if w != "-"]


def test_awkward_pages(llm):
    deep = "<div>" * 30_000 + "x" + "<table><td>" * 200 + "y"
    rows = [(1, None, "t"), (2, "", "t"), (None, deep, None), (3, "<p>" * 50_000, "t"), (3, "plain", "t")]
    out = extract_text(llm.createDataFrame(rows, "page_id bigint, html string, text string")).collect()
    assert sorted((str(r["page_id"]), r["text"].split()) for r in out) == [("1", []), ("2", []), ("3", []), ("3", ["plain"]), ("None", ["x", "y"])]
    assert extract_text(llm.createDataFrame([], "page_id bigint, html string")).count() == 0


def test_stray_quotes_lose_no_text():
    words = lambda h: render(h).split()
    assert words('<p>a</p><p class="x"">b</p><p>c</p>') == ["a", "b", "c"]
    assert words("<p>a</p><a title=it's>b</a><p>c</p>") == ["a", "b", "c"]
    assert words('<p>a <a href="x>b</a><p>c</p>') == ["a", "b", "c"]
    assert words('<p>x<a href="u"class="y">b</a> <b id = "q>r">s</b> <i =v>t</i>') == ["xb", "s", "t"]
    assert words('<p title="a>b>c</p><p id="e>f</p>') == ["f"]  # the quote closes at the next one, as in browsers
    assert words("<p>a<b") == ["a"] and words('a<p x="b>c<p y=\'d>e') == ["a", "c", "e"]


def test_long_cells_keep_columns_aligned():
    long = "word " * 40
    page = f"<table><tr><td>{long}<td>b<tr><td>x<td>y</table>"
    first, second = render(page).split("\n")
    assert first.index("b") == second.index("y") == len(long) + 1
    assert render(page, column=30).split("\n")[1].index("y") == 32
    huge = "<table><tr><td>" + "w" * 300_000 + "<td>b" + "<tr><td>x<td>y" * 5000 + "</table>"
    out = render(huge)
    assert out.count("y") == 5000 and len(out) < 20 * len(huge)


def test_long_lines_are_wrapped_in_their_columns():
    text = " ".join(f"word{i}" for i in range(400))
    lines = render(f"<table><tr><td>{text}<td>b<tr><td>x<td>y</table>").split("\n")
    assert " ".join(x.split("  ")[0] for x in lines[:-1]).split() == text.split() and max(map(len, lines)) <= 403
    assert lines[0].endswith("b") and lines[0].index("  b") <= 400 and lines[-1].index("y") == lines[0].rindex("b")


NUMBERS = ("--5", "\u00b2", "9" * 5000, "-", "", " 7", "+3", "1e9", "0", "-2", "3px", "\u0663")


@pytest.mark.parametrize("n", NUMBERS)
def test_numbers_that_are_none(n):
    assert render(f'<ol start="{n}"><li>a</ol>').split()[1] == "a"
    assert render(f'<table><tr><td colspan="{n}" rowspan="{n}">a<td>b</table>').split() == ["a", "b"]
    assert render(f'<ol><li value="{n}">a<li>b</ol>').split()[1::2] == ["a", "b"]


def test_list_numbers():
    assert render("<ol start=-1><li>a<li>b<li value=7>c<li>d</ol>") == "-1. a\n0. b\n7. c\n8. d"


def test_random_attributes_never_fail():
    rng = random.Random(4)
    names = ("hidden", "style", "class", "id", "colspan", "rowspan", "type", "value", "start", "media", "title")
    letters = "a1-:;{}!%*/\\\"'()[]<>=&#.,@ \n\u00b2\u0663\U0001f600displaynoevb"
    for _ in range(3000):
        tags = "".join(f"<{rng.choice(('p', 'div', 'li', 'ol', 'td', 'table', 'style', 'input', 'span', 'tr'))} {rng.choice(names)}={rng.choice(('', chr(34), chr(39)))}{''.join(rng.choices(letters, k=rng.randint(0, 25)))}{rng.choice(('', chr(34), chr(39)))}>t" for _ in range(rng.randint(1, 6)))
        assert isinstance(render(tags), str)


STYLED = {
    "<style>.a{display:none} .a{display:block}</style><p class=a>x": "x",
    "<style>.a{display:none}</style><p class=a style='display:block'>x": "x",
    "<style>p{display:none} #k{display:block}</style><p id=k>x<p>no": "x",
    "<style>.a{visibility:hidden} .b{visibility:visible}</style><p class=a>no<b class=b>x</b>": "x",
    "<style>.a{content:'display:none'}</style><p class=a>x": "x",
    "<style>.a{--x-display:none}</style><p class=a>x": "x",
    "<style>.a{display:none!important} #k{display:block}</style><p class=a id=k style='display:block'>no": "",
    "<style>.a{display:none!important}</style><p class=a style='display:block !important'>x": "x",
    "<style>#k{display:none} p.a{display:block} p{display:block}</style><p class=a id=k>no": "",
    "<style>p.a{display:none} .b.a{display:block}</style><p class=a>no<p class='a b'>x": "x",
    "<style>.a{display:none} div .a{display:block}</style><p class=a>x": "x",
    "<style>.a{display:none} .a:hover{display:block} .b{display:none}</style><p class=a>x<p class=b>no": "x",
    "<style>div > .a{display:none}</style><p class=a>x": "x",
    "<style>.a{display:none} @media (max-width:9em){.a{display:block}}</style><p class=a>x": "x",
    "<style>.a{display:none} @media print{.a{display:block}}</style><p class=a>no": "",
    "<p class=a>x<style>.a{display:none} .a{display:block}</style>": "x",
    "<p class=a>no<p>x<style>.a{display:none}</style>": "x",
    "<style>.a{display:none}</style><p class=a>x<style>.a{display:inline}</style>": "x",
    "<p hidden>no<p hidden style='display:block'>x": "x",
    "<template><style>p{display:none}</style></template><p>x": "x",
    "<!doctype html><style>.a{display:none}</style><p class=A>x<p class=a>no": "x",
    "<style>.a{visibility:hidden;visibility:nonsense}</style><p class=a>no<p style='visibility:hidden;visibility:visible'>x": "x",
    "<style>*{visibility:visible} .a{display:none;display:block}</style><p class=a>x": "x",
}


@pytest.mark.parametrize("html", STYLED)
def test_styles_as_browsers_resolve_them(html):
    assert render(html) == STYLED[html]
