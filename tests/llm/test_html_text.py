import re
import time
from html.parser import HTMLParser

import pytest

from corpuslake.llm import html_text, queries

CASES = {
    "": "",
    "plain &amp; simple": "plain & simple",
    "<p>one<p>two": "one\n\ntwo",
    "<title>t</title><script>if (a<b) x()</script><style>p{}</style><p>seen": "seen",
    "<p>a <span style='display: none'>b</span><i hidden>c</i> d": "a d",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d",
    "<ol><li>x</li><li>y</li></ol>after": "1. x\n2. y\n\nafter",
    "<table><tr><th>k<th>value<tr><td>long key<td>1</table>": "k        | value\nlong key | 1",
    "<table><tr><td>a<table><tr><td>x<td>y</table></td><td>b</table>": "a\n\nx | y\n\nb",
    "<table><tr><td>ab<br>cd<td>x<br>y<br>z<tr><td>1<td>2</table>": "ab | x\ncd | y\n     z\n1  | 2",
    "<table><tr><td colspan=2>wide title<td>c<tr><td>a<td>b<td>d</table>": "wide title | c\na | b      | d",
    "<table><tr><td rowspan=2>r<td>b<tr><td>c</table>": "r | b\n  | c",
    "<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>": "yes",
    "<p>it's <a title=it's>text</a> that's": "it's text that's",
    '<a href="x>lost? <b>bold</b>': "lost? bold",
    "<script>x</script foo>y": "y",
    "<pre>a\n  b</pre>": "a\n  b",
    "x<br>y<br><br>z": "x\ny\n\nz",
    "<ul><li><p>x</p><p>y</p></li><li></li><li>z</ul>": "- x\n\n  y\n\n-\n- z",
    "<ol><li>a<ol><li>b</ol><li>c</ol>": "1. a\n  1. b\n2. c",
    "<table><caption>cap</caption><tr><td>1<td>22<tr><td>333</table>": "cap\n1   | 22\n333",
    "<p>a</p>tail<div>d<p>e</div>f": "a\n\ntail\nd\n\ne\n\nf",
    "a<!-- no -->b<![CDATA[no]]>c": "abc",
    "<!-->shown": "shown",
    "<!--->shown": "shown",
    "<!-- x --!>shown": "shown",
    "<!-- a > b -- c ->d-->shown<!-- open": "shown",
    "<!---->shown": "shown",
    "a<![CDATA[x>y]]>z": "ay]]>z",
    "<input type=submit value='Buy now'><input type=hidden value=no><input type=password value=no>": "Buy now",
    "<input value=typed><input placeholder='Your name'><input type=checkbox value=no>": "typedYour name",
    "<button>Go <b>on</b></button>": "Go on",
    "<select><optgroup label=Fruit><option>Fig<option>Pear<optgroup label=Other><option>Oat</select>": "Fruit\nFig\nPear\nOther\nOat",
    "<xmp><b>x</b> &amp;\n  y</xmp>z": "<b>x</b> &amp;\n  y\n\nz",
    "a<noembed><p>no</noembed><noframes>no</noframes><iframe><b>no</iframe>b": "ab",
    "a<plaintext><b>x": "a\n\n<b>x",
    "<ol start=3><li>a<li>b</ol>": "3. a\n4. b",
    "<ol><li>a<li value=7>b<li>c</ol>": "1. a\n7. b\n8. c",
    "<ol type=a start=26><li>a<li>b</ol>": "z. a\naa. b",
    "<ol type=I><li>a<li type=1>b<li>c<li>d</ol>": "I. a\n2. b\nIII. c\nIV. d",
    "<ol reversed><li>a<li hidden>no<li>b</ol>": "2. a\n1. b",
    "<ol start=0 reversed type=A><li>a<li>b</ol>": "0. a\n-1. b",
    "<ol start=x><li value=>a<li>b<ol><li>c</ol></ol>": "1. a\n2. b\n  1. c",
    "<p style='display:none;display:block'>shown": "shown",
    "<p style='/* display:none */ color: red'>shown": "shown",
    "<p style='display:none; display:bogus'>no<p>a": "a",
    "<p style='DISPLAY : NONE !important; display:block'>no<p>a": "a",
    "<p hidden style='display:block'>shown": "shown",
    "<p style='background:url(x);display:none'>no</p>b": "b",
    "<div style='visibility:hidden;visibility:wrong'>no<b style='visibility:inherit'>no</b><b style='visibility:visible'>yes</b></div>": "yes",
    "<dialog>no</dialog><dialog open>yes</dialog>": "yes",
    "<p style='white-space:pre'>a\n  b</p>": "a\n  b",
    "<p style='white-space:pre-line'>a   b\n  c</p>": "a b\nc",
    "<pre>a\n  b<span style='white-space:normal'>c\n d</span></pre>": "a\n  bc d",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<div>a</div></p></b><div>b": "a\nb",
    "<p>a\n   b\t c</p>": "a b c",
    "<img alt='pic'> <select><option>1<option>2</select>": "pic\n1\n2",
    "<p title='a > b'>t": "t",
    "< not a tag": "< not a tag",
}


@pytest.mark.parametrize("markup", CASES)
def test_layout(markup):
    got = html_text.visible_text(markup)
    assert got == CASES[markup]


def test_deep_nesting_and_nulls(spark):
    deep = "<div>" * 5000 + "x" + "<table><tr><td>" * 60 + "y"
    pages = spark.createDataFrame([(1, None), (2, ""), (3, deep), (3, deep), (None, "<b>z")], "page_id long, html string")
    got = {r.page_id: r.text for r in html_text.extracted(pages).collect()}
    assert got[1] == got[2] == "" and got[None] == "z" and got[3].startswith("x") and got[3].endswith("y")
    assert html_text.extracted(pages.limit(0)).count() == 0


#: What browsers do not show, by their own style sheets.
NOT_SHOWN = set("area base basefont datalist head link meta noembed noframes param script style template title noscript iframe object canvas audio video".split())


class Walker(HTMLParser):
    """All letters and digits that show, by the standard library's parser and a plain stack; numbers of list items left out."""

    def __init__(self):
        super().__init__()
        self.out, self.stack = [], []

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        styles = dict(x.split(":", 1) for x in re.sub(r"\s", "", (values.get("style") or "").lower()).split(";") if ":" in x)
        gone = tag in NOT_SHOWN or "hidden" in values or styles.get("display") == "none" or (tag == "dialog" and "open" not in values)
        seen = styles["visibility"] == "visible" if styles.get("visibility") else self.stack[-1][2] if self.stack else True
        gone = gone or (bool(self.stack) and self.stack[-1][1])
        if seen and not gone:
            if tag == "img":
                self.out.append(values.get("alt") or "")
            if tag == "input" and (values.get("type") or "text") not in ("hidden", "password", "checkbox", "radio", "file", "image", "color", "range"):
                self.out.append(values.get("value") or values.get("placeholder") or "")
        if tag not in html_text.VOID:
            self.stack.append((tag, gone, seen))

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.stack or (not self.stack[-1][1] and self.stack[-1][2]):
            self.out.append(data)


def letters(text):
    return "".join(c for c in text if c.isalnum())


def test_all_pages_lose_no_visible_letter(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = queries.op8_html_extraction(spark, small).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        walker = Walker()
        walker.feed(pages[r.page_id] or "")
        walker.close()
        numbers = re.compile(r"^ *\d+\. ", re.M) if "<ol" in (pages[r.page_id] or "") else None
        assert letters(numbers.sub("", r.text) if numbers else r.text) == letters("".join(walker.out))


N = 20_000
BROKEN = {
    "quotes": "<a '" * N + "<b x=\"' " * N + "x",
    "stray end tags": "<b>" * N + "</i>" * N + "<p><table><td>" + "<b>" * N + "</p>" * N + "x",
    "tables in tables": "<table><tr><td>x<td>" * N,
    "lists in lists": "<ul><li>x" * N,
    "one wide cell": "<table><tr><td>" + "x" * 50_000 + "<tr><td>y" * N + "</table>",
    "one long cell": "<table><tr>" + "<td>x" * 1000 + "<td>" + "y<br>" * N + "</table>",
    "one line": "<b>x</b> " * N,
    "spans": "<table>" + "<tr><td rowspan=60000>x" * N,
    "fonts": "<div><p><span>" * N + "x",
    "unclosed script": "x<script>" * N,
}


@pytest.mark.parametrize("name", BROKEN)
def test_long_and_broken_pages(name):
    markup = BROKEN[name]
    start = time.perf_counter()
    got = html_text.visible_text(markup)
    assert time.perf_counter() - start < 20 and len(got) <= 30 * len(markup)
    x = markup.split("<script")[0].count(">x") + markup.split("<script")[0].startswith("x")
    if name not in ("quotes", "one wide cell"):
        assert got.count("x") == max(x, 1)


def test_ten_megabytes(spark):
    page = "<div><p>some words <b>here</b></p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></div>" * 110_000
    pages = spark.createDataFrame([(1, page, "x", 5)], "page_id long, html string, text string, n_chars int")
    assert html_text.extracted(pages).first().text.count("some words here") == 110_000


NOTHING_LOST = {
    "<table><tbody><td>x</td></tbody></table>": "x",
    "<table><td>a<td>b<tr><td>c</table>": "a | b\nc",
    "<table><tr><form><td>x</td></form></tr></table>": "x",
    "<table><tbody><form><tr><td>x</td><td>y</td></tr></form></tbody></table>": "x | y",
    "<table>t1<tr>t2<td>x</td>t3</tr><tbody>t4</table>after": "t1t2t3t4\n\nx\n\nafter",
    "a<table><tr><a href='#'>link</a><td>x</td></tr></table>": "alink\n\nx",
    "<table><tr><td>a<table><tr>in<td>b</table>c</table>": "ain\n\nb\n\nc",
    "<table><tr><td>x<table><td>y</table></table>": "x\n\ny",
    "<table><tr><table><tr><td>x</table>": "x",
    "<table><tr><td>x</td><caption>cap</caption></table>": "cap\nx",
    "<table><noscript><tr><td>no</td></tr></noscript><template><td>no</template><tr><td>x</table>": "x",
    "<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> b": "a x=1 b",
    "<svg><title>no</title><defs><text>no</text></defs><circle r='1'/>no<text>one</text><g><text x='1'>two <tspan>three</tspan></text></g></svg> z": "one two three z",
    "<svg/>a<svg><foreignObject><p>b</p></foreignObject></svg>": "a\n\nb",
    "<svg><text><![CDATA[c]]></text><path><p>out": "c\n\nout",
    "<svg><style/><text>x</text></svg>": "x",
}


@pytest.mark.parametrize("markup", NOTHING_LOST)
def test_no_visible_text_is_lost(markup):
    assert html_text.visible_text(markup) == NOTHING_LOST[markup]
