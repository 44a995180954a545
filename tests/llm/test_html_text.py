import re
from html.parser import HTMLParser

import pytest

from keysweep.llm import html_text as H
from keysweep.llm.common import read

from conftest import SF_SMALL


class Plain(HTMLParser):
    """Brute force: all text outside the elements that are never shown."""

    def __init__(self):
        super().__init__()
        self.hidden, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style", "template", "noscript")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("head", "script", "style", "template", "noscript")

    def handle_data(self, data):
        if self.hidden <= 0:
            self.out.append(data)


def test_given_pages_keep_all_visible_text(spark):
    pages = {r["page_id"]: r["html"] for r in read(spark, SF_SMALL, "pages").collect()}
    for r in H.extract(read(spark, SF_SMALL, "pages")).collect():
        plain = Plain()
        plain.feed(pages[r["page_id"]] or "")
        plain.close()
        shown = re.sub(r"^\s*(- |\d+\. )", "", r["text"], flags=re.M)
        assert sorted(re.sub(r"\s", "", "".join(plain.out))) == sorted(re.sub(r"\s", "", shown))
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>one<li>two<ul><li>in</ul></ul>", "- one\n- two\n  - in"), ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1</table>", "Name       N\nlong name  1"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<div>a</div><div>b</div>", "a\nb"), ("<p hidden>x</p><p style='display: none'>y</p>z", "z"),
    ("<pre>\n x\n  y</pre>", " x\n  y"), ("<script>if (a < b) '</p>'</script>t", "t"), ("<b>x <i>y</b> z</i>", "x y z"),
    ("&lt;b&gt; &amp; &eacute;", "<b> & é"), ("a<!-- <p>no</p> -->b", "ab"), ("<details><summary>s</summary>no</details>", "s"),
    ("<blockquote>q<br>r</blockquote>", "  q\n  r"), ("<p title='a>b'>x", "x"), ("<p title='open>x", "x"), ("a < b", "a < b"),
    ("<textarea>&lt;x</textarea>", "<x"), ("<h1>T</h1>x", "T\n\nx"),
])
def test_layout(page, text):
    assert H.text_of(page or "") == text


def test_very_deep_and_long_pages():
    assert H.text_of("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert H.text_of("<p>word " * 20_000).count("word") == 20_000
    assert H.text_of("<" * 20_000 + "x").endswith("x")


def test_edge_rows(spark):
    rows = [(1, None, "u", "t"), (1, None, "u", "t"), (None, "<p>x", "u", "t"), (2, "", "u", "t")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, html string, url string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "x", 1), (1, "", 0), (1, "", 0), (2, "", 0)]
    assert H.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []
