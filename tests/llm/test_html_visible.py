import random
import re
from html.parser import HTMLParser

import pytest

from quernstone.llm import html

CASES = {
    '<div title="a hidden gem">text</div>': "text", '<p class="nav hidden md:flex">menu</p>': "menu", "<p data-style='display:none'>text</p>": "text",
    "<p data-x=\"style='display:none'\">text</p>": "text", "<p aria-hidden=true>text</p>": "text", "<p style='x-display:none'>text</p>": "text",
    "<p HIDDEN='' class=a>n</p>y": "y", "<p hidden=until-found>n</p>y": "y", '<p id=a style="color:red; Display: none">n</p>y': "y", "<p style=visibility:hidden>n</p>y": "y",
    "a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>n</annotation></math> b": "a x=2 b",
    "<svg viewBox='0 0 1 1'><title>n</title><desc>n</desc><path d=''/><text>Label <tspan>one</tspan></text></svg>y": "Label one\ny",
    "<select><option>n<option selected>shown<option>n</select>": "shown", "<select multiple><option>a<option>b</select>": "a\nb",
    "<table><tr><td rowspan=2>A<td>B<tr><td>C</table>": "A  B\n   C", "<table><tr><td rowspan=0>A<td>B<tr><td>C<tr><td>D</table>": "A  B\n   C\n   D",
    "<table><tr><td>a<td colspan=200>b<td>c<tr><td>longer<td>d</table>": "a       b  c\nlonger  d", "<table><tr><td colspan='2'>wide cell<td>x<tr><td>a<td>b<td>y</table>": "wide cell  x\na  b       y",
    "<ol><li value=7>a<li>b<li value=-1>c</ol>": "7. a\n8. b\n-1. c", "<p style='visibility:hidden'>n<b style='visibility:visible'>shown</b>n</p>y": "shown\n\ny",
    "<td style='visibility:collapse'>n</td>": "", "<table><tr><td data-colspan=3>a<td>b</table>": "a  b",
}


@pytest.mark.parametrize("page", sorted(CASES))
def test_visible(page):
    assert html.render(page) == CASES[page]


class Plain(HTMLParser):
    """Words of a page by another parser, with nothing but what is hidden left out: pages have to be well formed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.open = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in html.VOID:
            named = {k: v or "" for k, v in reversed(attrs)}
            style = re.sub(r"\s", "", named.get("style", "")).lower().split(";")
            self.open.append((tag, tag in html.UNSEEN or "hidden" in named or "display:none" in style))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(hidden for _, hidden in self.open):
            self.words += data.split()


def words(text):
    return re.sub(r"[-\s]|\b\d+\. ", "", text)


def plain(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    return words("".join(parser.words))


def test_all_visible_text_of_the_pages(spark, folder):
    """Every page's text, white space and marks aside, is what another parser finds."""
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        if r["html"] is not None and "<select" not in r["html"] and "<svg" not in r["html"]:
            assert words(html.render(r["html"])) == plain(r["html"]), r["page_id"]


def test_all_visible_text_of_random_pages():
    rng = random.Random(9)
    tags = ["div", "p", "b", "ul", "section", "span", "h2", "em", "blockquote", "pre", "a"]

    def page(depth):
        out = []
        for _ in range(rng.randrange(1, 4)):
            if depth == 0 or rng.random() < 0.4:
                out.append(rng.choice(["word", "a &amp; b", "x&lt;y", "\u00e9t\u00e9"]) + str(rng.randrange(1000)) + "w")
            else:
                tag = rng.choice(["div", "b", "section", "span"] if depth < 3 else tags)
                more = rng.choice(["", "", "", " hidden", ' style="display:none"', ' title="hidden"', " class='a hidden'", " data-style=display:none"])
                out.append(f"<{tag}{more}>{page(depth - 1) if tag != 'p' else 'in p'}</{tag}>")
        return " ".join(out)

    for _ in range(300):
        text = page(3)
        assert words(html.render(text)) == plain(text), text
