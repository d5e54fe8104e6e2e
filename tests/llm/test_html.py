import pytest

from quernstone.llm import html, queries

CASES = {
    "": "", "plain &amp; simple": "plain & simple", "<p>one<p>two": "one\n\ntwo", "a<br>b": "a\nb", "<b>bo</b>ld": "bold", "x <i> y</i>": "x y",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d", "<ol start=3><li>a<li>b</ol>": "3. a\n4. b",
    "<table><tr><th>Name<th>N<tr><td>alpha<td>1<tr><td>b<td>22</table>": "Name   N\nalpha  1\nb      22",
    "<table><tr><td colspan=2>wide one<tr><td>a<td>b</table>": "wide one\na  b",
    "<td>stray": "stray", "<pre>  a\n   b</pre>c": "  a\n   b\n\nc", "<head><title>t</title></head><body>b": "b",
    "<script>if (a<b) '</p>'</script>x<style>p{}</style>": "x", "<div hidden>n<p>n</div>y": "y", "<p style='display : none'>n</p>y": "y", "<!-- c -->x<!-- open": "x",
    "<div>a</span></div><div>b": "a\nb", "a<p>b</div>c": "a\n\nbc", "<dl><dt>t<dd>d</dl>": "t\n  d", "<option>n": "n", "<select><option>n</select>y": "y", "1 < 2 > 0": "1 < 2 > 0",
    "<template><p>n</template>y<noscript>n</noscript>": "y", "<h1>T</h1>text": "T\n\ntext",
    "<table><tr><td>a<table><tr><td>x<td>y</table><td>b</table>": "a     b\nx  y",
}


@pytest.mark.parametrize("page", sorted(CASES))
def test_cases(page):
    assert html.render(page) == CASES[page]


def test_depth_and_nulls(spark):
    assert html.render(None) is None and html.render("<div>" * 50_000 + "x") == "x"
    assert html.render("<table><tr><td>" * 300 + "x") == "x"
    df = spark.createDataFrame([(1, None, "k"), (2, "", None), (3, "<p>a" * 20_000, "k")], "page_id long, html string, url string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got[1] is None and got[2] == "" and got[3].count("a") == 20_000
    assert html.extract(df.limit(0)).count() == 0


def test_query(spark, folder):
    rows = queries.op6_html(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/pages.parquet").count()
    for r in rows:
        assert r["n_chars"] == len(r["text"]) and "track(" not in r["text"] and "<p>" not in r["text"]
