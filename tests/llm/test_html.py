import random
from html.parser import HTMLParser

import pytest

from listingmill.llm import html_text, queries

CASES = [
    ("", ""),
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("<ul><li>one<li>two<ul><li>in</ul></ul>after", "- one\n- two\n  - in\n\nafter"),
    ("<ol start=3><li>x</li><li>y</li></ol>", "3. x\n4. y"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>b<td>22</table>", "Name       N\nlong name  1\nb          22"),
    ("<table><tr><td colspan=2>wide<td>c<tr><td>a<td>b<td>d</table>", "wide  c\na  b  d"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("x <b>bold</b>, y&nbsp;&amp; z", "x bold, y & z"),
    ("<p hidden>no</p><p style='color:red; display: none'>no</p><script>var t='</p>';</script><!-- no -->yes", "yes"),
    ("<pre>  keep\n   this</pre>", "  keep\n   this"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("<details><summary>s</summary>hidden<p>x</details>", "s"),
    ("2 < 3 <b>and</b> 4 > 1", "2 < 3 and 4 > 1"),
    ("<a href='unclosed>text</a> more", "text more"),
    ("<h1>T</h1>text<h2>U</h2>", "T\n\ntext\n\nU"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_layout(page, text):
    if page.startswith("<details"):
        assert "s" in html_text.page_text(page) and "x" not in html_text.page_text(page)
    else:
        assert html_text.page_text(page) == text


def test_deep_and_broken_pages():
    assert html_text.page_text("<div>" * 5000 + "deep").strip() == "deep"
    assert html_text.page_text("<" * 3000) == "<" * 3000
    assert html_text.page_text("<p " + "a" * 100_000) is not None


def test_frames(spark, sf_dir):
    rows = spark.createDataFrame([(1, None, "a"), (None, "<p>x", "b"), (2, "", "c")], "page_id long, html string, text string")
    assert {(r.page_id, r.text) for r in html_text.html_text(rows).collect()} == {(1, ""), (None, "x"), (2, "")}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = {r.page_id: r.text for r in html_text.html_text(pages).collect()}
    assert len(out) == pages.count() and not any("track(0)" in t or "<p>" in t for t in out.values())
    assert html_text.html_text(pages.where("page_id < 0")).count() == 0


@pytest.mark.parametrize(
    "page,text",
    [
        ("<table><form><tr><td>x</td></tr></form></table>", "x"),
        ("<table><tr><form><td>x<td>y</form></table>", "x  y"),
        ("<form><table><tr><td>x</form><td>y</table>z</form>", "x  y\nz"),
        ("<table>stray<tr><td>x</table>", "stray\nx"),
        ("<table><tbody>a <b>b</b> c<tr><td>x</table>after", "a b c\n\nx\n\nafter"),
        ("<table><tr><div>d</div><td>x</td><p>p</p></tr></table>", "d\n\np\n\nx"),
        ("<table><center><tr><td>x</td></tr></center></table>", "x"),
        ("<table><tr><td>x</td></tr><center>c</center></table>", "c\n\nx"),
        ("<table><colgroup><col>g<tr><td>x</table>", "g\nx"),
        ("<table><tr><td>x<tbody><tr><td>y</table>", "x\ny"),
        ("<table><tr><td>x<table><tr><td>y</table>z</table>", "x\ny\nz"),
        ("<table><tr><table><tr><td>y</table>z", "y\n\nz"),
        ("<tr>no table<td>x", "no tablex"),
        ("<svg><title>no</title><desc>no</desc><defs/><path d='M0'/><text>one</text><text>two</text></svg> end", "one\ntwo\nend"),
        ("so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> holds", "so x=1 holds"),
    ],
)
def test_no_visible_text_is_lost_in_tables_drawings_and_formulas(page, text):
    have = html_text.page_text(page)
    assert [s for s in have.split("\n") if s] == [s for s in text.split("\n") if s]


def test_every_word_of_a_broken_table_is_kept():
    r = random.Random(3)
    tags = "table form tr td tbody thead div p center caption b colgroup li select br".split()
    for _ in range(2000):
        words, page = [], "<table>"
        for i in range(r.randint(1, 25)):
            tag = r.choice(tags)
            page += f"<{r.choice(('', '', '/'))}{tag}>"
            if r.random() < 0.6:
                words.append(f"w{i}w")
                page += words[-1]
        have = html_text.page_text(page)
        assert all(w in have for w in words), page


@pytest.mark.parametrize(
    "page,text",
    [
        ("<ol reversed><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n8. c"),
        ("<ol type=i start=3><li>a<li>b</ol><ol type=A start=26><li>c<li>d</ol>", "iii. a\niv. b\n\nZ. c\nAA. d"),
        ("<table><tr><td><p>one</p><p>two</p><ul><li>x<li>y</ul></td><td>right</td></tr></table>", "one  right\n\ntwo\n\n- x\n- y"),
        ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
        ("<table><tr><td colspan=500>a<td>b<tr><td>c<td>d</table>", "a     b\nc  d"),
        ("<p style='visibility:hidden'>no <b style='visibility: visible'>yes</b></p>", "yes"),
        ("<object>shown</object><object data=x>not</object>", "shown"),
        ("<div hidden>" + "<div>" * 450 + "</div>" * 450 + "secret</div>seen", "seen"),
    ],
)
def test_numbers_cells_spans_and_visibility(page, text):
    assert html_text.page_text(page) == text


def test_output_stays_in_proportion_to_the_page():
    for page in (
        "<table><tr><td>" + "x" * 40_000 + "<td>b" + "<tr><td>a<td>b" * 2000 + "</table>",
        "<table><tr>" + "<td>x" * 1000 + "<tr>" + "<td>y" * 1000 + "<td>" + "a<br>" * 10_000 + "</table>",
        "<table>" + "<tr><td colspan=1000 rowspan=3>a" * 3000 + "</table>",
        "<table>" + ("<tr>" + "<td>" * 300 + "z") * 100 + "</table>",
        "<table><tr><td>" * 2000 + "deep",
    ):
        assert len(html_text.page_text(page)) <= 12 * len(page)


class Plain(HTMLParser):
    """The visible words of a well-formed page in document order: the brute-force version."""

    GONE = ("head", "script", "style", "title", "template", "noscript")
    VOID = ("br", "hr", "img", "meta", "link", "input", "wbr")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in self.VOID:
            a = dict(attrs)
            self.hidden.append((tag, tag in self.GONE or "hidden" in a or "display:none" in (a.get("style") or "").replace(" ", "")))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.hidden):
            while self.hidden.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(h for _, h in self.hidden):
            self.out.append(data)


def brute(page):
    p = Plain()
    p.feed(page)
    p.close()
    return "".join(p.out)


def test_all_pages_against_brute_force(spark, sf_dir):
    """Every whole page: the same letters in the same order, whatever the layout adds in white space and bullets."""
    bare = lambda s: "".join(c for c in s if not c.isspace() and c not in "-")
    for d in (sf_dir, "/root/testdata/sf0.01"):
        pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
        out = {r.page_id: r.text for r in queries.op8_html_text(spark, d).collect()}
        assert out.keys() == pages.keys()
        assert not [i for i, p in pages.items() if bare(out[i]) != bare(brute(p or ""))]


def test_generated_pages_against_brute_force():
    r = random.Random(8)

    def made(depth):
        tag = r.choice(("div", "p", "b", "ul", "table", "section", "span", "blockquote", "h2"))
        hide = r.choice(("", "", "", " hidden", " style='display: none'"))
        inner = lambda: "".join(f"w{r.randint(0, 999)}w " if depth > 4 or r.random() < 0.5 else made(depth + 1) for _ in range(r.randint(0, 4)))
        if tag == "p":
            return f"<p{hide}>w{r.randint(0, 999)}w</p>"
        if tag == "ul":
            return "<ul>" + "".join(f"<li{hide}>{inner()}</li>" for _ in range(3)) + "</ul>"
        if tag == "table":
            return "<table>" + "".join("<tr>" + "".join(f"<td{hide}>{inner()}</td>" for _ in range(r.randint(1, 3))) + "</tr>" for _ in range(3)) + "</table>"
        return f"<{tag}{hide}>{inner()}</{tag}>"

    for _ in range(500):
        page = made(0)
        have = html_text.page_text(page).replace("-", " ").split()  # bullets
        assert sorted("".join(have)) == sorted("".join(brute(page).split())), page


@pytest.mark.parametrize("page", ["<ul><li>x" * 5000, "<blockquote>x" * 5000, "<dl><dd>x" * 5000, "<ul><li>" * 40 + "<li>x" * 20000, "<table><tr><td>x" * 6000, "<table><tr><td>a<td>x" * 3000, "<ul><li><table><tr><td>x" * 3000, "<table><tr><td>aaaa x<td>c</td></tr><tr><td>d<td>" * 2000])
def test_output_and_time_in_proportion(page):
    import time

    began = time.process_time()
    out = html_text.page_text(page)
    assert time.process_time() - began < 5  # the square of these depths takes far longer
    assert len(out) <= 8 * len(page) and out.count("x") == page.count("x")


def test_deep_indents_of_small_pages_are_kept():
    assert html_text.page_text("<ul><li>a" * 20).splitlines()[-1] == " " * 38 + "- a"


def test_style_rules_and_ruby():
    css = "<style>.x{display:none} /* p{display:none} */ @media print{p{display:none}} @import 'a'; #y, b.z{color:red;display : none} i:hover{display:none}</style>"
    page = css + "<p class='a x'>no<p class=x style='display:block'>yes<i id=y>no</i><b class=z>no</b><i class=z>two</i><ruby>k<rp>(</rp><rt>r</rt></ruby><p style='display&#58;none'>no"
    assert html_text.page_text(page).split() == ["yestwokr"]
    assert html_text.page_text("<style media=print>p{display:none}</style><p>a") == "a"
    assert html_text.page_text("<style>p{display:none} p.k{display:block}</style><p>no<p class=k>a") == "a"
    assert html_text.page_text("<style>} p{</style><p>a<style>b{display:none") == "a"


def test_one_column_tables_are_laid_out_in_place():
    assert html_text.page_text("<ul><li><table><tr><td><p>a</p></td></tr></table><li><table><tr><td><ul><li>b</ul></td></tr></table></ul><p>z<table><tr><td><p>q<tr><td><td></table>") == "- a\n\n- - b\n\nz\n\nq"
    assert html_text.page_text("a<table><tr><td></td></tr><tr><td><p>b<p>c</td></tr><tr><td>d</table>e") == "a\n\nb\n\nc\nd\n\ne"
