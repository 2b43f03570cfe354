import math

import duckdb
import pytest
from hypothesis import given, settings, strategies as st

from poolsight.llm import text_density
from poolsight.llm.page_queries import PAGE_SQL
from poolsight.llm.text_density import main_text

PROSE = "A longer sentence that reads like prose, with some commas, and goes on for a while."
NOISE = f"""<header class="site-header"><h1>Site</h1><ul><li><a href=x>Home</a></ul></header><nav><a href="/">Start</a></nav>
<div id="cookie-notice">We use cookies. {PROSE}</div><div class="left"><a href=1>one link</a> <a href=2>two links</a></div>"""
AFTER = f"""<div class="sidebar"><p>{PROSE}</p></div><section id="comments"><h2>3 comments</h2><p>{PROSE * 9}</p></section>
<form>Mail <input> <button>Go</button></form><div role="dialog">Buy</div><p hidden>hidden</p><footer>&copy; us</footer><script>var t="</p>";</script>"""
BODY = f"<h1>Title &amp; more</h1><p>{PROSE}<p>{PROSE} <a href=q>a  link</a>\n end<ul><li>item <b>o</b>ne<li>two</ul><p>short</p>"
TEXT = f"Title & more\n{PROSE}\n{PROSE} a link end\nitem one\ntwo\nshort"


@pytest.mark.parametrize("wrap", ["article", "main", "div id=content", "section"])
@pytest.mark.parametrize("ends", [True, False])
def test_article_among_other_parts(wrap, ends):
    name = wrap.split()[0]
    html = f"<!DOCTYPE html><html><head><title>T</title></head><body class='no-sidebar'>{NOISE}<{wrap}>{BODY}<div class='ad'>Buy {PROSE}</div>"
    assert main_text(html + f"</{name}>{AFTER}" + ("</body></html>" if ends else "")) == TEXT


def test_unnamed_noise_beside_the_text():
    links = "".join(f"<li><a href={i}>some link {i}</a></li>" for i in range(30))
    html = f"<body><div><ul>{links}</ul></div><div><div>{'<p>' + PROSE + '</p>' * 1}<p>{PROSE}</p><p>{PROSE}</p></div></div><div><a href=z>Imprint</a></div></body>"
    assert main_text(html) == "\n".join([PROSE] * 3)


def test_sections_beside_the_core_belong_to_it():
    html = f"<div><section><h2>A</h2><p>{PROSE}</p><p>{PROSE}</p></section><section><h2>B</h2><p>{PROSE}</p></section></div>"
    assert main_text(html) == f"A\n{PROSE}\n{PROSE}\nB\n{PROSE}"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        (" \n ", ""),
        ("only text", "only text"),
        ("<p>a<p>b", "a\nb"),
        ("<p>a<br>b  c<wbr>d", "a b cd"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
        ("<p>x</p><!-- never closed", "x"),
        ("<a href='a>b'>t</a", "t"),
        ("<p>1 < 2 &lt; 3 &amp &am &#233;&eacute;", "1 < 2 < 3 & &am éé"),
        ("</p></div>stray<p", "stray"),
        ("<nav>menu</nav>", ""),
        ("<article><header><h1>T</h1></header><div class='post-header'>by</div><div class='comments-header'>c</div><p>x</article>", "T\nby\nx"),
        ("<div class='content-sidebar-wrap'><main><p>x</main><div class=sidebar>s</div></div>", "x"),
        ("<p>日本<p>é", "日本\né"),
        ("<script>a<p>b</script><style>p{}</style>", ""),
    ],
)
def test_small_pages(html, text):
    assert main_text(html) == text


def test_density():
    # 100 characters, 20 of them in links, 5 tags, 2 of them links, a tenth of the page in links
    base = math.log(100 / 80 * 20 + 0.1 * 100 + math.e)
    want = 100 / 5 * math.log(100 / 20 * 5 / 2, base)
    assert text_density._density(100, 20, 5, 2, 0.1) == pytest.approx(want)
    assert text_density._density(0, 0, 5, 2, 0.1) == 0
    assert text_density._density(100, 100, 5, 5, 1.0) == 0  # all of it links


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<a href='", "'>", "<td>", "<ul>", "<li>", "</ul>", "<!--", "-->", "<", ">", "x y", "&amp", "<article>", "</article>", "<script>", "</script>", "\"", "="])))
def test_any_page_is_read(parts):
    text = main_text("".join(parts))
    assert text == "\n".join(" ".join(b.split()) for b in text.split("\n") if b.strip())


def test_large_and_deep_pages():
    assert main_text("<div>" * 50000 + "x" + "</div>" * 50000) == "x"
    assert len(main_text(f"<p>{PROSE}</p>" * 20000).split("\n")) == 20000
    assert main_text("<li>" * 30000 + "z") == "z"
    assert main_text("<a \"" * 50000 + "<!--" * 50000) == ""


def test_table_of_pages(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", 5, "t"), (1, "u", f"<article>{BODY}</article>", 5, "t"), (2, None, None, 5, "t"), (None, "v", "", 5, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, text string")
    got = sorted(text_density.main_texts(pages).collect(), key=str)
    assert sorted([(r.page_id, r.url, r.text, r.n_chars) for r in got], key=str) == sorted(
        [(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str
    )
    assert text_density.main_texts(pages.limit(0)).count() == 0


def test_every_page_of_the_tables():
    con = duckdb.connect()
    con.execute("create view pages as select * from '/root/testdata/sf0.1/pages.parquet'")
    html = dict(con.execute("select page_id, html from pages").fetchall())
    for page_id, _, text, n_chars in con.execute(PAGE_SQL).fetchall():
        assert main_text(html[page_id]) == text and len(text) == n_chars
