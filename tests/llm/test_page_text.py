"""Main text of pages: by hand, against the given tables' plain layout, and odd rows."""

import html
import re
import time

from countloom.llm.page_text import digest, main_text, templates


def text(page):
    return "\n\n".join(t for t, _ in digest(page)[2])


def test_blocks():
    assert text("<body><nav>menu</nav><article><h1>A &amp; b</h1><p><b>one <i>t</i>wo<br>three\n\t four</p>five<p>six</article><footer>f") == "A & b\n\none two three four\n\nfive\n\nsix"
    assert text("<p>a<p>b<div>c<div>d</div>e</div>") == "a\n\nb\n\nc\n\nd\n\ne"
    assert text("<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>") == "x\n\ny\n\n1\n\n2\n\n3"
    assert text("1 < 2 &lt;p&gt; &#233;&eacute;&am &amp x &nbsp; y") == "1 < 2 <p> éé&am & x y"
    assert text("<p>a<!-- <p>no</p> -->b<script>var t='</p>';</script>c<style>p{}</style><p title=\"a>b\" x='<p>'>d<foo") == "abc\n\nd"
    assert text("a<script>never closed <p>b") == "a" and text("a<!-- never closed <p>b") == "a"
    assert text("") == text("<article></article>") == text("<p> \n</p>") == ""


def test_what_is_no_content():
    page = """<body class="has-sidebar"><header>site</header><div class="cookie-notice">ok?</div><div id="wrap" class="content nav-open"><main><article class="post ad-free"><header><h1>Title</h1></header>
    <p>Text.</p><div class="share">tweet</div><aside>more</aside><form>mail <input></form><p hidden>h</p><p style="display: none">h</p><p>End.</p><section id="comments"><p>first!</p></section></article></main></div>
    <div role="complementary">side</div><noscript>js</noscript><footer>foot</footer></body>"""
    assert text(page) == "Title\n\nText.\n\nEnd."
    assert text('<div class="menu">m</div><div><h1>T</h1><p>no article tag</p></div><div class="advert">x</div>') == "T\n\nno article tag"


def rows(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string")


def told(df):
    return sorted(tuple(r) for r in df.select("page_id", "url", "text", "n_chars").collect())


def test_templates_of_a_host(spark):
    page = "<body><div class='x1'><span>Our shop</span> sells</div><div><h1>{0}</h1><p>Story {0}.</p></div><div class='x2'><div>All rights</div> reserved</div></body>"
    data = [(k, f"http://a.example/{k}", page.format(k)) for k in range(6)] + [(10, "http://b.example/", page.format(10))]
    got = {r[0]: r[2] for r in told(main_text(rows(spark, data)))}
    assert all(got[k] == f"{k}\n\nStory {k}." for k in range(6))
    assert got[10] == "Our shop sells\n\n10\n\nStory 10.\n\nAll rights\n\nreserved"


def test_copies_and_shared_passages_stay(spark):
    """Copies of one page are no template, and prose that articles share stays; a box that articles share goes."""
    box = "<div>Support our work</div>"
    data = [(k, "http://a.example/x", f"<article><p>shared</p><p>{k // 4}</p>{box}</article>") for k in range(20)]
    data += [(k, "http://c.example/x", "<body><div><p>same page</p></div></body>") for k in range(20, 40)]
    got = {r[0]: r[2] for r in told(main_text(rows(spark, data).repartition(5)))}
    assert all(got[k] == f"shared\n\n{k // 4}" for k in range(20)) and all(got[k] == "same page" for k in range(20, 40))


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in main_text(pages).collect()}
    for r in pages.collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n\n".join(x for x in want if x) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    assert len(got) == 250


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    data = [(1, "http://a.example/", None), (1, "http://a.example/", None), (2, None, "<p>x"), (None, "nonsense", ""), (3, "//User@B.example:80/", "<p>y"), (4, "http://", "퟿&#xD800;&#0;")]
    df = rows(spark, data).withColumns({"host": F.lit(1), "row": F.lit(2), "blocks": F.lit("z")})
    got = [tuple(r) for r in main_text(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "http://a.example/", "", 0)] * 2 + [(2, None, "x", 1), (None, "nonsense", "", 0), (3, "//User@B.example:80/", "y", 1), (4, "http://", "퟿��", 3)]))
    assert main_text(df.where("false")).count() == 0


def test_long_pages_take_linear_time():
    for piece in ("<div>", "<p>a", "<a \"", "<", "<!--", "&amp", "<script>", "<ul><li>", "</p>", "<b", "<td>", "<article>"):
        began = time.time()
        digest(piece * 20_000)
        assert time.time() - began < 20, piece
