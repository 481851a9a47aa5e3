"""Main text of hand-made pages, and consensus over a host."""

from glossa.llm.html import Page, extract, host_paths, main_text

PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div class="sidebar-left"><p>side</p></div>
<main><article class="post-12"><header><h1>Title &amp; more</h1><p class="byline">By X</p></header><p>First <b>bold</b> para.<p>Second<br>para &lt;x&gt; &#233;
<ul><li>one<li>two</ul><div class="ad-box">BUY</div><table><tr><td>a<td>b<tr><td>c</table><form>Name <input></form>
<script>if(a<b)"</p>"</script><div class="comments"><p>Nice!</p></div></article></main><aside>x</aside><footer>f</footer>"""


def test_main_text():
    assert main_text(PAGE, []) == "Title & more\n\nFirst bold para.\n\nSecond para <x> é\n\none\n\ntwo\n\na b\n\nc"


def test_odd_markup():
    assert main_text(None, []) == "" and main_text("", []) == "" and main_text("plain text", []) == "plain text"
    assert main_text("<p>a</div></span><p>b &nbsp; c<!-- <p>no --><p>", []) == "a\n\nb c"
    assert main_text("<div><p>x < y</p><script>never closed", []) == "x < y"
    assert len(main_text("<div>" * 3000 + "deep" + "</div>" * 3000, [])) == 4
    assert main_text("<p>" + "word " * 100_000, []) == ("word " * 100_000).strip()


def test_points_favour_text_over_links():
    page = Page("<body><div class='m'>" + "<p>long text of the article here</p>" * 3 + "</div><div class='l'>" + "<p><a href=x>link text that is long too, very</a></p>" * 5 + "</div></body>")
    assert page.path[page.containers()[0][0]].endswith("div.m")


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "s") for i, u, h in rows], "page_id long, url string, html string, host string")


def test_a_host_agrees_on_its_container(spark):
    body = "<body><div class='story-{i}'><p>{t}</p></div><div class='extra'><p>{x}</p></div></body>"
    rows = [(i, "http://a.com/" + str(i), body.format(i=i, t="the article of this page, quite long " * 3, x="short")) for i in range(9)]
    # This page's other part is longer, but the host has decided.
    rows.append((9, "http://a.com/9", body.format(i=9, t="brief article", x="much longer text that is no article at all " * 3)))
    voted = {r["host"]: r["paths"] for r in host_paths(pages(spark, rows)).collect()}
    assert voted["a.com"][0] == ">body>div.story-#"
    got = {r["page_id"]: r["text"] for r in extract(pages(spark, rows)).collect()}
    assert got[0].startswith("the article") and got[9] == "brief article"


def test_sibling_containers_are_both_text(spark):
    body = "<div class='c{i}'><p>{a}</p></div><div class='x'><p>{b}</p></div><div class='sidebar'><p>side</p></div>"
    rows = [(i, "http://a.com/", body.format(i=i, a=f"intro {i} " * 10, b="the story goes on " * 12)) for i in range(5)]
    for r in extract(pages(spark, rows)).collect():
        assert r["text"] == ("intro %d " % r["page_id"] * 10).strip() + "\n\n" + ("the story goes on " * 12).strip()


def test_names_that_only_sound_like_noise():
    main = "<main><p>one</p><section class='related-work'><p>two</p></section><div class='notice-of-findings'>three</div>{}</main>"
    assert main_text(main.format("<div class='related-posts'>no</div><div class='ad box'>no</div><div id='comments'>no</div>"), []) == "one\n\ntwo\n\nthree"


def test_a_rare_template_falls_back_to_its_own_container(spark):
    rows = [(i, "http://a.com/", f"<div class='m'><p>{'common text ' * 20}</p></div>") for i in range(40)]
    rows.append((40, "http://a.com/", "<section class='rare'><p>a page of its own kind</p></section>"))
    got = {r["page_id"]: r["text"] for r in extract(pages(spark, rows)).collect()}
    assert got[40] == "a page of its own kind" and got[1].startswith("common text")


def test_equal_votes_and_deep_paths(spark):
    two = "<div class='a'><p>same length one</p></div><div class='b'><p>same length two</p></div>"
    voted = host_paths(pages(spark, [(1, "http://a.com/", two), (2, "http://a.com/", two)])).first()["paths"]
    assert voted == [">div.a", ">div.b"] and main_text(two, voted) == "same length one\n\nsame length two"
    deep = Page("<div class=long-name>" * 500 + "x")
    assert len(set(deep.path)) == len(deep.path) and max(map(len, deep.path)) < 2100


def test_clashing_columns(spark):
    df = pages(spark, [(1, "http://a.com/", "<p>x y</p>")]).withColumnRenamed("host", "text")
    assert extract(df).first()["text"] == "x y"


def test_odd_rows(spark):
    rows = [(1, None, PAGE), (2, "http://a.com/", None), (None, "nothing", "<p>x"), (3, "http://a.com/x", ""), (1, None, PAGE)]
    got = extract(pages(spark, rows)).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["text"] for r in got}[None] == "x" and extract(pages(spark, [])).count() == 0
