import pytest

from tallyloom.llm import html_text as ht

ARTICLE = "<article><h1>Title</h1><p>First &amp; best.<p>Second\n  part<br>goes on &copy; 2025</article>"
WANT = "Title\n\nFirst & best.\n\nSecond part goes on © 2025"


def text(html):
    return "\n\n".join(ht.text_blocks(ht.parse(html)))


@pytest.mark.parametrize("around", [
    "{}", "<html><head><title>no</title><style>p{{}}</style><script>if (a < b) '</p>'</script></head><body>{}</body></html>",
    "<body><nav><ul><li><a href='/x'>menu</a></li></ul></nav><div class='ad'>buy</div>{}<footer>&copy; us</footer>", "<header>logo</header>{}<aside>side</aside>",
    "<div id=\"cookie-banner\">accept</div><form><input value='a>b'><button>go</button></form>{}", "<!-- <p>no</p> -->{}<section id='comments'><p>first!</p></section>",
    "<div class='Site-Header'>x</div>{}<div role=navigation>y</div>", "<main>{}</main><div class=sidebar>z</div>", "<svg><text>s</text></svg>{}<noscript>n</noscript><iframe>f</iframe>",
])
def test_other_parts_go(around):
    assert text(around.format(ARTICLE)) == WANT


def test_parts_within_the_article():
    html = "<article class='post-content'><header><h1>T</h1></header><div class='advert'>no</div><p class='notice-text'>stays</p><div class=comments>no</div><div class='entry-header'>own</div><div class='newsletter-content'>no</div><div class=notice>no</div></article>"
    assert text(html) == "T\n\nstays\n\nown"


@pytest.mark.parametrize("around", [
    "<div class='layout with-sidebar'>{}</div>", "<div class='page no-sidebar'>{}</div>", "<div class='site-main comments-closed'>{}</div>", "<div class='content ad-free'>{}</div>",
    "<div class='post related-posts-enabled'>{}</div>", "<form action=/><div>{}</div></form>", "<main><form>{}</form></main>", "<div class=widget>{}</div>",
])
def test_no_name_takes_an_article(around):
    assert text(around.format(ARTICLE)) == WANT
    assert text(around.format(ARTICLE.replace("article>", "main>"))) == WANT


@pytest.mark.parametrize("name", ["related-work", "search-and-rescue", "share-price", "ad-hoc-networks", "social-impact", "comments"])
def test_ids_of_headings_and_sections_in_an_article(name):
    assert text(f"<article><h2 id='{name}'>Head</h2><section id='{name}'>stays</section></article>") == "Head\n\nstays"


def test_names_of_what_is_not_another_part():
    assert text("<article><div class='share-price'>up</div><div class='share-buttons'>no</div><ol class='comment-list'><li><article>no</article></ol></article>") == "up"


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("plain", "plain"), ("a &lt;b&gt; &#233; &nbsp; c", "a <b> é c"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("<p>cut &am", "cut &am"),
    ("<p>cut <a hre", "cut"), ("<p>x</b></i></p></div>y", "x\n\ny"), ("<p>a<b>b</b>c</p>", "abc"), ("<ul><li>one<li>two</ul>three", "one\n\ntwo\n\nthree"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("<P CLASS=x>upper</P>", "upper"), ("<div/>in<div>deep", "in\n\ndeep"), ("<script>never ends", ""),
    ("<p title=\"a>b\">q</p>", "q"), ("<p title='open>q</p>", "q"), ("<!-- open", ""), ("<dl><dt>a<dd>b<dt>c</dl>", "a\n\nb\n\nc"),
])
def test_markup(html, want):
    assert text(html) == want


def test_deep_and_long_pages():
    assert text("<div>" * 3000 + "x" + "</div>" * 3000) == "x"
    assert len(text("<p>" + "word " * 200_000)) == 999_999
    assert ht.site_tree(ht.parse("<div>" * 600 + "x"))[1]


@pytest.mark.parametrize("url, want", [("http://A.Example:80/x", "a.example"), ("//h/x", "h"), ("https://u:p@h.org?q", "h.org"), (None, ""), ("", ""), ("no url", "")])
def test_hosts(url, want):
    assert ht.host(url) == want


@pytest.fixture(scope="module")
def site(spark, tmp_path_factory):
    """No telling names: what the host repeats is only seen over its pages."""
    page = "<html><body><div class=top>Home News Contact</div><div class=x1><div class=inner>{}</div></div><div class=bottom><span>All rights</span></div></body></html>"
    rows = [(i, f"http://big.example/{i}", page.format(f"<h2>Story {i}</h2><p>What happened on day {i}.</p><p>The end of {i}.</p>")) for i in range(40)]
    rows += [(100, "http://small.example/1", page.format("<p>only page</p>")), (101, None, page.format("<p>no host</p>")), (None, "http://big.example/n", None), (None, "http://big.example/n", None)]
    rows += [(200 + i, f"http://copies.example/{i}", page.format("<article><p>the same article</p></article>")) for i in range(20)]
    path = str(tmp_path_factory.mktemp("site") / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'a' AS text", "'b' AS _row", "1 AS host").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def test_what_a_host_repeats_goes(site):
    rows = {r["page_id"]: r for r in ht.main_texts(site).collect()}
    assert rows[7]["text"] == "Story 7\n\nWhat happened on day 7.\n\nThe end of 7." and rows[7]["n_chars"] == len(rows[7]["text"])
    assert rows[100]["text"] == "Home News Contact\n\nonly page\n\nAll rights" and "no host" in rows[101]["text"]
    assert rows[None]["text"] == "" and rows[None]["n_chars"] == 0
    assert rows[205]["text"] == "the same article"
    assert ht.main_texts(site).count() == site.count()


def test_importance_is_between_nothing_and_one(site):
    rows = ht.blocks(site, {"_id": site["page_id"], "_url": site["url"], "_html": site["html"]})
    found = ht.importance(rows.mapInArrow(ht._collect, ht._SCHEMA)).collect()
    assert found and all(-1e-9 <= r["importance"] <= 1 + 1e-9 and r["most"] >= r["importance"] - 1e-9 for r in found)


def test_small_flushes_give_the_same(site, monkeypatch):
    want = sorted((str(r["page_id"]), r["text"]) for r in ht.main_texts(site).collect())
    monkeypatch.setattr(ht, "_HELD", 3)
    assert sorted((str(r["page_id"]), r["text"]) for r in ht.main_texts(site).collect()) == want


def test_empty(spark, site, tmp_path):
    site.where("false").coalesce(1).write.parquet(str(tmp_path / "none.parquet"))
    assert ht.main_texts(spark.read.schema(site.schema).parquet(str(tmp_path / "none.parquet"))).count() == 0


@pytest.mark.parametrize("page, expected", [
    ("<p>a<svg/>b</p><p>c</p>", "a\n\nb\n\nc"), ("<p>a<svg viewBox='0 0 1 1' />b</p><math/><p>c</p>", "a\n\nb\n\nc"), ("<p>a<svg><path d='x'/></svg>b</p>", "a\n\nb"),
    ("<form action='/'><h1>Title</h1><p>All of the page stands in one form.</p><input></form>", "Title\n\nAll of the page stands in one form."),
    ("<div class='widget'><p>A long enough text in a named frame.</p></div><nav>Home</nav>", "A long enough text in a named frame."),
    ("<body><p>The text itself, long.</p><form>Search <input></form></body>", "The text itself, long."),
    ("<body><p>Short.</p><div class='comments'>Readers wrote much more than the author did.</div></body>", "Short."),
    ("<main><p>Short.</p></main><form>A form with more text than the article that it stands beside.</form>", "Short."),
    ("<nav>Home and a great many other links that outweigh the text</nav><p>Short.</p>", "Short."),
])
def test_frames_and_foreign_elements(page, expected):
    assert text(page) == expected
