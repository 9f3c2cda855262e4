from paperloom.llm import html_text
from paperloom.llm.html_text import blocks_of, extract, first_pass, main_text
from paperloom.llm.queries import QUERIES

PAGE = """<!DOCTYPE html><html><head><title>Cats</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad 3 --><div class="ad">Buy the best of it now for less.</div>
<article><h1>Cats &amp; dogs</h1><p><b>Cats &lt;3 dogs.<br><p>Short.<p>The cat sat on the mat,
  and it was &eacute;pat&eacute;e.</p><aside>See also</aside><form><label>Mail</label><input name=q></form><p>Zq*** xw### vv&&& yy%%%</p><footer>By me</footer></article>
<div id="comments"><p>I like the cat and the dog in this story, it was what I wanted to read.</p></div><footer>&copy; 2024</footer>"""


def test_article_alone():
    assert main_text(PAGE) == "Cats & dogs Cats <3 dogs. Short. The cat sat on the mat, and it was épatée. Zq*** xw### vv&&& yy%%%"


def test_rules_without_an_article_element():
    long = "The cat was on the mat and it was not what they had said it would be, so we left."
    page = f"<body><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul><div>Menu words</div><p>{long}</p><h2>A heading</h2><p>{long}</p><p>Brief.</p><p>{long}</p><div><a href=z>{long}</a></div><div>Tail</div></body>"
    assert main_text(page) == f"{long} A heading {long} Brief. {long}"
    assert main_text(f"<p>{long}</p><p>" + "zxqv " * 40 + f"</p><p>{long}</p>") == f"{long} {long}"


def test_blocks_inside_an_article_are_decided_too():
    long = "The cat was on the mat and it was not what they had said it would be, so we left."
    links = "".join(f"<li><a href=/{i}>Other news {i}</a></li>" for i in range(4))
    page = f"<article><h1>Cats</h1><p>{long}</p><ul>{links}<li>More</li>{links}</ul><p>Brief.</p><p>{long}</p></article>"
    assert main_text(page) == f"Cats {long} Brief. {long}"
    assert [b.text for b, x in zip(blocks_of(page), first_pass(blocks_of(page))) if x is None] == ["Cats", "More", "Brief."]


def test_first_pass_decides_with_and_without_an_article(monkeypatch):
    long = "The cat was on the mat and it was not what they had said it would be, so we left."
    links = "".join(f"<li><a href=/{i}>Other news {i}</a></li>" for i in range(4))
    table = "red | green, blue | " + "grey " * 29 + "grey"
    body = f"<h1>Cats</h1><p>{long}</p><p>Brief.</p><p>{long}</p><p>{'zxqv ' * 60}</p><p>{long}</p><ul>{links}<li>More</li>{links}</ul><p>{long}</p><p>{table}</p><p>{long}</p>"
    want = f"Cats {long} Brief. {long} {long} {long} {table} {long}"
    pages = [f"<article>{body}</article>", f"<body><div>{body}</div></body>"]
    assert [main_text(p) for p in pages] == [want, want]
    monkeypatch.setattr(html_text, "first_pass", lambda blocks, rules: [None] * len(blocks))
    assert want not in [main_text(p) for p in pages]


def test_notices_by_their_wording():
    long = "The cat was on the mat and it was not what they had said it would be, so we left."
    for notice in ("Advertisement", "We use cookies to make this site better. Accept all cookies", "Share this on Facebook", "Tweet | Share | Print", "Sponsored content", "12 comments", "Subscribe to our newsletter"):
        assert main_text(f"<article><p>{long}</p><p>{notice}</p><p>{long}</p></article>") == f"{long} {long}"
        assert main_text(f"<p>{long}</p><p>{notice}</p><p>{long}</p>") == f"{long} {long}"
    assert main_text(f"<article><p>{long}</p><p>Advertisement was new then.</p><p>Share prices fell.</p></article>") == f"{long} Advertisement was new then. Share prices fell."
    for name in ("commentlist", "usercomments", "comment-17", "cookiebar", "topadvert"):
        assert main_text(f'<article><p>{long}</p><div class="{name}"><p>{long}</p></div></article>') == long
    assert main_text(f'<article><p class="commentary">{long}</p></article>') == long


def test_pages_without_their_article_tags(spark, sf):
    """The rules alone: at least 95 % of the text is kept, and nothing else, on four of five pages."""
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    fit = 0
    for page in pages:
        bare, whole = main_text(page.replace("<article>", "").replace("</article>", "")), main_text(page)
        kept, rest = bare.split(), iter(whole.split())
        fit += len(bare) >= 0.95 * len(whole) and all(w in rest for w in kept)
    assert fit >= 0.8 * len(pages)


def test_adverts_and_notices_in_any_element():
    assert main_text('<article><p>One.</p><p class="advert">Buy it.</p><p hidden>Not seen.<p>Two<span class="cookie-notice"> we <span>bake</span> them</span>.</article>') == "One. Two."
    assert main_text("<article><p>a<b aria-hidden=true>x</b>b</p><div class=sidebar><p>no</p></div>c</article>") == "ab c"


def test_names_of_ancestors():
    for name in ("content no-sidebar", "has-sidebar", "with-ads", "page-without-comments"):
        assert main_text(f'<div class="{name}"><article><p>Kept.</p></article></div>') == "Kept."
    assert main_text('<div class="sidebar-layout"><article><p>Kept.</p><p>Too.</p></article></div>') == "Kept. Too."


def test_other_languages():
    chinese = "这是一个关于猫和狗的故事，他们在家里住了很多年，我们都很喜欢他们，也会和他们说话。"
    italian = "Il gatto nero dorme sulla sedia vicino alla finestra mentre piove forte nella strada vuota."
    menu = "<ul><li><a href=x>首页</a></li><li><a href=y>新闻</a></li></ul>"
    assert main_text(f"<body>{menu}<h2>猫</h2><p>{chinese}</p><p>{chinese}</p><div><a href=z>{chinese}</a></div></body>") == f"{chinese} {chinese}"
    assert main_text(f"<body><ul><li><a href=x>Uno</a></li></ul><p>{italian}</p><p>Breve.</p><p>{italian}</p></body>") == f"{italian} Breve. {italian}"
    assert main_text("<body><p>Short.</p><p>And sweet.</p><p><a href=x>Link</a></p></body>") == "Short. And sweet."


def test_broken_markup():
    assert main_text("") == main_text("<article>") == ""
    assert main_text("<article><p title='a>b\">x < y & z &amp; &am</article") == 'b">x < y & z & &am'
    assert main_text("<article><p>x < y &amp; &am") == "x < y & &am"
    assert main_text("<article><script>if (a</b>) {</article>") == ""
    assert main_text("<article><div hidden>no</div><p>a<b>b</b>c<br/>d&nbsp; e</article>") == "abc d e"
    assert len(blocks_of("<p>a" * 2000)) == 2000


def test_odd_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (3, "v", ""), (4, "w", "<article>" + "<p>word" * 50000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("key", "text", "n_chars"):
        pages = pages.withColumn(name, pages.url)
    got = sorted(map(repr, [(r.page_id, r.url, r.n_chars, r.text == main_text(h or "")) for r, h in ((r, dict((x[0], x[2]) for x in rows)[r.page_id]) for r in extract(pages).collect())]))
    assert got == sorted(map(repr, [(k, u, len(main_text(h or "")), True) for k, u, h in rows]))
    assert extract(pages.filter("false")).count() == 0


def test_query(spark, sf):
    rows = QUERIES["op2_html_main_text"](spark, sf).collect()
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(html)
    for r in rows:
        # independent of the block rules: these pages keep their text in one article element
        import html as h
        import re

        inner = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        want = " ".join(h.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert (r.text, r.n_chars) == (want, len(want))
