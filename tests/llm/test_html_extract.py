import html
import re

from lumengraph.llm import html_extract as S

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a> Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="sidebar"><p>Popular</p></div><article><h1>Title &eacute; &amp; more</h1><p>First   block<b> bold</b>.<p>Second<br>block <a href=x>link</a>
<div class="ad">Buy</div><form><label>Mail</label></form><section class="comments"><p>I agree</p></section><!-- gone --><p>Third &lt;b&gt;</article>
<footer>&copy; Site</footer></body></html>"""
TEXT = "Title é & more\nFirst block bold.\nSecond\nblock link\nThird <b>"


def test_page_by_its_own_structure():
    assert S.main_text(PAGE) == TEXT
    assert S.main_text(PAGE.replace("<article>", '<div class="content">').replace("</article>", "</div>")) == TEXT
    for odd in (None, "", "   ", "<", "<p", "<!-- x", "<script>x"):
        assert S.main_text(odd) in ("", "<")
    assert S.main_text("plain <i>text</i>") == "plain text"


def test_templates_by_host(spark):
    rows = [(i, f"http://h{i % 3}.example.com/{i}", f'<html><body><div class="x"><p>Menu words</p></div><div class="body-{i}"><p>Text {i} of host. ' + "word " * i + '</p></div><div class="list"><a href=1>One link</a> <a href=2>two</a></div></body></html>') for i in range(1, 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["host"]: r["template"] for r in S.templates(pages).collect()}
    assert set(found) == {"", "h0.example.com", "h1.example.com", "h2.example.com"}
    for r in S.extract(pages).collect():
        assert f"Text {r['page_id']} of host." in r["text"] and r["n_chars"] == len(r["text"]) and "link" not in r["text"]


def test_real_pages_against_a_parser_of_their_layout(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = S.extract(pages).collect()
    assert len(rows) == len(source)
    for r in rows:
        body = re.search(r"<article>(.*)</article>", source[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)[^>]*>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (2, "not a url", "", 2), (None, "http://a.example/x", "<p>hi", 3), (4, "http://a.example/y", PAGE, 4), (4, "http://a.example/y", PAGE, 4), (5, None, "x " * 200_000, 5)], "page_id long, url string, html string, host int")
    got = sorted(((r["page_id"] or 0, r["n_chars"]) for r in S.extract(pages).collect()))
    assert got == [(0, 2), (1, 0), (2, 0), (4, len(TEXT)), (4, len(TEXT)), (5, 399_999)]
    assert S.extract(pages.limit(0)).count() == 0


def test_the_articles_own_header_and_lists_stay_and_hidden_parts_go():
    page = '<body><header>Site</header><article><header><h1>Head</h1></header><div class="article-header">Line</div><p>Body</p><ul><li><a href=1>one</a><li><a href=2>two</a></ul><div hidden>secret</div></article></body>'
    assert S.main_text(page) == "Head\nLine\nBody\none\ntwo"


def test_deep_pages_take_linear_time():
    import time

    t = time.time()
    assert S.main_text("<div>" * 40_000 + "deep" + "</p></div>" * 40_000) == "deep"
    assert time.time() - t < 20


def without_article(i):
    long = "The same long words of this place, on every page of it. " * 5
    return f'<body><div class="a">{long}</div><div class="b"><p>Own text {i} of the page.</p><div class="c">Spread the word</div><p>More {i * 7}.</p></div><div class="d">{long}</div></body>'


def rows_of(pages):
    """Tokens of a host's pages by a plain count of every page's occurrences: no sums of hashes."""
    seen = {}
    for i, page in enumerate(pages):
        for t in S.Slots(page).measure():
            seen.setdefault((t.path, t.words), []).append((i, t))
    out, vectors = [], {}
    for (path, words), found in seen.items():
        first = found[0][1]
        vector = vectors.setdefault(tuple((i, t.times) for i, t in found), len(vectors) + 1)
        out.append(S.Token(path, words, first.parent, first.name, first.boiler, len(found), vector, *(sum(getattr(t, f) for _, t in found) for f in ("times", "text", "links"))))
    return out


def test_classes_decide_what_is_template(spark):
    pages = [without_article(i) for i in range(20)]
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    want = {i: f"Own text {i} of the page.\nMore {i * 7}." for i in range(20)}
    assert {r["page_id"]: r["text"] for r in S.extract(df).collect()} == want
    tokens = rows_of(pages)
    template = S.deduce(20, tokens)
    assert {i: S.main_text(p, template) for i, p in enumerate(pages)} == want
    # every token a class of its own: no text belongs to its container, and the constant text is taken for content
    split = [S.replace(t, vector=k) for k, t in enumerate(tokens)]
    assert S.main_text(pages[3], S.deduce(20, split)) != want[3]
    # the number of pages plays no part from two on; a single page repeats nothing
    for n in (2, 4, 7, 8):
        few = S.deduce(n, rows_of(pages[:n]))
        assert {i: S.main_text(p, few) for i, p in enumerate(pages[:n])} == {i: want[i] for i in range(n)}
    assert "The same long words" in S.main_text(pages[0], S.deduce(1, rows_of(pages[:1])))


def test_pages_that_are_all_alike_keep_their_text(spark):
    df = spark.createDataFrame([(i, "http://h.example/x", "<body><nav>Menu</nav><div>All the same text.</div></body>") for i in range(30)], "page_id long, url string, html string")
    assert {r["text"] for r in S.extract(df).collect()} == {"All the same text."}


def paper(i):
    return (
        f'<body><nav><a href=1>Home</a></nav><article><div class="head">Abstract</div><div class="abstract"><p>Summary {i} of a study.</p></div><div class="methods">Methods are as in the paper.</div>'
        f'<section class="related-work"><p>Others {i} wrote <a href=1>this</a> before.</p></section><div class="legal"><p>The law {i} in question is old.</p></div>'
        f'<div class="related"><a href=1>Read also {i}</a> <a href=2>and this {i * 3}</a></div><div class="notice">Terms apply to all of it.</div>'
        f'<div class="ad">Buy {i}</div><section class="comments"><p>I agree {i}</p></section></article><footer>End</footer></body>'
    )


def test_article_text_stays_whatever_its_containers_names_and_the_number_of_pages(spark):
    """Constant parts and names like boilerplate don't take text from an article; links and repeated notices under such names go."""
    own = lambda i: f"Abstract\nSummary {i} of a study.\nMethods are as in the paper.\nOthers {i} wrote this before.\nThe law {i} in question is old."
    for n in (1, 2, 7, 8, 20):
        df = spark.createDataFrame([(i, "http://h.example/x", paper(i)) for i in range(n)], "page_id long, url string, html string")
        # one page alone can't tell a notice that all pages have from its own text
        more = "\nTerms apply to all of it." if n == 1 else ""
        assert {r["page_id"]: r["text"] for r in S.extract(df).collect()} == {i: own(i) + more for i in range(n)}


def test_names_beside_an_article_in_main_are_boilerplate():
    body = '<article><p>Text of the article, of some length.</p></article>'
    assert S.main_text(f'<body><main>{body}<div class="related-posts"><p>Other posts</p></div></main></body>') == "Text of the article, of some length."
    assert S.main_text('<body><main><p>Text of the page, of some length.</p><section class="related-work"><p>Others wrote</p></section></main></body>') == "Text of the page, of some length.\nOthers wrote"
