import pytest

from txnwatch.llm.html_text import extract, main_text

P = "The story of the house is told in the book that was on the table and it was read by all of them at once in the end."


def test_article_without_the_rest():
    html = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">The of and</a></li></ul></nav><!-- <p>no</p> -->
    <div class="ad">{P}</div><aside><p>{P}</p></aside><form><p>{P}</p></form><div id="cookie-notice">{P}</div>
    <article><h1>A &amp; B</h1><p><b>{P}<br>More&nbsp; of
    it &lt;here&gt;.<p>Short.</p><div class="comments"><p>{P}</p></div><p>{P} 2</article><footer>&copy; {P}</footer>"""
    assert main_text(html) == f"A & B\n{P} More of it <here>.\nShort.\n{P} 2"


def test_without_an_article():
    html = f"<body><div><a href=x>One</a> <a href=y>Two</a></div><div><p>{P} {P}<p>Yes, it was so.<p>{P} {P}</div><div>zq xv 12 kk {'zz ' * 60}</div></body>"
    assert main_text(html) == f"{P} {P}\nYes, it was so.\n{P} {P}"


def test_odd_markup():
    assert main_text(None) == main_text("") == main_text("<") == main_text("<script>x") == ""
    assert main_text("<article><h1>Head</h1><p>Only.") == "Head\nOnly."
    assert main_text("<article><p>a < b &am</p><p title='x>y'>c</p><p") == "a < b &am\nc"
    assert main_text("<nav><p>x</nav><article><p>" + "w " * 50000 + "</article>") == ("w " * 50000).strip()


def test_rows(spark):
    rows = [(1, "u", f"<article><p>é {P}</p></article>", 3), (1, "u", f"<article><p>é {P}</p></article>", 3), (None, None, None, 3)]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted(((r.page_id, r.text, r.n_chars) for r in out), key=str) == sorted([(1, f"é {P}", len(P) + 2)] * 2 + [(None, "", 0)], key=str)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_articles_of_the_table(spark):
    """Every paragraph inside an article comes out, in order, and nothing else."""
    import re
    from html import unescape

    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in df.collect()}
    for r in extract(df).collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", html[r.page_id], re.S)
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", body[1] if body else "")
        want = [" ".join(unescape(re.sub(r"<[^>]*>?", " ", x) if "<b" in x else x).split()) for x in parts]
        assert r.text == "\n".join(x for x in want if x)


@pytest.mark.parametrize("name", ["home has-sidebar", "content no-sidebar", "no-ads", "share-price", "page with_sidebar", "content-sidebar", "menu-free"])
def test_names_of_parts_are_not_names(name):
    for page in (f"<body class='{name}'><article><p>{P}</article>", f"<body><section id='{name}'><article><p>{P}</article></section>", f"<body><article><div class='{name}'><p>{P}</div></article>"):
        assert main_text(page) == P
    assert main_text(f"<body class='{name}'><div class='{name}'><p>{P} {P}</div>") == f"{P} {P}"


def test_body_and_containers_by_name():
    assert main_text(f"<html class='modal'><body class='widget menu'><p>{P} {P}") == f"{P} {P}"
    for tag in ("article", "main"):
        html = f"<body><div class='widget'><p>{P} 1</p><div><{tag}><p>{P}</p><div class='share'>{P} 2</div></{tag}></div><p>{P} 3</p></div>"
        assert main_text(html) == P
    comments = f"<article><p>{P}</p><div class='comments'><article><p>{P} 1</p></article></div></article>"
    assert main_text(f"<main>{comments}<div id='comments'><article class='comment-body'><p>{P} 2</article></div></main>") == P
    assert main_text(f"<nav><div class='menu'><article><p>{P}</article></div></nav>") == main_text(f"<div class='menu'><nav><article><p>{P}</article></nav></div>") == ""


@pytest.mark.parametrize("name", ["ad", "x sidebar", "cookie-notice", "ad-slot-2", "comment-list", "site-footer", "main_nav", "navigation", "share-buttons", "related-posts", "top-banner"])
def test_names_outside(name):
    assert main_text(f"<article><p>{P}</p><div class='{name}'><p>{P} 2</p></div></article><div id='{name}'><p>{P} {P}</div>") == P


PROSE = "The reader of the page is not to see this text in the main part of it, as it is what the others have to say on the matter and what the site wants from them. " * 2
ARTICLE = "The article is about the river and the town that it runs by, and of the people who have lived there for a long time with all of its floods and of its fires. "


@pytest.mark.parametrize(
    "name",
    "article-comments reader-comments user-comments comments-section disqus_thread header page-header site-header alert gdpr-notice announcement "
    "disclaimer google-ads adsbygoogle dfp-ad login-box search-form pagination copyright comments cookie-banner sidebar".split(),
)
def test_named_parts_go(name):
    beside = f"<body><div class='{name}'><p>{PROSE}</p></div><article><p>{ARTICLE}</p></article></body>"
    assert main_text(beside) == ARTICLE.strip()
    without = f"<body><div class='{name}'><p>{PROSE}</p></div><p>{ARTICLE}</p></body>"
    assert main_text(without) == ARTICLE.strip()
    if "header" not in name:
        inside = f"<body><article><p>{ARTICLE}</p><div id='{name}'><p>{PROSE}</p></div></article></body>"
        assert main_text(inside) == ARTICLE.strip()


@pytest.mark.parametrize(
    "text",
    [
        "Il fiume attraversa la città vecchia e poi scende verso il mare, dove ogni mattina i pescatori tornano con le barche piene di pesce fresco e raccontano storie.",
        "Rzeka płynie przez stare miasto, a potem skręca w stronę morza, gdzie każdego ranka rybacy wracają z pełnymi łodziami świeżych ryb i opowiadają historie.",
    ],
)
def test_other_languages(text):
    page = f"<body><nav><a href=x>Menu</a></nav><h1>{text[:20]}</h1><p>{text}</p><p>{text} {text}</p><ul><li><a href=y>{text}</a></li></ul></body>"
    assert main_text(page) == "\n".join([text[:20].strip(), text, f"{text} {text}"])


def test_short_pages_and_linked_paragraphs():
    assert main_text("<body><p>Hello world, a short page.</p></body>") == "Hello world, a short page."
    linked = "<article><p><a href=x>All of this paragraph is a link to another page</a></p><p>And a short one.</p></article>"
    assert main_text(linked) == "All of this paragraph is a link to another page\nAnd a short one."
    assert main_text(f"<article><p>{ARTICLE}</p><ul><li><a href=1>One link</a></li><li><a href=2>Two links</a></li></ul></article>") == ARTICLE.strip()
    assert main_text(f"<div><p>{PROSE}</p></div><article><p>{ARTICLE}</p></article>") == ARTICLE.strip()
