"""Main text of pages whose names and end tags mislead."""

import pytest

from weftgraph.llm import htmltext

TREE = htmltext.trained_tree()
FIRST, SECOND = "one two three four five six seven eight nine ten " * 3, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3
WANT = FIRST.strip() + "\n\n" + SECOND.strip()
TEXT = f"<p>{FIRST}</p><p>{SECOND}</p>"
ARTICLE = f"<article>{TEXT}</article>"


@pytest.mark.parametrize(
    "page",
    [
        f'<html><body class="post has-sidebar">{ARTICLE}</body></html>',
        f'<html class="has-sidebar"><body>{TEXT}</body></html>',
        f'<body><div id="page-header-fixed">{ARTICLE}</div></body>',
        f'<body><div class="has-comments"><div><main class="menu-open">{TEXT}</main></div></div></body>',
        f'<body><div class="has-sidebar"><div role="main">{TEXT}</div></div></body>',
        f'<body><article class="post comments-open">{TEXT}</article></body>',
        f'<form id="aspnetForm">{ARTICLE}</form>',
        f"<html><head><title>T</title><body>{ARTICLE}</body></html>",
        f"<head><meta charset=x><style>p {{}}</style>{ARTICLE}",
        f"<head><title>T</title><script>if (a < b) x('</p>')</script></head>{ARTICLE}",
        f"<body><div><button>Menu</div>{ARTICLE}</body>",
        f"<body><div><button>Menu</div>{ARTICLE}<div><button>Go</button></div></body>",
        f"<body><button>Menu{ARTICLE}</body>",
        f"<body><div><select><option>a<option>b</div>{ARTICLE}</body>",
        f"<body><object data=x>{ARTICLE}</body>",
        f"<body><iframe src=x>{ARTICLE}<iframe src=y></iframe></body>",
        f"<body><object><object>in</object>out</object>{ARTICLE}</body>",
        f"<body><button><div>Menu</div></button>{ARTICLE}</body>",
    ],
)
def test_article_is_whole(page):
    assert htmltext.main_text(page, TREE) == WANT


def test_comments_and_related_links_stay_outside():
    page = f'<body class="has-sidebar">{ARTICLE}<div class="sidebar"><p>{FIRST}</p></div><div id="comments"><article class="comment"><p>{FIRST}</p></article></div><div class="related"><article><p>{SECOND}</p></article></div></body>'
    assert htmltext.main_text(page, TREE) == WANT


def test_many_unclosed_elements_take_no_square_time():
    page = "<body>" + "<p>word word<svg><object><iframe>" * 20_000
    assert len(htmltext.blocks_of(page)) == 20_000


P1, P2, P3 = "The first paragraph says a few things about the day.", "A second one follows it and says some more of it.", "The last one ends what the others began to tell us."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><p>{P1}</p><p><a href=x>{P2}</a></p><p>{P3}</p></article>", [P1, P2, P3]),
        (f"<head><title>T</title><article><p>{P1}</p></article>", [P1]),
        (f'<body class="single has-sidebar comments-open"><article><p>{P1}</p></article></body>', [P1]),
        (f"<article><header><h1>Title</h1></header><p>{P1}</p></article>", ["Title", P1]),
        (f"<article><p title=it's>{P1}</p><p>{P2}</p></article>", [P1, P2]),
        (f'<article><p title=a"b data-x = \'>\' hidden>{P1}</p></article>', [P1]),
        (f'<article><a href="/x?a=1&b=2">{P1}</a></article>', [P1]),
        (f"<body><p>{P1} {P2} {P3}</p><div><a href=/>Home</a></div></body>", [f"{P1} {P2} {P3}"]),
        (f"<article><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><p>{P1}</p></article>", ["One", "Two", P1]),
        (f'<article><header class="site-header"><p>{P2}</p></header><p>{P1}</p></article>', [P1]),
        (f"<header><h1>Site name</h1></header><main><header><h1>Title</h1></header><p>{P1}</p></main><footer>{P2}</footer>", ["Title", P1]),
    ],
)
def test_page_shapes(page, want):
    assert htmltext.main_text(page, TREE) == "\n\n".join(want)


def test_generated_pages_block_by_block():
    """Pages of random parts whose kind is known where they are written."""
    import random

    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(1, 9)))
    text = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    link = lambda t: f'<a href="/{word()}">{t}</a>'
    for _ in range(200):
        want, inner = [], []
        for _ in range(r.randint(1, 9)):
            kind, t = r.randint(0, 7), text(1, 60)
            if kind == 0:
                inner.append(f"<h2>{t}</h2>")
            elif kind == 1:
                inner.append(f"<p>{link(t)}")
            elif kind == 2:
                inner.append(f"<blockquote><b>{t}</b></blockquote>")
            elif kind == 3:
                inner.append(f"<ul><li>{t}</ul>")
            elif kind == 4:
                inner.append(f"<figure><img src=x alt='no text'><figcaption>{t}</figcaption></figure>")
            elif kind == 5:
                inner.append(f"<table><tr><td>{t}</td></tr></table>")
            else:
                inner.append(f"<p>{t}</p>")
            want.append(t)
            if r.random() < 0.3:
                inner.append(r.choice([f"<script>var x='<p>{text(5, 9)}</p>'</script>", f'<div class="ad">{text(3, 50)}</div>', f'<aside><p>{text(3, 60)}</p></aside>', f'<div class="comments"><p>{text(5, 70)}</p></div>', f"<form><label>{text(1, 5)}</label><button>{text(1, 2)}</button></form>", "<!-- <p>not this</p> -->", f"<style>p {{ {word()}: 1 }}</style>"]))
        body = [f"<{r.choice(['article', 'main'])} id={word()}>", *inner]
        body.append("</article></main>")
        before = r.choice(["", f"<nav><ul><li>{link(text(1, 2))}</li><li>{link(text(1, 2))}</li></ul></nav>", f'<div id="header"><p>{text(3, 30)}</p></div>', f'<div role="navigation" class="menu">{link(text(1, 3))}</div>'])
        after = r.choice(["", f"<footer><p>{text(3, 40)}</p></footer>", f'<section class="comments"><p>{text(10, 90)}</p></section>', f'<div class="cookie-notice">{text(5, 40)}</div>', f'<div class="sidebar"><p>{text(20, 60)}</p></div>'])
        page = f"<html><head><title>{text(1, 5)}</title></head><body>{before}{''.join(body)}{after}</body></html>"
        assert htmltext.main_text(page, TREE) == "\n\n".join(want), page


def test_extract_of_odd_tables(spark):
    long = "<article>" + "<p>one two three four five six</p>" * 30_000 + "</article>"
    schema = "page_id long, url string, html string, text string, n_chars int"
    df = spark.createDataFrame([(1, "u", long, "t", 0), (2, "u", ARTICLE, "t", 0), (2, "u", ARTICLE, "t", 0), (None, None, None, None, None)], schema)
    got = sorted((r.page_id or 0, r.n_chars) for r in htmltext.extract(df).collect())
    assert got == [(0, 0), (1, 30_000 * 29 - 2), (2, len(WANT)), (2, len(WANT))]
    assert htmltext.extract(df.where("false")).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ("<body><h1>Title here</h1><p>Rain fell today.</p><p>All is well.</p></body>", ["Title here", "Rain fell today.", "All is well."]),
        ("<p>Hi.</p>", ["Hi."]),
        *((f'<div class="{names}"><p>Rain fell today.</p></div>', ["Rain fell today."]) for names in ("layout has-sidebar", "no-sidebar", "with-navigation", "main-content has-sidebar")),
        ('<div class="post-header"><h1>My title</h1></div><p>Rain fell today.</p>', ["My title", "Rain fell today."]),
        ('<article><div class="article-header"><h1>My title</h1></div><p>Rain fell.</p></article>', ["My title", "Rain fell."]),
        ("<section><header><h1>My title</h1></header><p>Rain fell today.</p></section>", ["My title", "Rain fell today."]),
        (f"<div><p>{FIRST}</p><p>The end.</p></div>", [FIRST.strip(), "The end."]),
        ('<article><p>A b c.</p><div class="gdpr">We use things.</div><div class="author-bio">Ann writes.</div><div class="paywall-box">Pay now.</div></article><div class="more-stories"><article><p>Other one.</p></article></div>', ["A b c."]),
        ('<div class="sidebar"><p>Rain fell today.</p></div><div class="page-header"><p>Site.</p></div>', []),
        (f"<ul><li><a href=a>a</a></li><li><a href=b>b</a></li></ul><p>{FIRST}</p><p>Short.</p>", [FIRST.strip(), "Short."]),
    ],
)
def test_pages_without_an_article_around_the_text(page, want):
    assert htmltext.main_text(page, TREE) == "\n\n".join(want)


@pytest.mark.parametrize("around", [("", ""), ("<body><p>x</p>", "</body></html>")])
def test_open_quotes_take_no_square_time(around):
    assert len(htmltext.blocks_of(around[0] + '<p a="b ' * 128_000 + around[1])) >= 1
    assert htmltext.main_text("<p>Text stays <b and what follows it", TREE) == "Text stays <b and what follows it"
