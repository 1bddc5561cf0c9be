from siltstone.llm.html_text import extract, extract_pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body class="ad-free comments">
<nav><ul><li><a href="/a">Menu one</a></li></ul></nav><header>Site name</header><div class="ad">Buy now, today, cheap.</div>
<div class="cookie-notice">We use cookies, lots of them, really.</div><aside>Side, bar, text</aside>
<article><h1>Head &amp; line</h1><p>First   para,
with <b>bold</b>, and<br>a break.<p>Second &lt;para&gt; unclosed &#233; &nbsp; end<div class="share-links">Share</div><ul><li>item one<li>item two</ul>
<form>Name <input></form><section class="comments"><p>A reader, says, this.</p></section></article>
<footer>&copy; foot, er</footer></body></html>"""


def test_article_only():
    assert extract(PAGE) == "Head & line\nFirst para, with bold, and a break.\nSecond <para> unclosed é end\nitem one\nitem two"


def test_container_without_article():
    page = "<body><div id=menu><a href=x>one</a> <a href=y>two</a></div><div class=main><p>Long text, with commas, here.</p><p>More text, and more, to read.</p></div></body>"
    assert extract(page) == "Long text, with commas, here.\nMore text, and more, to read."


def test_words_of_class_and_id():
    page = '<article><div class="entry-header"><h1>Title</h1></div><p>Body, text.</p><div class="adBox2">x</div><div id="ad3">y</div><div class="shadow">kept</div><div class="alert">z</div></article><div class="siteHeader">w</div>'
    assert extract(page) == "Title\nBody, text.\nkept"


def test_odd_pages():
    assert extract(None) == extract("") == extract("<nav>only menu</nav>") == extract("<!-- never closed <p>x</p>") == ""
    assert extract("plain text") == "plain text"
    assert extract("<article><p>cut off here <a hre") == "cut off here"
    assert extract("<p>" + "<div>" * 3000 + "deep, down" + "</div>" * 10) == "deep, down"
    assert extract("<script>x</script><p>after</p>") == "after"
    assert extract('<p title="a>b">quoted</p>') == "quoted"
    assert len(extract("<article>" + "<p>word, word</p>" * 20000 + "</article>").split("\n")) == 20000


def test_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_pages(pages).collect()
    assert len(got) == 3 and got[0] == got[1] and got[2]["text"] == ""
    assert extract_pages(pages.limit(0)).count() == 0


def test_deep_nesting_is_linear():
    import time

    began = time.process_time()
    assert extract("<div>" * 100_000 + "deep, down") == "deep, down"
    assert extract("<b><p>" * 50_000 + "deep, down").endswith("deep, down")
    assert time.process_time() - began < 4


def test_random_pages_by_construction():
    """Brute force: pages built from an article's blocks and page parts in random places; the blocks come back whole."""
    import html
    import random

    r = random.Random(17)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8)))
    phrase = lambda n: " ".join(word() for _ in range(n))
    parts = [
        lambda: f"<nav><ul>{''.join(f'<li><a href=/{word()}>{phrase(2)}</a>' for _ in range(5))}</ul></nav>", lambda: f"<header><a href=/>{phrase(2)}</a></header>", lambda: f"<footer>{phrase(5)}</footer>",
        lambda: f'<aside class="sidebar"><p>{phrase(12)}, {phrase(9)}.</p></aside>', lambda: f'<div class="ad-{word()}"><p>{phrase(9)}, {phrase(8)}.</p></div>', lambda: f"<div id=cookieNotice>{phrase(14)}, {phrase(3)}</div>",
        lambda: f"<form><p>{phrase(4)}</p><input><button>{phrase(1)}</button></form>", lambda: f"<script>var {word()} = '<p>{phrase(6)}</p>';</script>", lambda: f"<!-- <p>{phrase(8)}, x</p> -->", lambda: f"<style>.{word()} {{ color: red }}</style>",
        lambda: f'<section class="comments"><p>{phrase(11)}, {phrase(5)}!</p></section>',
    ]
    for _ in range(300):
        blocks, body = [], []
        for _ in range(r.randint(2, 9)):
            text = f"{phrase(r.randint(8, 30))}, {phrase(r.randint(3, 20))} & {word()}."
            blocks.append(text)
            tag = r.choice(["p", "p", "p", "h2", "blockquote"])
            words = [html.escape(w) if r.random() < 0.9 else f"<em>{html.escape(w)}</em>" for w in text.split()]
            body.append(f"<{tag}>{r.choice([' ', chr(10), '  ', chr(9)]).join(words)}</{tag}>")
            if r.random() < 0.3:
                body.append(r.choice(parts[:1] + parts[2:])())  # a header inside an article is its own
        wrap = r.choice(["<article>{}</article>", "<div class=content>{}</div>", "<main><div>{}</div></main>", "<div><div class=post-body>{}</div></div>"])
        page = "".join(p() for p in r.sample(parts, 4)) + wrap.format(chr(10).join(body)) + "".join(p() for p in r.sample(parts, 4))
        assert extract(f"<html><head><title>{phrase(3)}</title></head><body>{page}</body></html>") == "\n".join(blocks)
