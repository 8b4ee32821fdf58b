import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starloom.llm import html_text

LONG = "A sentence of the story that goes on for a while, with more than a few words. "


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("  \n ", ""), ("just text &amp; more", "just text & more"), ("<p>a<p>b", "a b"), ("x < y", "x < y"),
    ("<script>var a='</p>x';</script><style>p{}</style><!-- c --><p>k</p>", "k"),
    ("<html><head><title>T</title></head><body><header>Site</header><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies</div>"
     "<main><h1>Title</h1><p>A <b>b</b>c&nbsp;d\n &lt;x&gt; <a href='u'>link</a>.</p><aside>side</aside><form>f<input></form>"
     "<section id='comments'><p>nice</p></section></main><footer>f</footer>", "Title A bc d <x> link."),
    ("<article><header><h1>Head</h1></header>p1<div class='ad'>buy</div>p2</article><div class=comments>c</div>", "Head p1 p2"),
    ("<div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div><p>" + LONG * 3 + "<p>Short.</div><div id=sidebar>" + "xx " * 50 + "</div>",
     (LONG * 3).strip() + " Short."),
    ("<div class='menu'>" + "m " * 99 + "</div><p>" + LONG * 2 + "</p><div style='display: none'>" + LONG * 3 + "</div>", (LONG * 2).strip()),
    ("<article><p>a &#233; &eacute; &amp;lt; &am</p><p>short</p></article>", "a é é &lt; &am short"),
    ("<article><p>one<br>two</p><ul><li>x</li><li>y</li></ul><table><tr><td>1</td><td>2</td></tr></table></article>", "one two x y 1 2"),
    ("<article>open <div class=\"ad\">no</div> rest", "open rest"), ("<p hidden>no</p><p>yes</p>", "yes"),
])
def test_pages(html, text):
    assert html_text.main_text(html) == text


def test_windows_split_distant_text():
    far = "<div><p>" + LONG * 4 + "</p></div>" + "<nav>m</nav>" + "<div><p>tiny</p></div>"
    assert html_text.main_text(far) == (LONG * 4).strip()


STORY = (LONG * 3).strip()


@pytest.mark.parametrize("html, text", [
    # a marked leaf stays furniture to its end, over line breaks and nested blocks
    ("<article><p class='ad'>BUY<br>NOW CHEAP</p><p>text</p></article>", "text"), ("<article><p hidden>SECRET<br>MORE</p><p>text</article>", "text"),
    ("<article><ul><li class='share'>Share<p>on</p>here</li><li>kept</li></ul></article>", "kept"), ("<article><p class=ad>a<br>b<p>c</article>", "c"),
    ("<article><p class=ad>a<div>b</div></article>", "b"), ("<article><ul><li class=share>x<ul><li>y</li></ul>z<li>k</ul></article>", "k"),
    # comments that are articles of their own
    ("<article><p>text</p><article class='comment'><p>nice read</p></article></article>", "text"),
    ("<article class='post'><p>text</p></article><article class='comment'><p>" + LONG * 9 + "</p></article>", "text"),
    # headings and headers inside the article
    ("<article><h2 class='header'>Heading</h2><p>text</p></article>", "Heading text"),
    ("<article><div class='header'><h1>Title</h1></div><p>text</p></article>", "Title text"), ("<article><h2 class='ad'>Buy</h2>text</article>", "text"),
    ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><svg><text>label</text></svg></article>", "so x=1 label"),
    # without an article: what only furniture separates stays
    ("<body><h1>Headline</h1><div class='ad'>buy</div><p>" + STORY + "</p></body>", "Headline " + STORY),
    ("<body><p>" + STORY + "</p><div class='ad'>buy</div><p>The end.</p></body>", STORY + " The end."),
    ("<body><p>" + STORY + "</p><aside>x</aside><p>Short.</p><aside>y</aside><p>" + STORY + "</p></body>", STORY + " Short. " + STORY),
    ("<body><p>" + STORY + "</p><p><a href=1>More</a> <a href=2>links</a></p></body>", STORY),
])
def test_contract_traps(html, text):
    assert html_text.main_text(html) == text


INSIDE = ["<p>{}</p>", "<h2 class='header'>{}</h2>", "<div>{}</div>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li></ul>", "<p>{}", "<div class='lead'><p>{}</p></div>",
          "<figure><figcaption>{}</figcaption></figure>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<section>{}</section>"]
OUTSIDE = ["<div class='ad'>{}</div>", "<aside><p>{}</p></aside>", "<p class='share'>{}<br>{}</p>", "<nav><ul><li>{}</li></ul></nav>", "<form>{}<input></form>", "<div hidden><p>{}</p></div>",
           "<script>{}</script>", "<style>{}</style>", "<!-- {} -->", "<div class='cookie-notice'>{}</div>", "<section id='comments'><p>{}</p></section>",
           "<article class='comment'>{}</article>", "<div style='display:none'>{}</div>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 99), st.integers(1, 12)), min_size=1, max_size=25), st.sampled_from(["article", "main"]))
def test_generated_pages(parts, tag):
    """Pages made of known parts: exactly the article's blocks come back, in order."""
    html, expected = [], []
    for i, (inside, shape, size) in enumerate(parts):
        words = " ".join(f"w{i}x{j}" for j in range(size))
        shapes = INSIDE if inside else OUTSIDE
        html.append(shapes[shape % len(shapes)].replace("{}", words))
        if inside:
            expected.append(words)
    page = f"<html><head><title>T</title></head><body><header>Site</header><nav>m</nav><{tag}>{''.join(html)}</{tag}><footer>f</footer></body></html>"
    assert html_text.main_text(page) == " ".join(expected)


def test_long_page_is_read_whole():
    body = "".join(f"<p>paragraph {i} of the story</p>" for i in range(20_000))
    out = html_text.main_text(f"<body><article>{body}</article></body>")
    assert out.endswith("paragraph 19999 of the story") and out.count("paragraph") == 20_000


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "k"), (1, "u", "<p>a</p>", "k"), (2, None, None, None)], "page_id long, url string, html string, text string")
    out = html_text.extract(df)
    assert out.columns == ["page_id", "url", "text"] and sorted((r.page_id, r.text) for r in out.collect()) == [(1, "a"), (1, "a"), (2, "")]
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("html", [
    "<div class='content-sidebar-wrap'><main><p>" + LONG * 3 + "</p></main></div>",
    "<body><form id='aspnetForm' style='margin: 0'><article><p>" + LONG * 3 + "</p></article></form></body>",
    "<body><form id='aspnetForm'><nav>m</nav><div><p>" + LONG * 3 + "</p></div></form></body>",
    "<div class='post hentry tag-news'><p>" + LONG * 3 + "</p></div><div class='comments-area'><p>" + LONG * 20 + "</p></div>",
    "<div class='sidebar'><article><p>" + LONG * 3 + "</p></article></div><div class='sidebar'>" + LONG + "</div>",
])
def test_containers_of_the_article_are_no_furniture(html):
    assert html_text.main_text(html) == (LONG * 3).strip()


def test_entry_header_keeps_its_title():
    assert html_text.main_text("<article><header class='entry-header'><h1>Title</h1></header><p>text</p></article>") == "Title text"
