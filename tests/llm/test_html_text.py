import html
import re
import time

import pytest

from loomgraph.llm.html_text import extract_pages, main_text, op2_html_text

SMALL = "/root/testdata/sf0.01"
P = "This paragraph is long enough to count, with commas, and it goes on for a while until it ends."

FULL = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var a="</p><p>no</p>";</script></head>
<body class="no-sidebar"><header><h1>Site name</h1><p>{P}</p></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div id="cookie-notice"><p>{P}</p></div><!-- <p>gone</p> -->
<main><article><header><h1>Title &amp; more</h1><span class=byline>By no one</span></header>
<p>First{P} &lt;tag&gt; caf&eacute;&nbsp;x<br>after break
<p>Short.
<h2>Part</h2><div class="ad">Buy, buy, buy, {P}</div><ul><li>one</li><li>two <b>bold</b></ul>
<blockquote>Quoted.</blockquote><form><p>{P}</p><input></form><table><tr><td>cell a<td>cell b</table>
<aside><p>{P}</p></aside><ul><li><a href=1>x1</a><li><a href=2>x2</a><li><a href=3>x3</a></ul><p>Last {P}</p></article>
<section class="comments"><article><p>Reader says {P}</p><p>{P}</p></article></section></main>
<div class="sidebar"><p>{P}{P}</p></div><footer><p>&copy; {P}</p></footer></body></html>"""


def test_full_page():
    assert main_text(FULL).split("\n\n") == ["Title & more", f"First{P} <tag> café x after break", "Short.", "Part", "one", "two bold", "Quoted.", "cell a", "cell b", f"Last {P}"]


def test_scored_container_and_siblings():
    page = f"<body><div id=top><a href=1>m</a> <a href=2>n</a></div><div><div class=part><h2>H</h2><p>{P}</p><p>{P}</p></div><div class=part><p>{P}</p><p>x</p></div><div><a href=1>{P}</a></div></div></body>"
    assert main_text(page).split("\n\n") == ["H", P, P, P, "x"]


def test_link_density_discounts():
    links = "".join(f"<p><a href={i}>{P}, {P}</a></p>" for i in range(9))
    assert main_text(f"<body><div>{links}</div><div><p>{P}</p><p>{P}</p></div></body>") == f"{P}\n\n{P}"


def test_broken_and_odd_markup():
    assert main_text("no markup, only text that has no tag at all") == "no markup, only text that has no tag at all"
    assert main_text("<p>a < b and c > d <") == "a < b and c > d <"
    assert main_text("<p title='x>y'>in</p><script>never closed <p>gone") == "in"
    assert main_text('<p>one<p class="unclosed>two') == "one\n\ntwo"
    assert main_text("</p></div><p>t<!-- open") == "t"
    assert main_text("<svg/><p>x</p>") in ("x", "")
    assert main_text("<p>tiny</p>") == "tiny"
    assert main_text("<div class=comment><p>only a comment page</p></div>") == "only a comment page"
    deep = "<div>" * 3000 + f"<p>{P}</p>"
    assert main_text(deep) == P
    assert [main_text(x) for x in (None, "", " ", "<br>", "<nav>n</nav>")] == [""] * 5


def test_long_page_is_whole():
    body = "".join(f"<p>{i} {P}</p>" for i in range(20_000))
    assert main_text(f"<article>{body}</article>").count("\n\n") == 19_999


def brute(page):
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", inner)))
    return "\n\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_query_against_brute_force(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = op2_html_text(spark, SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        want = brute(pages[r.page_id].html)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


def test_edges(spark):
    df = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 1), (1, "u", "<p>a</p>", 1), (1, "u", "<p>a</p>", 1)], "page_id long, url string, html string, text int")
    assert sorted((r.text, r.n_chars) for r in extract_pages(df).collect()) == [("", 0), ("", 0), ("a", 1), ("a", 1)]
    assert extract_pages(df.limit(0)).count() == 0


def bare(best, other, links):
    """A page of plain div elements: no article tag, no class and no role says which of them holds the text."""
    side = "".join(f"<p>{t}</p>" for t in other)
    menu = "".join(f'<p><a href="/{i}">{t}</a></p>' for i, t in enumerate(links))
    return f"<body><div><div>{side}</div><div>{''.join(f'<p>{t}</p>' for t in best)}</div><div>{menu}</div></div></body>"


def test_scores_decide_between_bare_containers():
    long = [f"Paragraph {i} tells its story at some length, with commas, and goes on until it is done, as a text does." for i in range(6)]
    short = ["One small remark of some words here"]
    links = [f"A link whose label is as long as a paragraph, number {i}, with commas, and more, and more of the same." for i in range(9)]
    assert main_text(bare(long, short, links)) == "\n\n".join(long)
    assert main_text(bare(short, long, links)) == "\n\n".join(long)
    # the same words as links lose to fewer words of prose
    assert main_text(bare(long[:2], [], links)) == "\n\n".join(long[:2])


SHAPES = [
    lambda k: "<div>" + "<p>short one.</p>" * k + "</div>",
    lambda k: "<div>some words, here, that are long enough to count. " * k,
    lambda k: "<div>" * k + "</i></span></p>" * k,
    lambda k: "<div>" * k + "<tr>" * k,
    lambda k: "<a>" + "<span>" * k + "<p>x</p>" * k,
    lambda k: "<span>" * k + "<p>a paragraph</p>" * k,
    lambda k: "<ul>" + "<div>" * k + "<li>x" * k,
    lambda k: '<p ">" ' * k + "'",
    lambda k: "<article><header>" + "<div>" * k + "x</header>" + "<h2>" * k,
    lambda k: "<span>" * k + "x<hr>" * k,
]


@pytest.mark.parametrize("shape", SHAPES)
def test_work_grows_with_the_page_not_with_its_square(shape):
    def took(k):
        page = shape(k)
        began = time.process_time()
        main_text(page)
        return time.process_time() - began

    took(500)
    assert took(16_000) < 20 * max(took(2_000), 0.02)


def test_long_character_numbers():
    assert main_text("<p>&#" + "9" * 5000 + "; a &#" + "0" * 5000 + "65; &#65;") == "\ufffd a A A"


def test_quotes_that_stay_open():
    assert main_text("<p t='a>b'>one<p t=\"c>two<p>three") == "one\n\ntwo\n\nthree"
