import html as html_lib
import math
import re

import pyarrow.parquet as pq

from kestrel.llm.html_extract import extract, main_text

PAGE = (
    "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav>"
    "<!-- c --><div class='ad'>Buy now at once, dear reader of this page</div><article><h1>Head &amp; tail</h1><p><b>One\n  two<br>three<p>Four &#8212; five</p>"
    "<aside>side</aside><form><p>form</p></form></article><section id='comments'><p>I disagree</p></section><footer>&copy; x</footer>"
)


def test_article_only():
    assert main_text(PAGE)[0] == "Head & tail\nOne two three\nFour — five"


def test_without_an_article():
    body = "Long paragraph of real text, with many words in it. " * 4
    page = f"<div id=sidebar>a b</div><div><p>{body}</p><p>{body}</p></div><div class='cookie-notice'>We use cookies on this page, dear reader</div>"
    assert main_text(page)[0] == f"{body.strip()}\n{body.strip()}"


def test_edges(spark):
    assert main_text(None)[0] == main_text("")[0] == main_text("<p></p>")[0] == ""
    assert main_text("<article><p>unclosed <b>bold")[0] == "unclosed bold"
    assert main_text("plain")[0] == "plain"
    assert main_text("<article>" + "<p>x y</p>" * 5000)[0].count("\n") == 4999
    pages = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, "old"), (1, "u", PAGE, "old")], "page_id long, url string, html string, text string")
    rows = extract(pages).collect()
    assert sorted(r.n_chars for r in rows) == [0, len(main_text(PAGE)[0])] + [len(main_text(PAGE)[0])] and all("html" in r.asDict() for r in rows)
    assert extract(pages.limit(0)).count() == 0


def test_hints_are_evidence_and_no_veto():
    assert main_text("<article class='post share'><p>Hello there</p></article>")[0] == "Hello there"
    assert main_text("<div class='search page'><article><p>Hello there</p><div class=share><p>Share this</p></div></article></div>")[0] == "Hello there"
    body = "Long paragraph of real text, with many words in it. " * 4
    assert main_text(f"<div id='widget-area'><p>{body}</p><p>{body}</p></div><div><a href=x>a</a> <a href=y>b</a></div>")[0] == f"{body.strip()}\n{body.strip()}"
    noise = "I do not agree with this at all, dear author. " * 30
    assert main_text(f"<article><p>Short but whole.</p></article><section class=comments><p>{noise}</p></section>")[0] == "Short but whole."
    # A teaser card is no article of the page.
    assert main_text(f"<div><p>{body}</p><p>{body}</p></div><article><a href=x>Read on</a></article>")[0].startswith(f"{body.strip()}\n{body.strip()}")


def plain(html, radius=2, sigma=1.0):
    """Line by line: smoothing, threshold and choice of the lines that the parser gives, written out."""
    from kestrel.llm import html_extract as H

    parser = H.Lines()
    parser.feed(html or "")
    parser.close()
    rows = [(" ".join("".join(x[0]).split()), *x[1:]) for x in parser.lines]
    text_in = lambda pick: sum(len(r[0]) for r in rows if not r[2] and pick(r))
    dropped = []
    for r in rows:
        gone = r[2]
        for h in r[3]:
            inside = text_in(lambda q, h=h: h in q[3])
            if not (h in parser.holds_article or (inside * 2 > text_in(lambda q: True) and not parser.articles and not parser.hinted[h])):
                gone = True
        dropped.append(gone)
    own = [0.0 if g else math.log(1 + len(r[0]) / max(1, r[1])) for r, g in zip(rows, dropped)]
    left = sum(len(r[0]) for r, g in zip(rows, dropped) if not g)
    article = sum(len(r[0]) for r, g in zip(rows, dropped) if not g and r[4])
    if article and article >= left / 3:
        own = [max(own) if r[4] else 0.01 * o for r, o in zip(rows, own)]
    smoothed = []
    for k in range(len(own)):
        weights = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
        values = [own[min(max(k + d, 0), len(own) - 1)] for d in range(-radius, radius + 1)]
        smoothed.append(sum(w * v for w, v in zip(weights, values)) / sum(weights))
    cut = (sum(smoothed)) / (len(smoothed) + 1)
    while True:
        low, high = [v for v in [*smoothed, 0.0] if v < cut], [v for v in [*smoothed, 0.0] if v >= cut]
        new = (sum(high) / len(high) + (sum(low) / len(low) if low else 0.0)) / 2
        if abs(new - cut) < 1e-12:
            break
        cut = new
    return "\n".join(r[0] for r, g, o, v in zip(rows, dropped, own, smoothed) if r[0] and not g and v >= cut and v > 0 and o >= cut / 8)


def test_all_pages_against_the_slow_form_and_their_articles():
    folder = "/root/testdata/sf0.001/pages.parquet"
    pages = pq.read_table(folder, columns=["html"]).column(0).to_pylist()
    assert len(pages) > 20
    for page in [*pages, PAGE]:
        got = main_text(page)[0]
        assert got == plain(page)
        inner = re.search(r"(?s)<article>(.*)</article>", page)
        if inner and page is not PAGE:  # these pages hold their text in one article of headings and paragraphs
            blocks = [html_lib.unescape(re.sub(r"<br>", " ", b)) for b in re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", inner[1]))]
            assert got == "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def test_very_long_pages():
    page = "<html><body><nav><a href=x>m</a></nav><article>" + "<p>word and more words here</p>" * 40_000 + "</article></body></html>"
    assert main_text(page)[0].count("\n") == 39_999
    assert len(main_text("<article><p>" + "x " * 2_000_000)[0]) == 3_999_999
    assert main_text("<div>" * 3000 + "deep text that is long enough to count" + "</div>" * 3000)[0] == "deep text that is long enough to count"
