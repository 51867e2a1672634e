"""Names of furniture inside running text, and which of counts and markup decides."""

import pytest
from framewise.llm import html
from pyspark.sql import functions as F

LONG = "long words here " * 30


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><p>x y</p><section class='related-work'><h2>Related work</h2><p>{LONG}</p></section></article>", f"x y\n\nRelated work\n\n{LONG.strip()}"),
        (f"<article><section class='related'><p>{LONG}</p></section></article>", LONG.strip()),
        ("<article><div class='post-share'><p>Main words here</p></div><p>b</p></article>", "Main words here\n\nb"),
        ("<article><h2 id='legal-notice'>Legal notice</h2><p>one</p></article>", "Legal notice\n\none"),
        ("<article><section class='search-results'><p>two</p></section><p>one</p></article>", "two\n\none"),
        ("<article><header><h1>Title</h1></header><p>one</p></article>", "Title\n\none"),
        ("<header><h1>Site</h1></header><article><p>one</p></article><footer>foot</footer>", "one"),
        ("<article><p>body</p><div class='share'><a href='#'>Tweet</a></div><div id='comments'><p>me too</p></div></article>", "body"),
        (f"<article><p>body</p></article><div class='comment-list'><p>{LONG}</p></div>", "body"),
        ("<main><section class='related-work'><p>one</p></section><div class='sidebar'>side</div></main>", "one"),
    ],
)
def test_names_do_not_cut_running_text(page, text):
    assert html.main_text(page, set()) == text


def test_counts_decide_where_there_are_any(spark):
    """Pages without any telling name: what recurs on the host goes, the rest stays, inside an article or not."""
    row = lambda k, tag: (k, f"http://h.x/{k}", f"<body><div class='q1'><a href='/{k % 3}'>Home</a> <a href='/b'>All</a></div><{tag}><p>Own text {k} of this page</p></{tag}><p>Also own {k}</p><div class='q9'>Same foot line</div></body>")
    pages = spark.createDataFrame([row(k, "article" if k % 2 else "div") for k in range(40)], "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(pages.withColumn("other", F.lit(1)), keep=["page_id"]).collect()}
    assert got == {k: f"Own text {k} of this page\n\nAlso own {k}" for k in range(40)}
    few = spark.createDataFrame([row(1, "article")], "page_id int, url string, html string")
    assert html.extract(few).first()["text"] == "Own text 1 of this page"  # one page of a host: the article bounds the text


def brute_templates(pages, least_pages=5, most_pages=1000, share=0.1, inside_share=0.3, few=150):
    """Counts of subtree hashes by host and the rules of `templates`, in plain loops."""
    hosts = {}
    for url, page in pages:
        host = url.split("/")[2]
        found, chars = html.subtrees(page)
        h = hosts.setdefault(host, [0, 0, {}])
        h[0], h[1] = h[0] + 1, h[1] + chars
        for x in found:
            s = h[2].setdefault((x["h"], x["kind"]), dict(n=0, c=0, links=0, times=0, bare=False))
            for k, v in (("n", 1), ("c", x["chars"]), ("links", x["links"]), ("times", x["times"])):
                s[k] += v
            s["bare"] |= x["bare"]
    out = {}
    for host, (n_pages, total, sums) in hosts.items():
        for (h, kind), s in sums.items():
            need = lambda part: s["n"] >= max(least_pages, min(part * n_pages, most_pages))
            once = s["times"] <= 1.5 * s["n"]
            short = not s["bare"] and once and s["c"] <= few * s["n"] and s["c"] <= 0.1 * total
            is_ = need(share) if kind == html.CONTENT else need(inside_share) if kind == html.INNER_CONTENT else need(inside_share) and (s["links"] >= 0.5 * s["c"] or short) if kind == html.SHAPE else need(0.5) and s["links"] >= 0.8 * s["c"] and once
            if is_:
                out.setdefault(host, set()).add(h)
    return out


def test_templates_against_plain_counts(spark):
    import random

    rng = random.Random(3)
    pages = []
    for k in range(120):
        host = f"h{k % 3}.org"
        menu = "".join(f"<li><a href='/{rng.randrange(9)}'>Link {rng.randrange(4)}</a></li>" for _ in range(rng.randint(2, 5)))
        ad = f"<div class='x{rng.randrange(2)}'>Buy now {rng.randrange(3)}</div>" if rng.random() < 0.5 else ""
        pages.append((f"http://{host}/{k}", f"<body><ul class='m'>{menu}</ul>{ad}<article><p>{' '.join(rng.choice('abcdefgh') * 3 for _ in range(40))}</p><div class='t'><a href='#'>tag {k % 4}</a></div></article><div id='f{k}'>Foot of {host}</div></body>"))
    df = spark.createDataFrame(pages, "url string, html string").repartition(4)
    got = {r["host"]: set(r["template"]) for r in html.templates(df).collect()}
    assert got == brute_templates(pages) and sum(map(len, got.values())) > 10
