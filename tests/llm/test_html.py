import html
import re

import duckdb

from palimpsest.llm.html_extract import extract, main_text, parse, train
from palimpsest.llm.html_pages import labelled_pages

SF = "/root/testdata/sf0.001"
MODEL = train(labelled_pages(300))


def article(page):
    inner = page.split("<article>", 1)[1].split("</article>")[0].replace("<br>", " ")
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in re.split(r"</?(?:p|h1|b)>", inner)) if x)


def test_held_out_pages():
    wrong = total = 0
    for page, content in labelled_pages(150, seed=991):
        nodes, blocks = parse(page)
        p = MODEL.marginals(nodes)
        total += len(blocks)
        wrong += sum((p[n] > 0.5) != (t in content) for n, t in blocks)
    assert wrong <= 0.005 * total


def test_messages_equal_enumeration():
    """Marginals by sum-product and by summing over all labellings of a small tree."""
    import itertools
    import math

    from palimpsest.llm.html_extract import _evidence

    nodes, _ = parse("<body><nav><a href=x>ab</a></nav><article><p>some text here</p><div class=ad>buy</div></article></body>")
    p = MODEL.marginals(nodes)
    weight = [0.0] * len(nodes)
    total = 0.0
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        w = math.exp(MODEL.root * labels[0])
        for i, x in enumerate(nodes):
            w *= math.exp(labels[i] * sum(MODEL.evidence.get(e, 0.0) for e in _evidence(x)))
            if i:
                q = (MODEL.edges.get(f"{x.tag}|{x.kind}") or MODEL.edges.get(f"{x.tag}|") or MODEL.unseen)[labels[x.parent]]
                w *= q if labels[i] else 1 - q
        total += w
        for i, label in enumerate(labels):
            weight[i] += w * label
    assert all(abs(a - b / total) < 1e-9 for a, b in zip(p, weight))


def test_markup():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <NAV><ul><li><a href="/a">One</a><li><a href='/b'>Two</a></ul></NAV><!-- ad <p>no</p> -->
    <div class="ad">Buy this now.</div><article><h1>Caf&eacute; &amp; b</h1>
    <p>First&nbsp;line
    goes <b>on <i>and</b> on</i>.<br>Still it. <a href="x>y">link</a> 1 &lt; 2<p>Second, not closed. a < b
    <ul><li>item one<li>item two</ul><blockquote>Quoted text here.</blockquote><textarea>no</textarea></article>
    <aside class="sidebar"><h3>More</h3><a href=x>other</a></aside><section class="comments"><p>I think so too.</p></section>
    <footer>&copy; me</footer></body></html>"""
    assert extract(page, MODEL).split("\n") == ["Café & b", "First line goes on and on. Still it. link 1 < 2", "Second, not closed. a < b", "item one", "item two", "Quoted text here."]


def test_odd_pages(spark):
    odd = [None, "", "just text", "<", "<p", "<p>cut off in a par", "<article><p>Text of it.</p>" * 300, "<div>" * 3000 + "deep" + "</div>" * 3000, "<article><p>" + "long words " * 50_000, "</p></div>", "<script>never closed", "<article><p>İ<script>x</script> after"]
    rows = [(i, f"u{i}", h, "t") for i, h in enumerate(odd)] + [(None, None, "<article><p>No id, some text.</p></article>", "t")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = main_text(df, 200).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[0] == by[1] == by[10] == "" and by[5].endswith("par") or by[5] == ""
    assert len(by[8]) == 50_000 * 11 - 1 and by[6].count("\n") == 299 and by[None] == "No id, some text."
    assert main_text(df.limit(0), 200).collect() == []


def test_pages_of_the_table(spark):
    pages = duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall()
    got = {r["page_id"]: r["text"] for r in main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    assert got == {i: article(h) for i, h in pages}


def test_foreign_and_unclosed_elements():
    """An empty drawing, a formula or what isn't closed takes no text of the page with it."""
    def texts(page):
        return [t for _, t in parse(page)[1]]

    for odd in ("<svg/>", '<svg width="1" />', "<math/>", "<noscript>", "<template>", "<svg>", "<svg><path/></svg>", "<noscript>no</noscript>"):
        assert texts(f"<p>one {odd} two</p><p>three</p>") == ["one two", "three"]
    assert texts("<p>as <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math> here</p>") == ["as x=2 here"]
    assert texts("<p>one</p><svg/><p>two</p><svg>no</svg><p>three</p>") == ["one", "two", "three"]
    for raw in ("script", "style", "textarea", "title"):
        assert texts(f"<p>one</p><{raw}>no <p>no</p>") == ["one"]
    assert texts("<p>one" + "<svg>" * 3 + "two</p>") == ["onetwo"]


def test_deep_nesting_costs_no_more_per_tag():
    import time

    def seconds(n):
        began = time.perf_counter()
        for page in ("<div>" * n + "x", "<div><p>" * n, "<b>" * n + "<div>" + "</i>" * n, "<ul><li>" * n + "<li>" * n, "<p>" + "<h1>" * n + "</h2>" * n):
            parse(page)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.02)  # 100 times where a tag costs its depth


#: Pages of frames that the training pages don't have: what is content, then the page with it marked by braces.
FOREIGN = [
    """<body class="home single"><div id="masthead-wrap"><div class="logo">Daily</div><ul class="menu-primary"><li><a href=1>News</a></li><li><a href=2>Sport</a></li></ul></div>
    <section id="main-content" role="main"><div class="entry-header"><h1>{The river rises}</h1></div><div class="entry-content"><p>{Water came over the bank in the night, and the lower street was closed.}</p>
    <div class="share-buttons"><a href=3>Share</a></div><p>{By noon it had gone back.}</p></div></section><div class="widget-area"><h3>Most read</h3><ul><li><a href=4>Elsewhere</a></li></ul></div>
    <div id="colophon"><p>All rights reserved.</p></div></body>""",
    """<body><table><tr><td class="leftnav"><a href=1>Home</a><br><a href=2>Links</a></td><td id="content"><h2>{Notes on bees}</h2><p>{Bees fly far on warm days, and farther where flowers are few.}
    <p>{They come back by the sun.}<ul><li>{workers}<li>{drones}</ul></td></tr></table><p class="footer">Page made in 1999</p></body>""",
    """<body><div class="cookie-banner"><p>We use cookies.</p><button>Yes</button></div><main><div class="post"><div class="post-title"><h1>{A cake}</h1></div><div class="post-body"><p>{Stir the flour into the milk and let it stand for an hour.}</p>
    <figure><img src=x><figcaption>{The cake, cut.}</figcaption></figure><pre>{200 g flour}</pre></div></div><div class="related-posts"><h4>You may like</h4><a href=1>Bread</a> <a href=2>Pies</a></div>
    <div id="disqus_thread"><div class="reply"><p>Mine burnt, why?</p></div></div></main><footer><a href=3>About</a></footer></body>""",
    """<body><header role=banner><a href=/>Site</a></header><div role="navigation"><a href=1>One</a> <a href=2>Two</a></div><div class="article-wrapper"><div class="article-text"><p>{The council met on Monday to talk about the bridge, which has been shut since May.}</p>
    <aside class="promo-box"><p>Subscribe and save!</p></aside><blockquote>{It will cost more than we thought.}</blockquote><p>{A vote is due in June.}</p></div></div><form action=x><label>Your mail</label><input><button>Go</button></form></body>""",
]


def test_foreign_frames():
    """Precision and recall by characters on frames that no training page has."""
    found = right = wanted = 0
    for page in FOREIGN:
        content = {" ".join(t.split()) for t in re.findall(r"\{([^}]*)\}", page)}
        got = extract(page.replace("{", "").replace("}", ""), MODEL).split("\n")
        found += sum(map(len, got))
        right += sum(len(t) for t in got if t in content)
        wanted += sum(map(len, content))
    print(f"precision {right / found:.3f}, recall {right / wanted:.3f}")
    assert right >= 0.9 * found and right >= 0.9 * wanted
