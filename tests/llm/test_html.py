import html as H
import re

from groundsearch.llm import html as X

BASE = """<!DOCTYPE html><HTML><head><title>T</title><script>if (a<b) document.write("<p>no</p>");</script></head><body>
<div id="cookie-banner">We use cookies</div><header class=site-header><h2>Site name</h2></header>
<nav><ul><li><a href=/a>Home</a><li><a href="/b">About us</a></ul></nav>
<div class="wrap"><div class="text">{body}</div><div class=sidebar><p>Popular now: many things that people read</p></div></div>
<form><label>Mail</label><input name=x><button>Go</button></form>
<div class="comments"><p>First! {n} is great, what a long comment this is, and it goes on</p></div>
<p>Read more stories every day on this fine site</p><footer>&copy; 2020 all that</footer></body></html>"""


def page(n):
    body = "".join(f"<p>Paragraph {i} of page {n} says &lt;{i * n}&gt; &amp; more,<br>and\n it is <b>long</b> <a href=x>enough</a>.<!-- no --></p>" for i in range(2 + n % 3))
    return BASE.format(body=f"<h1>Title {n}</h1>{body}", n=n)


def want(n):
    return "\n".join([f"Title {n}", *(f"Paragraph {i} of page {n} says <{i * n}> & more, and it is long enough." for i in range(2 + n % 3))])


def test_wrapper_tells_slots_from_template_words():
    pages = [X.parse(page(n)) for n in range(5)]
    w = X.infer(pages)
    shown = str(w)
    assert "'Read more stories every day on this fine site'" in shown and "p(slot)+" in shown
    for n in (7, 8, 9):
        assert X.main_text(page(n), w) == want(n)


def test_optional_and_repeated_groups():
    a = X.parse("<div><h2>a</h2><p>1</p><h2>b</h2><p>2</p></div>")
    b = X.parse("<div><h2>a</h2><p>1</p><ul><li>x<li>y</ul></div>")
    w = X.infer([a, b])
    kids = {k.sig: k for k in w.kids[0].kids}
    assert kids["h2"].plus and kids["p"].plus and kids["h2"].group == kids["p"].group != 0
    assert kids["ul"].opt and kids["ul"].kids[0].plus and not kids["h2"].opt


def test_names_of_layouts_and_states_do_not_hide_the_article():
    article = "<article class='{c}'><p>Body text of some length.</p></article><div class=sidebar><p>Popular</p></div>"
    for c in ("content has-sidebar", "right-sidebar", "layout-with-nav", "menu-open page", "td-ss-main-sidebar", "menu", "mySidebarLayout"):
        assert X.main_text(f'<body class="{c}"><div class="{c}">{article.format(c="post comments-open")}</div></body>') == "Body text of some length."
        assert X.main_text(f'<body><div class="{c}"><p>Body text of some length, with no article element.</p></div></body>') == "Body text of some length, with no article element."
    for c in ("comments", "related", "site-sidebar", "newsletter box", "cookie-notice"):
        assert X.main_text(f'<body><article><p>Body text of some length.</p><div class="{c}"><p>Other</p></div></article></body>') == "Body text of some length."


def test_quotes_in_odd_places():
    assert X.main_text("<p title=it's>One</p><p>Two</p><p>don't</p><p>Three</p>") == "One\nTwo\ndon't\nThree"
    assert X.main_text("<p a = 'x>y' b=\"it's\">One<p c='>Two</p><p>Three") == "One\nTwo\nThree"


def test_broken_tags_take_linear_time():
    import time

    for bad in ('<a "', '<a x=">', "<", "<a x='>\">", '<p ="', "<!", "<a x=1 "):
        took = []
        for n in (5000, 40000):
            began = time.perf_counter()
            X.parse(bad * n)
            X.parse(bad * n + ">")
            took.append(time.perf_counter() - began)
        assert took[1] < 30 * took[0] + 0.2, bad


def test_alignment_against_brute_force():
    """Every token of both streams stands in the pairs once, equal ones together, and pairs keep the order of both unless both have a token in
    another order; what stays optional is what a longest common subsequence leaves out, where the orders agree."""
    import random

    rng = random.Random(8)
    for _ in range(300):
        names = rng.sample("abcdefgh", rng.randint(0, 8))
        a, b = [n for n in names if rng.random() < 0.7], [n for n in names if rng.random() < 0.7]
        got = X.align([X.Wrapper(n) for n in a], [X.Wrapper(n) for n in b])
        assert [p.sig for p, _ in got if p] == a and [q.sig for _, q in got if q] == b
        assert all(p is None or q is None or p.sig == q.sig for p, q in got) and sum(p is not None and q is not None for p, q in got) == len(set(a) & set(b))
        c = rng.sample(a, len(a))
        got = X.align([X.Wrapper(n) for n in a], [X.Wrapper(n) for n in c])
        assert sorted(p.sig for p, q in got) == sorted(a) == sorted(q.sig for p, q in got)


PLAIN = """<html><body><div class=ua>{menu}</div><div class=ub><div class=uc>{promo}</div><div class=ud>{article}</div><div class=ue>{about}</div></div></body></html>"""


def test_wrappers_find_what_pages_alone_do_not(spark):
    """60 pages of three hosts without article elements or telling class names; a long promotion and an author's note are the same on all pages
    of a host. Words right of all that are given (precision) and of all that are due (recall)."""
    import random

    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows, due = [], {}
    for h in range(3):
        fixed = {"menu": "".join(f"<p><a href=/{k}>{text(2)}</a></p>" for k in range(8)), "promo": f"<p>{text(90)}</p><p>{text(60)}</p>", "about": f"<h3>{text(3)}</h3><p>{text(40)}</p>"}
        for n in range(20):
            blocks = [text(5), *(text(rng.randint(10, 40)) for _ in range(rng.randint(1, 4)))]
            rows.append((20 * h + n, f"http://h{h}.example/{n}", PLAIN.format(article=f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:]), **fixed)))
            due[20 * h + n] = "\n".join(blocks)

    def quality(texts):
        right = sum(len(set(texts[i].split()) & set(due[i].split())) for i in due)
        return right / max(1, sum(len(set(t.split())) for t in texts.values())), right / sum(len(set(t.split())) for t in due.values())

    got = {r.page_id: r.text for r in X.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert quality(got) == (1.0, 1.0) and got == due
    alone = quality({i: X.main_text(h) for i, _, h in rows})
    assert alone[0] < 0.6  # a page by itself can't tell the promotion from the article


def test_semantic_article_and_broken_markup():
    t = "<body><nav>menu</nav><article><header><h1>Head &amp line</h1><span>by me</span></header><p><b>One.<br><p>Two  three&nbsp;four</p><div class=ad>Buy</div><aside>Note</aside><ul><li>x<li>y</ul><section class=comments><article class=comment>hm</article></section></article><footer>f</footer>"
    assert X.main_text(t) == "Head & line\nOne.\nTwo three four\nx\ny"
    assert X.main_text("<p>a &lt; b &#233; &am") == "a < b é &am"
    assert X.main_text("1 < 2 <p title='a>b'>x</p> <!-- open") == "1 < 2\nx"
    for empty in (None, "", "<script>x", "<nav>a</nav>"):
        assert X.main_text(empty) == ""


def test_operator_rows(spark):
    rows = [(n, f"https://u@Host.example:80/{n}", page(n)) for n in range(12)] + [(1, "https://host.example/1", page(1)), (20, None, "<p>alone</p>"), (21, "no url", None), (22, "http://one.example", "<article>" + "<p>word word.</p>" * 9000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", X.F.lit("clash")).withColumn("host", X.F.lit(1))
    got = X.extract_pages(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) and r.host == 1 for r in got)
    by = {r.page_id: r.text for r in got}
    assert all(by[n] == want(n) for n in range(12)) and by[20] == "alone" and by[21] == "" and by[22].count("\n") == 8999
    assert X.extract_pages(df.limit(0)).count() == 0
    try:
        X.BROADCAST_BYTES, most = 0, X.BROADCAST_BYTES
        assert {(r.page_id, r.text) for r in X.extract_pages(df).collect()} == {(r.page_id, r.text) for r in got}
    finally:
        X.BROADCAST_BYTES = most


def test_parts_that_few_pages_of_a_host_have_stay(spark):
    """200 pages of a plain layout; each rare element stands in one of them."""
    rare = ["<blockquote>Quoted in {n} only</blockquote>", "<table><tr><td>Cell of {n}</td></tr></table>", "<pre>Code of {n}</pre>", "<h4>Head of {n}</h4>", '<div class="inset">Inset of {n}</div>']
    at = {n: r.format(n=n) for n, r in zip(range(40, 200, 40), rare, strict=False)} | {33: rare[4].format(n=33)}
    body = "<h1>Title {n}</h1>" + "".join(f"<p>Paragraph {i} of page {{n}}, long enough to be text.</p>" for i in range(3)) + "{rare}<p>Last words of page {n}.</p>"
    rows = [(n, f"http://plain.example/{n}", BASE.format(body=body.format(n=n, rare=at.get(n, "")), n=n)) for n in range(200)]
    got = {r.page_id: r.text for r in X.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    for n in range(200):
        lines = [f"Title {n}", *(f"Paragraph {i} of page {n}, long enough to be text." for i in range(3)), f"Last words of page {n}."]
        if n in at:
            lines.insert(4, re.sub("<[^>]*>", "", at[n]))
        assert got[n] == "\n".join(lines)


def test_copies_of_a_page_count_once(spark):
    """A host of two pages, one of which comes 40 times over all partitions: its words are no template's."""
    body = "<h1>Title {n}</h1>" + "".join(f"<p>Paragraph {i} of page {{n}}, long enough to be text.</p>" for i in range(3))
    pages = [BASE.format(body=body.format(n=1) + "<blockquote>Only in the copies, a long quotation of somebody</blockquote>", n=1), BASE.format(body=body.format(n=2), n=2)]
    rows = [(n, "http://copies.example/1", pages[0]) for n in range(40)] + [(40, "http://copies.example/2", pages[1])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    few = df.where("page_id >= 39").coalesce(1)
    want_ = {r.url: r.text for r in X.extract_pages(few).collect()}
    assert "Only in the copies, a long quotation of somebody" in want_["http://copies.example/1"]
    for n in (1, 5, 16):
        assert all(r.text == want_[r.url] for r in X.extract_pages(df.repartition(n)).collect())


def test_unknown_part_of_a_plain_layout_follows_its_region():
    w = X.infer([X.parse(page(n)) for n in range(5)])
    other = page(7).replace("</h1>", "</h1><blockquote>Said once</blockquote>").replace("<form>", "<section>Offers</section><form>")
    assert X.main_text(other, w) == want(7).replace("Title 7\n", "Title 7\nSaid once\n")


def test_query_against_the_known_template(spark, sf):
    """The pages of the tables have an <article> and nothing of others' in it: its blocks, by plain string work."""
    src = {p.page_id: p.html for p in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in X.op4_html(spark, sf).collect():
        body = src[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
