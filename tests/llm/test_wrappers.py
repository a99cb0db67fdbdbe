import random

import pytest

from leafline.llm import wrappers

PAGE = """<!DOCTYPE html><html><head><title>T{n}</title><style>p{{x}}</style><script>var a="</p>";</script></head><body>
<div id="cookie-notice">We use cookies</div><header><h1>Site name</h1></header>
<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News {n}</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy now {n}</div><{tag}><h1>Title &amp; more {n}</h1><p>First <b>bold</b> para&#103;raph
 &lt;{n}&gt; with many words in it<br>and a second line<p>Second&nbsp;one {n} is here<div class="share-box">Share!</div>
<ul><li>Point {n}</li></ul></{tag}><aside>Side {n}</aside><form>Name <input name=x><button>Go</button></form>
<section class="comments"><p>Reader {n} says hi</p></section><footer>&copy; site {n}</footer></body>"""


def wanted(n):
    return f"Title & more {n} First bold paragraph <{n}> with many words in it and a second line Second one {n} is here Point {n}"


@pytest.mark.parametrize("tag", ["article", "main", 'div class="post"'])
@pytest.mark.parametrize("broadcast_bytes", [1 << 24, 0])
def test_main_text(spark, tag, broadcast_bytes):
    rows = [(n, f"https://h{n % 2}.example.com/p/{n}", PAGE.format(n=n, tag=tag).replace(f"</{tag}>", f"</{tag.split()[0]}>"), "x") for n in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper string").repartition(3)
    found = {r["page_id"]: r for r in wrappers.main_text(pages, broadcast_bytes=broadcast_bytes).collect()}
    for n in range(20):
        assert found[n]["text"] == wanted(n)
        assert found[n]["n_chars"] == len(wanted(n))


def test_page_without_named_article(spark):
    body = "<html><body><div class=top><a href=x>Menu</a> <a href=y>More</a></div><div class=c1x><h2>Head {n}</h2><p>Long running text of page {n} that differs each time</p></div><div class=bottom>All rights reserved</div></body></html>"
    pages = spark.createDataFrame([(n, "http://one.example/", body.format(n=n)) for n in range(6)], "page_id long, url string, html string")
    for r in wrappers.main_text(pages).collect():
        assert r["text"] == f"Head {r['page_id']} Long running text of page {r['page_id']} that differs each time"


@pytest.mark.parametrize("broadcast_bytes", [1 << 24, 0])
def test_host_of_several_templates(spark, broadcast_bytes):
    frame = "<html><body><nav><a href=/>Home</a></nav>{}<div class=foot>All rights reserved</div></body></html>"
    bodies = ["<article><p>{}</p></article>", "<main><p>{}</p></main>", "<div class=content><p>{}</p></div>", "<div class=page><p>{}</p></div>", "<article><img src=x></article><div class=page><p>{}</p></div>"]
    shares = [12, 4, 3, 3, 3]
    words = [f"Text {n} of a page that says {'much ' * 20}in template {k}" for k, share in enumerate(shares) for n in range(share)]
    kinds = [k for k, share in enumerate(shares) for _ in range(share)]
    for host in ("http://mixed.example/", "no host"):
        rows = [(i, host, frame.format(bodies[k].format(words[i]))) for i, k in enumerate(kinds)]
        found = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_bytes=broadcast_bytes)
        assert {r["page_id"]: r["text"] for r in found.collect()} == dict(enumerate(words))


def test_deep_pages(spark):
    def nest(n, inner, tag="div"):
        return f"<{tag}>" * n + inner + f"</{tag}>" * n

    notes = "<nav>Menu</nav><div class=ad>Buy <div>now</div></div><ul class=share><li>Share<li>it</ul>"
    bodies = [
        "<div><article>" + nest(100, f"<p>core</p>{notes}") + "<div><p>tail</p></div></article></div><footer>end</footer>",
        "<article>" + nest(40, nest(30, f"cell {notes}", "section") + "<p>core</p>") + "<p>tail</p></article>",
        nest(80, f"<article><header>core</header>{nest(9, notes)}<p>tail</p></article><p>outside</p>{notes}"),
        "<article>" + "<table><tr><td>" * 30 + "core" + "</table>" * 30 + "<p>tail</p></article><aside>no</aside>",
        "<article>" + "<div>" * 90 + "core<p>tail</article><div class=ad>no</div>",
        "<article><p>core</p><svg width=1 />tail</article>",
        "<article><p>core</p><SVG a='/>'><text>no</text></SVG><p>tail</p></article><svg viewBox=\"0\"/><footer>no</footer>",
    ]
    rows = [(i, f"http://h{i}.example", body) for i, body in enumerate(bodies)]
    found = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: "cell core tail" if i == 1 else "core tail" for i in range(len(bodies))}


def test_many_closing_tags_without_an_open_one():
    page = "<article>" + "<div>" * 50_000 + "</section>" * 50_000 + "core</article>"
    assert wrappers.wrapper_of(wrappers.parse(page))[0] == ""


def test_odd_pages(spark):
    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    deep = "<article>" + "<div>" * 5000 + "core" + "</div>" * 5000 + "</article>"
    rows = [(1, None, None), (2, None, ""), (3, "not a url", "<<<>>> < a & b"), (4, "http://x.example", long), (4, "http://x.example", long), (None, "http://y.example", deep), (6, "http://z.example", "<article><p>cut off <b>here &am")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = [(r["page_id"], r["text"]) for r in wrappers.main_text(pages).collect()]
    assert found.count((4, " ".join(["word"] * 20_000))) == 2
    assert (1, "") in found and (2, "") in found and (None, "core") in found and (6, "cut off here &am") in found
    assert wrappers.main_text(pages.limit(0)).count() == 0


def tree(*children):
    return ["x", 0, None, [[k, 0, [1, 1, 0, 1], []] for k in children]]


NEUTRAL = """<html><head><title>T{n}</title></head><body><div class=xa><div class=k><b>Brand</b> of all things</div><ul class=q><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul></div>
<div class=xb><div class=m><h1>Story {n} of the day</h1><p>Text {n} begins {words}</p>{more}<p>and ends {n}</p><div class=r>Written by our staff</div></div><div class=s>Read on in our other pages</div></div><div class=xc>All rights reserved since long ago</div></body></html>"""


def neutral(n):
    words = " ".join(f"w{n}x{i}" for i in range(20 + n))
    more = "<p>More of {0}</p>".format(n) * (n % 3)
    blocks = [f"Story {n} of the day", f"Text {n} begins {words}", *[f"More of {n}"] * (n % 3), f"and ends {n}"]
    return NEUTRAL.format(n=n, words=words, more=more), " ".join(blocks)


def through_wrapper(pages):
    """The main text of each page by the wrapper of all of them, nothing but the alignment's functions."""
    parsed = [wrappers.parse(page) for page in pages]
    host = None
    for page in parsed:
        own = wrappers.wrapper_of(page)
        if host is None:
            host = own
        else:
            wrappers.merge(host, own)
    rule = wrappers.decide(host)
    return [" ".join(wrappers.main_blocks(page, rule, lambda: host)) for page in parsed]


@pytest.mark.parametrize("named", [True, False])
def test_neutral_names_are_told_apart_by_what_differs(monkeypatch, named):
    """Titles, menus, by-lines and footers that are alike on all pages go although they lie beside and within the text, whatever the names."""
    if not named:
        for name in ("DROPPED_TAGS", "DROPPED_NAMES", "DROPPED_ROLES", "MAIN_NAMES"):
            monkeypatch.setattr(wrappers, name, frozenset())
        monkeypatch.setattr(wrappers, "is_main", lambda key: 0)
    pages, texts = zip(*map(neutral, range(9)), strict=True)
    assert through_wrapper(pages) == list(texts)


def test_named_hosts_without_their_names(monkeypatch):
    """The host of ``test_main_text`` by alignment alone: only what differs within the text's element and is no word list's matter is left."""
    for name in ("DROPPED_TAGS", "DROPPED_NAMES", "DROPPED_ROLES", "MAIN_NAMES"):
        monkeypatch.setattr(wrappers, name, frozenset())
    monkeypatch.setattr(wrappers, "is_main", lambda key: 0)
    found = through_wrapper([PAGE.format(n=n, tag="article") for n in range(9)])
    assert found == [wanted(n) for n in range(9)]


def test_a_decoy_named_like_an_article_loses_to_what_differs():
    pages = [f"<body><div class=post>Try our app today, it is free</div><div class=z><p>{' '.join(f'v{n}y{i}' for i in range(30))}</p></div></body>" for n in range(6)]
    assert through_wrapper(pages) == [" ".join(f"v{n}y{i}" for i in range(30)) for n in range(6)]


def plain_alignment(left, right):
    """The length of the longest common subsequence, by its table."""
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(len(left) - 1, -1, -1):
        for j in range(len(right) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if left[i] == right[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_alignment_against_the_table():
    rng = random.Random(2)
    good = whole = 0
    for _ in range(300):
        left = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 12))]
        right = list(left)
        for _ in range(rng.randint(0, 5)):
            if right and rng.random() < 0.5:
                right.pop(rng.randrange(len(right)))
            else:
                right.insert(rng.randint(0, len(right)), rng.choice("abcdefghijkl"))
        found = wrappers.aligned(left, right)
        assert all(left[x] == right[y] for x, y in found)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(found, found[1:], strict=False))
        good, whole = good + len(found), whole + plain_alignment(left, right)
    assert good >= 0.97 * whole


def test_very_long_lists_align_in_time():
    left = [f"k{i}" for i in range(60_000)]
    right = [f"k{i}" for i in range(60_000) if i % 7] + ["p", "q"] * 20_000
    assert len(wrappers.aligned(left, right)) == sum(1 for i in range(60_000) if i % 7)
    assert len(wrappers.aligned(["p", "q"] * 40_000, ["q", "p", "p"] * 30_000)) > 0


def test_alignment_generalises():
    a = tree("h", "p")
    wrappers.merge(a, tree("h", "q", "p"))
    assert [(c[0], c[1]) for c in a[3]] == [("h", 0), ("q", 1), ("p", 0)]
    assert [(c[0], c[1]) for c in wrappers.fold(tree("p", "p", "p")[3])] == [("p", 2)]
    assert [(c[0], c[1]) for c in wrappers.fold(tree("a", "b", "a", "b", "c")[3])] == [("a", 2), ("b", 2), ("c", 0)]
    many = tree(*[f"k{i}" for i in range(40)])
    wrappers.merge(many, tree("k3", "k1"))
    assert len(many[3]) == 40


def test_text_that_differs_becomes_a_slot():
    a, b = (wrappers.wrapper_of(wrappers.parse(f"<p>same</p><h1>n {n}</h1>")) for n in (1, 2))
    wrappers.merge(a, b)
    assert a[3][0][2][3] != -1 and a[3][1][2][3] == -1


def texts_of(spark, bodies, host="one.example"):
    pages = spark.createDataFrame([(i, f"http://{host}/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)], "page_id long, url string, html string")
    return [r["text"] for r in sorted(wrappers.main_text(pages).collect(), key=lambda r: r["page_id"])]


def test_a_template_with_a_small_article_keeps_its_own_text(spark):
    long = "A paragraph of page {0} that goes on and on, with many words that no other page has, {0} of them. " * 4
    bodies = [f"<nav><a href=/>Home</a></nav><article><h1>Title {i}</h1><p>{long.format(i)}</p></article>" for i in range(5)]
    bodies += [f"<nav><a href=/>Home</a></nav><div class=content><p>{long.format(i)}</p></div><article class=teaser>Teaser {i}</article>" for i in (5, 6)]
    found = texts_of(spark, bodies)
    assert found[:5] == [f"Title {i} {long.format(i).strip()}" for i in range(5)]
    assert all(long.format(i).strip() in found[i] for i in (5, 6))


def test_articles_alike_on_several_pages_stay(spark):
    same = "The same notice of terms on every page, a whole paragraph of it and then some more words."
    found = texts_of(spark, [f"<nav><a href=/>Home</a></nav><h1>Title {i}</h1><article><p>{same}</p></article><footer>All rights</footer>" for i in range(3)])
    assert all(x.endswith(same) for x in found)
    lead = "A lead sentence alike on three pages."
    found = texts_of(spark, [f"<article><h2>{lead}</h2><p>What differs on page {i} of the host, and much more of it.</p></article>" for i in range(3)])
    assert found == [f"{lead} What differs on page {i} of the host, and much more of it." for i in range(3)]


def test_sequences_of_any_length_are_one_group():
    names = "abcdefghijk"
    page = lambda n: wrappers.wrapper_of(wrappers.parse("<body>" + "".join(f"<div class={c}>x</div>" for c in names) * n + "</body>"))
    count = lambda node: 1 + sum(map(count, node[3]))
    assert count(page(2)) == count(page(5)) < count(page(1)) + 3
