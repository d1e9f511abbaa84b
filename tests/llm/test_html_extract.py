import html
import math
import re
import time

import numpy as np
import pytest

from siftlake.llm import html_extract as H
from siftlake.llm import queries


NOTHING = np.empty(0, np.int64)


def text(page):
    """A page's text by its declarations alone."""
    blocks = H.blocks_of(page)
    return H.kept_text(blocks, NOTHING, {H._slot_key(b) for b in blocks if b.weight > H.LEAST})


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<article><h1>A &amp; B</h1><p>one <b>t</b>wo<br>three&nbsp;&#33;</p></article>", "A & B one two three !"),
        ("<nav>menu</nav><header>top</header><article><header><h1>T</h1></header><p>x</p></article><footer>foot</footer>", "T x"),
        ("<article><p>x</p><div class='share-bar'>share</div><form>f<input></form><aside>side</aside><script>if(a<b){}</script><style>p{}</style><p>y</p></article>", "x y"),
        ("<article><p>x</p></article><section id=comments><article><p>reader</p></article></section>", "x"),
        ("<article>x<section class='comment-list'><p>reader</p></section></article>", "x"),
        ("<div class=ad>buy<article><p>never closed advert</p></article>", "never closed advert"),
        ("<div class='cookie notice'>c</div><main><p>x<p>y</main>", "x y"),
        ("<p>plain <a href='>'>link</a> text</p>", "plain link text"),
        ("<article><p>x</p><div class='discussion'>kept</div><div class='search results'>kept too</div></article>", "x kept kept too"),
        ("<article><p>a &lt;b&gt; c &am</p><!-- <p>no</p> --><p hidden>no</p><p style='display: none'>no</p></article>", "a <b> c &am"),
        ("no markup at  all", "no markup at all"),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<article><p>x</p><script>cut off", "x"),
        ("<body class='has-sidebar'><article class='post sidebar-left-x no'>kept?</article></body>", ""),
    ],
)
def test_blocks(page, want):
    assert text(page) == want


def test_suffix_array_and_common_prefixes():
    pick = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 60, 200):
        for high in (1, 2, 5):
            stream = np.append(pick.integers(0, high, n), -1)
            order, common = H.suffix_array(stream)
            suffixes = [stream[i:].tolist() for i in range(len(stream))]
            assert order.tolist() == sorted(range(len(stream)), key=lambda i: suffixes[i])
            for i in range(1, len(stream)):
                a, b = suffixes[order[i - 1]], suffixes[order[i]]
                same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
                assert common[i] == same


def units(blocks):
    """(first token, tokens) of every window and every shorter whole block."""
    stream = [t for b in blocks for t in b.text.split(" ")]
    out = [(i, tuple(stream[i : i + H.RUN])) for i in range(len(stream) - H.RUN + 1)]
    at = 0
    for b in blocks:
        ws = b.text.split(" ")
        out += [(at, ("short", *ws))] if len(ws) < H.RUN else []
        at += len(ws)
    return stream, out


def length(unit):
    return len(unit) - (unit[0] == "short" and len(unit) <= H.RUN)


def cover(n, chosen):
    gone = [False] * n
    for i, u in chosen:
        gone[i : i + length(u)] = [True] * length(u)
    return gone


def host(url):
    return (re.findall("://([^/?#]*)", url or "") + [""])[0].lower()


def brute(rows, names=True):
    """The text of every (id, url, html), with all hosts in one tile."""
    pages = [(host(u), H.blocks_of(h or "", names)) for _, u, h in rows]
    cut = [units(b) for _, b in pages]
    on = {}
    for p, (_, us) in enumerate(cut):
        for _, u in us:
            on.setdefault(u, set()).add(p)
    shared = [cover(len(s), [(i, u) for i, u in us if len(on[u]) > 1]) for s, us in cut]
    vote = {p for p, x in enumerate(shared) if x and x.count(False) >= H.OWN * len(x)}
    runs = {}
    for u, ps in on.items():
        for h in {pages[p][0] for p in ps}:
            n, k = sum(pages[p][0] == h for p in vote), sum(pages[p][0] == h for p in ps & vote)
            if k >= 2:
                share, z = k / n, 2.58
                low = (share + z * z / 2 / n - z * math.sqrt(share * (1 - share) / n + z * z / 4 / n / n)) / (1 + z * z / n)
                if low >= 0.5:
                    runs.setdefault(h, set()).add(u)
    slots = {(pages[p][0], b.weight, b.slot): [0, 0] for p in range(len(pages)) for b in pages[p][1]}
    for p in vote:
        gone = cover(len(cut[p][0]), [(i, u) for i, u in cut[p][1] if len(on[u] & vote) > 1])
        at = 0
        for b in pages[p][1]:
            n = len(b.text.split(" "))
            x = slots[pages[p][0], b.weight, b.slot]
            x[0] += n
            x[1] += sum(gone[at : at + n])
            at += n
    noisy = set()
    for (h, weight, slot), (n, m) in slots.items():
        every = [x for (_, *rest), x in slots.items() if rest == [weight, slot]]
        odds = lambda n, m: max(-4, min(4, math.log((m + 0.5) / (n - m + 0.5))))
        own, eights, z = odds(n, m), n / H.RUN, 2.58
        middle, reach = (m / n + z * z / 2 / eights, z * math.sqrt(m / n * (1 - m / n) / eights + z * z / 4 / eights**2)) if n else (0, 0)
        low, high = ((middle - reach) / (1 + z * z / eights), (middle + reach) / (1 + z * z / eights)) if n else (0, 1)
        certain = high < 0.5 or low > 0.5 and own > H.LEAST
        if (own if certain else odds(*map(sum, zip(*every, strict=True)))) + weight > H.LEAST:
            noisy.add((h, weight, slot))
    out = []
    for (h, blocks), (stream, us) in zip(pages, cut, strict=True):
        keep = [(h, b.weight, b.slot) not in noisy for b in blocks]
        if any(k and b.main for k, b in zip(keep, blocks, strict=True)):
            keep = [k and b.main for k, b in zip(keep, blocks, strict=True)]
        gone = cover(len(stream), [(i, u) for i, u in us if u in runs.get(h, ())])
        of = [k for k, b in zip(keep, blocks, strict=True) for _ in b.text.split(" ")]
        out.append(" ".join(t for t, k, g in zip(stream, of, gone, strict=True) if k and not g))
    return out


def words(seed, n):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, n))


def site(n, shared, own=60, tag="article", on=1.0):
    """Pages of one host; `shared` stands on the first `on` of them."""
    return [(i, "http://h/", f"<{tag}><p>{words(i + 1, own)}</p>" + (f"<p>{shared}</p>" if i < on * n else "") + f"</{tag}>") for i in range(n)]


def extracted(spark, rows, **how):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r.page_id: r.text for r in H.extract(df, **how).collect()}


@pytest.mark.parametrize("n, tile_pages", [(7, 256), (9, 256), (10, 256), (1000, 256), (1000, 100)])
def test_a_run_on_all_pages_goes_at_every_size_of_the_host(spark, n, tile_pages):
    got = extracted(spark, site(n, words(0, 40)), tile_pages=tile_pages)
    assert got == {i: words(i + 1, 60) for i in range(n)}


def test_copies_and_passages_of_some_pages_stay(spark):
    copies = [(i, "http://h/", f"<article><p>{words(1, 60)}</p></article>") for i in range(12)]
    few = [(100 + i, "http://g/", h) for i, _, h in site(12, words(0, 40), on=0.4)]
    near = [(200 + i, "http://f/", "<article><p>" + " ".join(f"e{i}" if k in (20, 41) else w for k, w in enumerate(words(2, 60).split())) + f"</p><p>{words(3, 30)}</p></article>") for i in range(5)]
    got = extracted(spark, copies + few + near)
    assert all(got[i] == text(h) for i, _, h in copies + few + near)


def test_pages_that_are_mostly_boilerplate_are_cleaned(spark):
    got = extracted(spark, site(9, words(0, 100), own=40, tag="div"))
    assert got == {i: words(i + 1, 40) for i in range(9)}


def test_a_slot_of_shared_lines_goes_without_any_declaration(spark):
    """Each line stands on few pages of a host, but all of the slot's lines are shared."""
    rows = [(i, f"http://h{i % 7}/", f"<div><p>{words(i + 1, 60)}</p><div class=x>{words(1000 + i % 5, 9)}</div></div>") for i in range(40)]
    assert extracted(spark, rows) == {i: words(i + 1, 60) for i in range(40)}


def test_a_slot_is_judged_by_its_own_host(spark):
    """Ten hosts have a banner in a slot in which an eleventh has its articles."""
    banners = [(100 * h + i, f"http://b{h}/", f"<div><p>{words(50 + h, 12)}</p></div><section><div>{words(1000 + 100 * h + i, 60)}</div></section>") for h in range(10) for i in range(10)]
    articles = [(5000 + i, "http://articles/", f"<div><p>{words(7000 + i, 30)}</p></div>") for i in range(10)]
    got = extracted(spark, banners + articles)
    assert all(got[i] == words(7000 + i - 5000, 30) for i in range(5000, 5010))
    assert all(got[100 * h + i] == words(1000 + 100 * h + i, 60) for h in range(10) for i in range(10))
    assert [got[i] for i, _, _ in banners + articles] == brute(banners + articles)


def test_declared_noise_of_unique_text_stays_inside_an_article(spark):
    rows = [(i, "http://h/", f"<nav>{words(0, 9)}</nav><article><p>{words(i + 1, 60)}</p><p class='promo'>{words(500 + i, 12)}</p><section class='comments'>{words(900 + i, 20)}</section></article>") for i in range(8)]
    assert extracted(spark, rows) == {i: f"{words(i + 1, 60)} {words(500 + i, 12)}" for i in range(8)}
    promoted = [(i, u, h.replace(words(500 + i, 12), words(300, 12))) for i, u, h in rows]
    assert extracted(spark, promoted) == {i: words(i + 1, 60) for i in range(8)}


@pytest.mark.parametrize("piece", ["<a x ", "<a x='", '<p "', "<![CDATA[ ", "<!-- ", "</", "<div>x", "<div>x</p>", "<nav><article>x", "<script>", "<b>x</b", "&amp", "<!x ", "</div >"])
def test_broken_markup_takes_linear_time(piece):
    began = time.process_time()
    H.blocks_of(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 8


def test_odd_rows(spark):
    rows = [(1, "http://h/", None), (2, None, "<p>x</p>"), (None, "", ""), (3, "http://h/", "<article>" + "<p>a b</p>" * 20_000 + "</article>"), (3, "http://h/", "<p>x</p>"), (3, "http://h/", "<p>x</p>")]
    df = spark.createDataFrame([(*r, "t", "b", 1) for r in rows], "page_id bigint, url string, html string, text string, blocks string, tile int")
    got = H.extract(df).collect()
    assert sorted((str(r.page_id), str(r.url), r.text) for r in got) == sorted((str(i), str(u), t) for (i, u, h), t in zip(rows, brute(rows), strict=True))
    assert H.extract(df.filter("false")).count() == 0


@pytest.mark.parametrize("names", [True, False])
def test_whole_query_against_brute_force(spark, names):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    want = dict(zip((r[0] for r in rows), brute(rows, names), strict=True))
    for how in ({}, {"broadcast": 0}):
        assert {r.page_id: r.text for r in H.extract(pages, names=names, **how).collect()} == want
    # with nothing declared, the runs alone find all menus, adverts and footers, and leave articles alone
    assert want == {i: article(h) for i, _, h in rows}
    if names:
        got = queries.op3_html_extract(spark, "/root/testdata/sf0.01").collect()
        assert {r.page_id: (r.text, r.n_chars) for r in got} == {i: (t, len(t)) for i, t in want.items()}


def article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())


def test_whole_table_in_small_tiles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in H.extract(pages, tile_pages=7).join(pages.select("page_id", "html"), "page_id").collect():
        assert r.text == article(r.html)
