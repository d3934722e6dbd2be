"""HTML extraction, minimum cuts, edit matching and the pipeline."""

import html
import itertools
import random
import re
import time
from collections import defaultdict

import pytest

import corpus_pipeline
from spanloom.llm import decontaminate as D
from spanloom.llm import html_extract as H
from spanloom.llm.queries import oracle_sql, queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>x";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div id="cookie-notice">We use cookies.</div>
<div class="ad">Buy this now, it is a good thing to buy.</div><main><article><h1>Title &amp; more</h1><p><b>First <em>para</em>graph&nbsp;here,
quite long.<br>Next line</b><p>Second &lt;b&gt;.</p><ul><li>one<li>two</ul><form><p>Sign up</p></form><!-- <p>no</p> --></article>
<section class="comments"><div class="comment"><p>Great article, I liked it a lot, thanks to the author.</p></div></section></main>
<aside><p>Popular posts of this week</p></aside><footer>&copy; 2024 Site</footer></body></html>"""


def test_article_text():
    assert H.main_text(PAGE) == "Title & more First paragraph here, quite long. Next line Second <b>. one two"


@pytest.mark.parametrize("page", [None, "", "plain", "<p", "<p class='x", "<<<>>>", "</div></p>", "<!-- open", "<script>never closed", "<a href=\"" * 50, "&#0;&#x110000;&bogus;&amp", "<p>" * 3000 + "x"])
def test_broken_pages_are_read(page):
    assert isinstance(H.main_text(page), str)


WRAPPERS = (
    '<div class="layout has-sidebar">{}</div>', '<div class="no-sidebar"><main>{}</main></div>', '<form id="aspnetForm"><div class="article">{}</div></form>', '<div id="page-with-comments">{}</div>',
    '<div class="page-wrapper banner-on">{}</div>', '<section class="main-content legal-news">{}</section>',
)


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_keep_their_article(wrapper):
    article = "<article><h1>Title of it</h1><p>First paragraph of a text that is here.</p><p>Short one</p></article>"
    for nav in ("", "<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>"):
        for after in ("", "<section class=comments><article><p>A reader says that this is a good article.</p></article></section>"):
            page = f"<body>{nav}{wrapper.format(article + after)}<footer>x y. z</footer></body>"
            assert H.main_text(page) == "Title of it First paragraph of a text that is here. Short one"


def labelled_pages():
    """Pages with (text, is content) for each block in order."""
    r = random.Random(9)
    sentence = lambda n: " ".join(r.choice("the a town house hill river people came went saw far near old new day".split()) for _ in range(n)).capitalize() + "."
    for k in range(60):
        parts, want = [], []

        def add(html, text, keep, parts=parts, want=want):
            parts.append(html.format(text))
            want.append((text, keep))

        for i in range(r.randrange(2, 6)):
            add('<nav><ul><li><a href="/x">{}</a></li></ul></nav>', f"Link {i}", False)
        parts.append(r.choice(["<article>", "<main>", '<div class="post-content">']))
        add("<h1>{}</h1>", sentence(4)[:-1], True)
        for i in range(r.randrange(2, 7)):
            add("<p>{}</p>", sentence(r.choice([2, 3, 15, 60])) if r.random() < 0.9 else "All rights reserved.", True)
            if r.random() < 0.3:
                add('<div class="{}">{{}}</div>'.format(r.choice(["ad", "promo-box", "share", "related-posts"])), sentence(r.choice([3, 20])), False)
        parts.append({"<article>": "</article>", "<main>": "</main>"}.get(next(p for p in parts if p in ("<article>", "<main>") or p.startswith('<div class="post')), "</div>"))
        for i in range(r.randrange(3)):
            add('<div class="comment"><p>{}</p></div>', sentence(12), False)
        add("<footer><p>{}</p></footer>", "Copyright of somebody", False)
        yield "<body>" + "".join(parts), want


def test_labelled_pages_go_through_the_cut(monkeypatch):
    flows, changed, wrong, blocks = 0, 0, 0, 0
    original = H._flow

    def counted(*a):
        nonlocal flows
        flows += 1
        return original(*a)

    monkeypatch.setattr(H, "_flow", counted)
    for page, want in labelled_pages():
        own = H.blocks_of(page)
        assert [b.text for b in own] == [t for t, _ in want]
        odds, tied = [b.odds for b in own], H.ties(own)
        got = H.minimum_cut(odds, tied)
        changed += sum(g != (o > 0) for g, o in zip(got, odds, strict=True))
        wrong += sum(g != k for g, (_, k) in zip(got, want, strict=True))
        blocks += len(own)
        if len(own) <= 12:
            cost = lambda x: sum(abs(o) for o, keep in zip(odds, x, strict=True) if keep != (o > 0)) + sum(w for i in range(len(own)) for j, w in tied[i].items() if j < i and x[i] != x[j])  # noqa: B023, E731
            assert cost(got) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=len(own)))))
    assert flows > 40 and changed > 10 and wrong <= 0.01 * blocks, (flows, changed, wrong, blocks)


def test_supplied_pages_go_through_the_cut(spark, monkeypatch):
    flows, changed, original = 0, 0, H._flow

    def counted(*a):
        nonlocal flows
        flows += 1
        return original(*a)

    monkeypatch.setattr(H, "_flow", counted)
    for row in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect():
        own = H.blocks_of(row.html)
        got = H.minimum_cut([b.odds for b in own], H.ties(own))
        changed += sum(g != (b.odds > 0) for g, b in zip(got, own, strict=True))
        article = re.search(r"<article>(.*)</article>", row.html, re.S)[1]
        plain = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert " ".join(b.text for b, keep in zip(own, got, strict=True) if keep).replace(" ", "") == plain.replace(" ", "")
    assert flows > 2000 and changed > 10


@pytest.mark.parametrize("bad", ["<a ", '<a href="x>', "<a '\">", "<div>", "<b><div>", "<div>x", "<p>text. ", "<li>", "<i><p>", "<", "</a", "<div><header>", "<!-- ", "&", "<script>"])
def test_broken_pages_take_linear_time(bad):
    began = time.monotonic()
    H.main_text(bad * (1_000_000 // len(bad)))
    H.main_text(bad * 100_000 + "</b>" * 100_000 + "</x>" * 100_000)
    assert time.monotonic() - began < 20


def test_a_page_of_very_many_blocks():
    page = "<article>" + "<p>One more paragraph of it.</p>" * 200_000 + "</article>"
    began = time.monotonic()
    assert len(H.main_text(page)) == 200_000 * 26 - 1 and time.monotonic() - began < 60


def test_page_without_marks_keeps_its_prose():
    text = "A long text of a page without any marks, which goes on and on. " * 6
    page = f"<body><div class=menu><a href=1>One</a> <a href=2>Two</a></div><div><p>{text}</p><p>And one more paragraph of the same page.</p></div><div><a href=3>More</a></div></body>"
    assert H.main_text(page) == f"{text.strip()} And one more paragraph of the same page."


def test_cuts_are_minimal():
    r = random.Random(3)
    for _ in range(500):
        n = r.randrange(1, 8)
        odds = [r.uniform(-2, 2) for _ in range(n)]
        tied = [{} for _ in range(n)]
        for i, j in itertools.combinations(range(n), 2):
            if r.random() < 0.5:
                tied[i][j] = tied[j][i] = r.random() * 2
        cost = lambda x: sum(abs(o) for o, keep in zip(odds, x, strict=True) if keep != (o > 0)) + sum(w for i in range(n) for j, w in tied[i].items() if j < i and x[i] != x[j])  # noqa: B023, E731
        assert abs(cost(H.minimum_cut(odds, tied)) - min(map(cost, itertools.product([False, True], repeat=n)))) < 1e-9


def test_extraction_rows(spark):
    df = spark.createDataFrame([(1, PAGE, "old", "e"), (2, None, "old", "e"), (2, None, "old", "e")], "page_id long, html string, text string, extra string")
    got = sorted((r.page_id, len(r.text), r.extra) for r in H.extracted(df).collect())
    assert got[:2] == [(1, len(H.main_text(PAGE)), "e"), (2, 0, "e")] and H.extracted(df.where("false")).count() == 0


def plain_distance(item, words):
    before, best = list(range(len(item) + 1)), (len(item), 0)
    for at, w in enumerate(words, 1):
        now = [0]
        for i, x in enumerate(item, 1):
            now.append(min(before[i] + 1, now[-1] + 1, before[i - 1] + (x != w)))
        before, best = now, min(best, (now[-1], at), key=lambda b: b[0])
    return best


def test_distance_equals_the_table():
    r = random.Random(5)
    for _ in range(1500):
        item, words = [r.choice("abc") for _ in range(r.randrange(1, 70))], [r.choice("abcd") for _ in range(r.randrange(90))]
        masks = defaultdict(int)
        for i, w in enumerate(item):
            masks[w] |= 1 << i
        assert D.best_match(masks, len(item), words) == plain_distance(item, words)


def test_leaks_equal_brute_force(spark):
    r = random.Random(6)
    items = [(i, " ".join(f"w{r.randrange(300)}" for _ in range(n))) for i, n in enumerate([1, 3, 4, 5, 9, 15, 30, 60])] + [(90, None), (None, "w1 w2"), (91, ""), (92, "...")]
    texts = [None, "", "nothing of it"]
    for _, t in items[:8]:
        for errors in range(15):
            words = t.split()
            for _ in range(errors):
                at = r.randrange(len(words) + 1)
                words[at : at + r.randrange(2)] = [] if r.random() < 0.3 else [f"v{r.random()}"]
            filler = [f"w{r.randrange(300)}" for _ in range(r.randrange(40))]
            texts.append(" ".join([*filler, *(w.upper() + "!" for w in words), *filler]))
    texts.append(items[0][1].upper() + ".")
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, leaks string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, x.item_id): x.distance for r in D.with_leaks(df, bench).collect() for x in r.leaks}
    want = {}
    for d, t in enumerate(texts):
        for i, item in items[:8]:
            words = item.split()
            best = plain_distance(words, D.words_of(t))[0]
            if best <= int(D.ERRORS * len(words)) if len(words) >= D.LEAST_WORDS else words == D.words_of(t):
                want[d, i] = best
    assert got == want and len(want) > 20 and (len(texts) - 1, 0) in want


def test_benchmark_in_blocks_and_empty(spark, monkeypatch):
    df = spark.createDataFrame([(1, "one two three four five six"), (2, "other")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four five"), (2, "two three four five six"), (3, "zzz")], "item_id long, text string")
    original = D.blocks
    monkeypatch.setattr(D, "blocks", lambda b: original(b, 30))
    assert {r.doc_id: sorted(x.item_id for x in r.leaks) for r in D.with_leaks(df, bench).collect()} == {1: [1, 2], 2: []}
    assert [list(r.leaks) for r in D.with_leaks(df, bench.where("false")).collect()] == [[], []]


def test_ten_blocks_find_what_one_does(spark, monkeypatch):
    r = random.Random(8)
    items = [(i, " ".join(f"w{r.randrange(50)}" for _ in range(12))) for i in range(40)]
    texts = [None, "", *[" ".join(t if r.random() < 0.2 else f"w{r.randrange(50)}" for _, t in r.sample(items, 15)) for _ in range(60)]]
    df = spark.createDataFrame([(i % 50, t, i) for i, t in enumerate(texts)], "doc_id long, text string, found long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted((r.doc_id, r["found"], [tuple(x) for x in r.leaks]) for r in D.with_leaks(df, bench).collect())
    original, alive = D.blocks, []
    monkeypatch.setattr(D, "blocks", lambda b: original(b, 170))
    assert len(list(D.blocks(bench))) >= 10
    destroy = D.Broadcast.destroy
    monkeypatch.setattr(D.Broadcast, "destroy", lambda self, blocking=False: (alive.append(1), destroy(self, blocking))[1])
    assert sorted((r.doc_id, r["found"], [tuple(x) for x in r.leaks]) for r in D.with_leaks(df, bench).collect()) == one
    assert len(alive) == len(list(D.blocks(bench))) and sum(len(x[2]) for x in one) > 40


def test_scripts_without_spaces_are_found():
    item = "今日はとても良い天気なので公園へ散歩に行きました"
    ready = D.Items([(1, item), (2, "yes")], D.ERRORS)
    assert [x[:2] for x in ready.leaks("前文。" + item.replace("良", "悪") + "後文。yes and no")] == [(1, 1)]
    assert D.words_of("abc 天気ab cd") == ["abc", "天", "気", "ab", "cd"]


def test_registered_queries():
    names = queries()
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] and set(oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5


def test_pipeline_stages(spark, tmp_path):
    clean = [f"The {w} house stood on a hill above the town, and people came from far away to see its garden number {i}." for i, w in enumerate(("old", "new", "red", "blue", "white", "black"))]
    shared = "This footer line is the same in all of these documents."
    texts = [f"{clean[0]}\n{shared}", f"{clean[1]}\n{shared}", f"{clean[2]}\n{shared}", clean[3], clean[3], clean[4] + " one two three four five six seven eight nine ten eleven twelve", "bad*** text### " * 20, None, "ok"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "One two three four five SIX seven eight nine ten eleven twelve")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert got[0].text == clean[0] and got[1].text == clean[1] and got[2].text == f"{clean[2]}\n{shared}" and got[3].text == clean[3]
    assert all(r.n_tokens == len(r.ids) > 0 for r in got.values())
