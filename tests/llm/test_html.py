"""HTML extraction: markup cases, the suffix array, and boilerplate by repetition."""

import random
import time

import numpy as np
import pytest

from sievekit.llm import html
from sievekit.llm.html import blocks, decided, extract, op1_html_extraction, repeated_runs, suffix_array


def main_text(page):
    return "\n".join(decided(blocks(page)) or [])


CASES = [
    ("<article><h1>T &amp; u</h1><p>a\n <b>b</b>  c<p>d&nbsp;e</article><footer>f</footer>", "T & u\na b c\nd e"),
    ("<body><nav>n</nav><main><p>x</p><aside>y</aside><form>z<input></form></main>", "x"),
    ("<article><header><h1>Title</h1><span>By me</span></header><p>x</p><footer>tags</footer></article>", "Title\nx"),
    ("<article><p>x</p><div class='ad'>buy</div><p class=notice>cookies<p>y<section id=comments><p>nice</p></section></article>", "x\ny"),
    ("<article><script>if (a < b) '</p>'</script><style>p{}</style><p>x<!-- no --><br>y</p><noscript>js</noscript></article>", "x y"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", "one\ntwo\na\nb"),
    ("<article><p>cut off &am", "cut off &am"),
    ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ("<article><p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p><p>yes</p></article>", "yes"),
    ("<article><p>&#65;&#x42;&eacute;&lt;b&gt;</p></article>", "ABé<b>"),
    ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"), ("", ""), ("<article></article>", ""), ("<nav>only</nav>", ""),
    ("<article>" + "<p>z</p>" * 5000 + "</article>", "\n".join(["z"] * 5000)),
]


def test_markup():
    for page, want in CASES:
        assert main_text(page) == want, page[:80]


NAMES = [
    ("<body class='has-sidebar'><article><p>x</p></article>", "x"), ("<html class='no-js js-form'><article><p>x</p></article>", "x"),
    ("<body class='no-sidebar'><article><p>x</p></article>", "x"), ("<article class='post comments-open'><p>x</p></article>", "x"),
    ("<article><div class='side-by-side'><p>x</p></div><p class=alert>y</p><div class='search form'>z</div></article>", "x\ny\nz"),
    ("<main id=menu><div class='with-sidebar'><p>x</p></div><div class='site-footer'>f</div><div id='cookie-banner'>c</div></main>", "x"),
    ("<article><select><p>x</p></article>", "x"), ("<article><object><p>x<template><p>y</article>", "x\ny"), ("<article><p>x<script>y</article>", "x"),
]


def test_names_and_unclosed_elements():
    for page, want in NAMES:
        assert main_text(page) == want, page


def test_long_page_of_equal_sentences():
    """Work on repetition is in proportion to the tokens, ties or not."""
    long = np.full(40_000, 7, dtype=np.uint64)
    streams = [long, long[:500], np.arange(9, dtype=np.uint64), long[:300]]
    began = time.time()
    got = repeated_runs(streams, [np.full(len(s), 3, dtype=np.int64) for s in streams])
    assert time.time() - began < 20 and got[0].all() and got[1].all() and got[3].all() and not got[2][:7].any()


def test_repetition_decides(monkeypatch):
    """Without the suffix array the texts are others."""
    own = [[("loose", f"Own sentence {j} of page {k} is here.") for j in range(3)] for k in range(5)]
    pages = [[*page, ("loose", "Read more of this in our paper.")] for page in own]
    texts = html.choose(pages)[0]
    monkeypatch.setattr(html, "repeated_runs", lambda streams, words: [np.zeros(len(s), dtype=bool) for s in streams])
    without = html.choose(pages)[0]
    assert all("Read more" not in t for t in texts) and all("Read more" in t for t in without)


def test_counts_over_a_host_equal_brute_force(spark):
    """A host of 500 pages in shards: every sentence on three distinct pages and more goes, no other."""
    rng = random.Random(6)
    pages = [[f"Sentence {rng.randrange(900)} is one of many here." for _ in range(rng.randint(2, 5))] for _ in range(500)]
    on = {}
    for page in {tuple(p) for p in pages}:
        for sentence in set(page):
            on[sentence] = on.get(sentence, 0) + 1
    rows = [(k, "http://one.org/x", "".join(f"<div>{x}</div>" for x in p)) for k, p in enumerate(pages)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)).collect()}
    assert got == {k: "\n".join(x for x in p if on[x] < html.MIN_PAGES) for k, p in enumerate(pages)}
    assert {n >= 3 for n in on.values()} == {True, False}


def test_suffix_array():
    rng = random.Random(0)
    for _ in range(200):
        text = [rng.randrange(3) for _ in range(rng.randint(1, 14))]
        order, shared = suffix_array(np.array(text))
        want = sorted(range(len(text)), key=lambda k: text[k:])
        assert order.tolist() == want
        for k in range(1, len(want)):
            a, b = text[want[k - 1] :], text[want[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[k] == n


def test_repeated_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        pages = [np.array([rng.randrange(5) for _ in range(rng.randint(0, 8))], dtype=np.int64) for _ in range(rng.randint(1, 7))]
        words = [np.array([1 + int(t) % 3 for t in p], dtype=np.int64) for p in pages]
        distinct = list({p.tobytes(): p for p in pages}.values())
        got = repeated_runs(pages, words)
        for p, w, g in zip(pages, words, got, strict=True):
            want = np.zeros(len(p), dtype=bool)
            for a in range(len(p)):
                for b in range(a + 1, len(p) + 1):
                    run = p[a:b]
                    on = sum(any((q[i : i + b - a] == run).all() for i in range(len(q) - (b - a) + 1)) for q in distinct)
                    if on >= 3 and w[a:b].sum() >= 4:
                        want[a:b] = True
            assert g.tolist() == want.tolist()


@pytest.mark.parametrize("most", [html.MAX_BROADCAST, 0])
def test_boilerplate_by_repetition(spark, monkeypatch, most):
    monkeypatch.setattr(html, "MAX_BROADCAST", most)
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    want, rows = {}, []
    for k in range(300):
        body = [" ".join(rng.choice(vocabulary) for _ in range(20)) + "." for _ in range(3)]
        page = "".join(f"<div>{x}</div>" for x in ["Home page of the site.", *body, "All rights are reserved here. Write to us."])
        rows.append((k, f"http://h{0 if k % 3 else k % 5}.org/{k}", page, "clash"))
        want[k] = "\n".join(body)
    rows += [(900, None, None, ""), (901, "http://h0.org/", "", ""), (902, "x", "<article><p>é</p></article>", ""), (5, *rows[5][1:])]
    got = extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert {k: texts[k] for k in want} == want and texts[900] == texts[901] == "" and texts[902] == "é"
    assert all(r.n_chars == len(r.text) for r in got)


def test_windows_cover_what_runs_cover():
    rng = random.Random(4)
    for _ in range(200):
        pages = [np.array([rng.randrange(5) for _ in range(rng.randint(0, 9))], dtype=np.uint64) for _ in range(rng.randint(1, 7))]
        words = [np.array([int(t) % 3 for t in p], dtype=np.int64) for p in pages]
        on = {}
        for p, w in zip(pages, words, strict=True):
            for h in html.windows(p, w, 7)[2].tolist():
                on.setdefault(h, set()).add(p.tobytes())
        for p, w, want in zip(pages, words, repeated_runs(pages, words), strict=True):
            got = np.zeros(len(p), dtype=bool)
            for a, b, h in zip(*html.windows(p, w, 7), strict=True):
                got[a:b] |= len(on[int(h)]) >= html.MIN_PAGES
            assert got.tolist() == want.tolist()


@pytest.mark.parametrize("most", [html.MAX_REPEATED, 0])
def test_shards_change_nothing(spark, monkeypatch, most):
    """Notices on few pages of a large host, which no shard holds often enough."""
    monkeypatch.setattr(html, "MAX_REPEATED", most)
    rows = []
    for k in range(400):
        own = "".join(f"<div>Page {k} says sentence {j} of its own.</div>" for j in range(3))
        note = f"<div>Notice {k % 100} is on four pages here.</div>" if k < 390 else ""
        rows.append((k, f"http://big.org/{k}", own + note))
    rows += [(1000 + k, f"http://big.org/copy{k}", "<div>Equal pages count as one page only.</div>") for k in range(9)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)

    def run():
        return sorted(tuple(r) for r in extract(table).collect())

    dealt = run()
    monkeypatch.setattr(html, "SHARD", 1000)
    assert dealt == run()
    assert not any("Notice" in r[2] for r in dealt) and all(r[2] for r in dealt)


@pytest.mark.parametrize("most", [html.MAX_REPEATED, 0])
@pytest.mark.parametrize("kind", ["article", "main"])
def test_articles_lose_what_the_host_has_in_noise(spark, monkeypatch, kind, most):
    """A line of many articles stays, unless some page of the host has it in its footer."""
    monkeypatch.setattr(html, "MAX_REPEATED", most)
    copy = [f"This is sentence {j} of an article with copies." for j in range(6)]
    rows, want = [], {}
    for k in range(260):
        own = [f"Page {k} says sentence {j} of its own." for j in range(3)] + ["A saying that many articles quote."]
        body = "".join(f"<p>{x}</p>" for x in own)
        foot = "<footer><p>Read more of this in our paper.</p></footer>" if k == 7 else ""
        rows.append((k, f"http://h{k % 2 * (k % 40)}.org/{k}", f"<{kind}>{body}<p>Read more of this in our paper.</p></{kind}>{foot}"))
        noted = k % 2 * (k % 40) in (0, 7)  # host 0 has no such footer, host 7 has one
        want[k] = "\n".join(own if noted and k % 2 else [*own, "Read more of this in our paper."])
    rows.append((900, "http://h0.org/foot", "<main><p>x</p></main><footer><p>Read more of this in our paper.</p></footer>"))
    want |= {k: want[k].removesuffix("\nRead more of this in our paper.") for k in range(0, 260, 2)} | {900: "x"}
    rows += [(1000 + k, f"http://h1.org/c{k}", f"<{kind}>{''.join(f'<p>{x}</p>' for x in copy)}<p>Seen by reader {k}.</p></{kind}>") for k in range(4)]
    want |= {1000 + k: "\n".join([*copy, f"Seen by reader {k}."]) for k in range(4)}
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)).collect()}
    assert got == want


@pytest.mark.parametrize(
    "mark", ["class=share-price", "class=comment-on-law", "id=related-work", "class=menu-of-the-day", "id=notice-period", "id=cookies", "class='price share-price'"]
)
def test_names_that_an_article_may_be_about(mark):
    page = f"<article><p>One.</p><section {mark}><h2 {mark}>Two</h2><p>Three.</p></section></article>"
    assert decided(blocks(page)) == ["One.", "Two", "Three."]


@pytest.mark.parametrize("mark", ["id=comments", "class=post-comments", "class=notice", "class='x share'", "id=related", "class=site-footer", "role=navigation"])
def test_names_of_noise_within_articles(mark):
    assert decided(blocks(f"<article><p>One.</p><div {mark}><p>Three.</p></div></article>")) == ["One."]


@pytest.mark.parametrize(
    "page",
    [
        "<a \"" * 300_000, "<a \"" * 300_000 + ">", "<a \"b" * 200_001 + "'>", "<a \">\"" * 150_000 + "'", "<a" * 500_000, "<!" * 500_000, "<a '>" * 200_001,
        "<div>" * 5_000 + "<i>x</i>" * 100_000, "<div>" * 5_000 + "</section>" * 90_000, "<ul><li><ul>" + "<div>" * 5_000 + "<li></li>" * 90_000,
        "<div>" * 5_000 + "<p>x" * 90_000, "<!--" + "<a>" * 300_000, "<script>" * 100_000,
    ],
)
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    blocks(page)
    assert time.process_time() - began < 4


def test_unended_tags_and_quotes():
    assert blocks("a <b x='>' y=\">\">c</b> d") == [("loose", "a c d")]
    assert blocks("<p>a <b 'x>c") == [("loose", "a c")]
    assert blocks("a <b c") == [("loose", "a <b c")]
    assert blocks("a <b <!-- c") == [("loose", "a <b")]
    assert blocks("a <b <!-- c --> d") == [("loose", "a d")]
    assert blocks("a <!-- b --> <!x> <?y> 1 < 2") == [("loose", "a 1 < 2")]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert op1_html_extraction(spark, str(tmp_path)).count() == 0
