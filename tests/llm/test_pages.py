"""Main texts and languages of pages."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askloom.llm import html, language

PAGES = "page_id bigint, url string, html string"


def site(rng: random.Random, n: int, boxes: str = "") -> list[tuple[str, str]]:
    """Pages of a host without article elements, and their main texts."""
    out = []
    for i in range(n):
        words = lambda k: " ".join(f"v{rng.randrange(10**6)}" for _ in range(k))
        parts = [words(6), *[words(25) for _ in range(rng.randint(2, 5))]]
        body = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{p}</p>" for p in parts[1:])
        page = (
            f"<html><head><title>t{i}</title><script>var a='<p>no</p>';</script></head><body><div class=top>Our site</div>"
            f"<div class='main-menu'><a href=/>Home {i}</a></div><div class=body>{body}{boxes}</div>"
            f"<div class=bottom>All rights reserved</div></body></html>"
        )
        out.append((page, "\n\n".join(parts)))
    return out


def test_template_texts_go_and_slots_stay():
    pages = site(random.Random(1), 12, "<div class=x>Read on tomorrow</div>")
    assert html.main_texts([p for p, _ in pages]) == [t for _, t in pages]


def test_copies_of_a_page_are_no_evidence():
    (page, text), *rest = site(random.Random(2), 8)
    got = html.main_texts([page] * 20 + [p for p, _ in rest])
    assert got == [text] * 20 + [t for _, t in rest]


@pytest.mark.parametrize(
    "source, want",
    [
        (None, ""), ("", ""), ("plain text &amp; more", "plain text & more"),
        ("<article><h1>T&eacute;</h1><p><b>One.<br><p>Two &lt;x&gt;\n\t 3</article><footer>f</footer>", "Té\n\nOne.\n\nTwo <x> 3"),
        ("<p>before<article><p>in<aside>no</aside><form>no<p>no</form><p>side</article>after", "in\n\nside"),
        ("<article><p>a<script>x</p><p>y</script>b</p><style>p{}</style><!-- <p>no --><p>c<!-- open", "ab\n\nc"),
        ("<main><div class='cookie-notice'>no</div><section id='comments'><p>no</p></section><p>yes</main>", "yes"),
        ("<body><nav><ul><li>no<li>no</ul></nav><p>a<ul><li>b<li>c</ul><div role=banner>no</div>", "a\n\nb\n\nc"),
        ("<article><header><h1>T</h1></header><p>x <i>y</i>z &nbsp; w</p></article>", "T\n\nx yz w"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<p>a < b and c</p><div class=AdBox>no</div>", "a < b and c"),
        ("<div class='layout sidebar-right'><article><p>a</article></div><div class=sidebar>no</div>", "a"),
        ("<main><p>a<article class='comment'><p>no</article><section id=comments><article><p>no</article></section></main>", "a"),
        ("<body class='menu-open'><main class='has-sidebar'><p>a</main><aside><article>no</article></aside>", "a"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
    ],
)
def test_single_pages(source, want):
    assert html.main_texts([source or ""]) == [want]


@pytest.mark.parametrize(
    "source, want",
    [
        ("<article><h2 id='related-work'>Related</h2><p id=social>a<section id=discussion><p>b</section><h2 id=navigation>N", "Related\n\na\n\nb\n\nN"),
        ("<h1>T</h1><div class='content has-sidebar'><p>long text</div><div class=sidebar>no</div>", "T\n\nlong text"),
        ("<h1>T</h1><div class='social content'><p>long text</div><div class=sidebar>no</div>", "T\n\nlong text"),
        ("<div class='layout--sidebar'><p>a</div><div class='contentNoSidebar'><p>b</div><div class=ad>-", "a\n\nb"),
        ("<article><div class='body share'><p>long text</div><div class=promo>no</div></article>", "long text"),
        ("<article><p>text <span class=share>no</span>goes on</article>", "text goes on"),
        ("<div class=text><p>long text</div><section id=comments><article><p>no</article></section>", "long text"),
        ("<article></article><div class=ad>no</div>", ""),
        ("<article><div class=ad>no</div></article><p>long text", "long text"),
    ],
)
def test_class_and_id_words_are_evidence_only(source, want):
    assert html.main_texts([source]) == [want]


@pytest.mark.parametrize(
    "part, text",
    [
        ("<section class='discussion'><p>We discuss results.</p></section>", "We discuss results."),
        ("<div class='related-work'><p>Others</p></div>", "Others"),
        ("<div class='widget-example'>A widget</div>", "A widget"),
        ("<blockquote class='comment'>Quoted</blockquote>", "Quoted"),
        ("<p class='social'>Society</p>", "Society"),
        ("<pre><span class='hljs-comment'># why</span></pre>", "# why"),
    ],
)
@pytest.mark.parametrize("n", [1, 12])
def test_named_parts_of_an_article_stay_while_their_text_varies(part, text, n):
    pages = [f"<article><h1>T{i}</h1><p>Intro {i} of some length</p>{part.replace(text, f'{text} {i}')}</article>" for i in range(n)]
    assert html.main_texts(pages) == [f"T{i}\n\nIntro {i} of some length\n\n{text} {i}" for i in range(n)]


def test_named_parts_of_an_article_go_if_their_text_is_constant():
    parts = "<p class='social'>Follow us</p><section class='related-posts'><p>Read more</p></section><div class='ad'>Buy {}</div>"
    pages = [f"<article><h1>T{i}</h1><p>Intro {i} of some length</p>{parts.format(i)}</article>" for i in range(12)]
    assert html.main_texts(pages) == [f"T{i}\n\nIntro {i} of some length" for i in range(12)]


def test_every_host_induces_a_template_and_article_tags_decide_nothing(monkeypatch):
    """Tags and roles are priors: with other tags, alignment alone finds the same texts."""
    calls = []
    match = html.match
    monkeypatch.setattr(html, "match", lambda *a: calls.append(1) or match(*a))
    for n in (3, 15, 40):
        pages = [(p.replace("<div class=body>", "<article>").replace("</div><div class=bottom", "</article><div class=bottom"), t) for p, t in site(random.Random(n), n)]
        assert all("<article>" in p and "</article>" in p for p, _ in pages)
        calls.clear()
        assert html.main_texts([p for p, _ in pages]) == [t for _, t in pages]
        assert len(calls) >= n - 1
        assert html.main_texts([p.replace("article>", "div>") for p, _ in pages]) == [t for _, t in pages]


def test_given_pages_are_the_same_without_article_tags(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    renamed = pages.withColumn("html", F.regexp_replace("html", "(</?)article\\b", "$1div"))
    hosts = pages.groupBy(html.host_of(F.col("url")).alias("host")).agg(F.countDistinct("html").alias("n"))
    large = {r.host for r in hosts.where("n >= 3").collect()}
    host = html.host_of(F.col("url")).alias("host")
    as_given = {(r.page_id, r.text) for r in html.main_text(pages).select("page_id", "text", host).collect() if r.host in large}
    assert as_given == {(r.page_id, r.text) for r in html.main_text(renamed).select("page_id", "text", host).collect() if r.host in large}
    assert as_given


def test_a_constant_title_right_above_what_varies_stays():
    pages = [(p.replace(p.split("<h1>")[1].split("</h1>")[0], "Daily report"), "Daily report\n\n" + t.split("\n\n", 1)[1]) for p, t in site(random.Random(13), 12)]
    assert html.main_texts([p for p, _ in pages]) == [t for _, t in pages]


def test_named_box_goes_and_named_main_text_stays():
    pages = site(random.Random(8), 12, "<div class='related-links'>Read on tomorrow</div>")
    pages = [(p.replace("class=body", "class='post social'"), t) for p, t in pages]
    assert html.main_texts([p for p, _ in pages]) == [t for _, t in pages]


@pytest.mark.parametrize("n", [3, 5, 12])
def test_repeated_headings_and_passages_of_articles_stay(n):
    rng = random.Random(9)
    words = lambda k: " ".join(f"v{rng.randrange(10**6)}" for _ in range(k))
    shared, pages, want = words(50), [], []
    for i in range(n):
        parts = [words(6), "Introduction", words(60), shared if i % 2 == 0 else words(50), "Summary", words(30)]
        tags = ["h1", "h2", "p", "p", "h2", "p"]
        body = "".join(f"<{t}>{p}</{t}>" for t, p in zip(tags, parts))
        pages.append(f"<div>Our site</div><article>{body}<div class=promo>Buy</div></article><div>All rights reserved</div>")
        want.append("\n\n".join(parts))
    assert html.main_texts(pages) == want


def test_tree_matching_pairs_children_in_order():
    a, b = (html.parse(f"<ul>{x}</ul>") for x in ("<li>1<p>2</p></li><b>3</b><li>4</li>", "<i>0</i><li>1<p>2</p></li><li>5</li>"))
    pairs = {}
    assert html.match(a, b, pairs) == 5  # root, list, two items, one paragraph


def test_tree_matching_weighs_subtrees():
    a, b = (html.parse(f"<body>{x}<div><h1>T</h1><p>1<p>2</div></body>") for x in ("<div><i>notice</i></div>", ""))
    pairs = {}
    assert html.match(a, b, pairs) == 6  # root, body, the div of the heading, heading, two paragraphs
    chains = [html.parse("<div>" * 3000 + x) for x in ("<p>1", "<b>1")]
    assert html.match(*chains, {}) == 3001


@pytest.mark.parametrize("seed", range(20))
def test_tree_matching_equals_plain_recursion(seed):
    rng = random.Random(seed)
    grow = lambda d: "".join(f"<{t}>{grow(d - 1)}</{t}>" for t in rng.choices(("div", "section", "ul"), k=rng.randint(0, 4))) if d else ""

    def best(x, y):
        p, q = ([c for c in n.children if not isinstance(c, str)] for n in (x, y))
        table = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, c in enumerate(p):
            for j, d in enumerate(q):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + (best(c, d) if c.kind == d.kind else 0))
        return 1 + table[-1][-1]

    a, b = html.parse(grow(4)), html.parse(grow(4))
    assert html.match(a, b, {}) == best(a, b)


def test_long_lists_are_matched_like_short_ones(monkeypatch):
    rng = random.Random(5)
    tags = rng.choices(("div", "section"), k=2100)
    rows = ["".join(f"<{t}></{t}>" for t in (*tags, "ol")), "".join(f"<{t}></{t}>" for t in ("ul", *tags))]
    assert html.match(*(html.parse(f"<main>{r}</main>") for r in rows), {}) == 2 + len(tags)
    items = [f"<li>{''.join('<div></div>' if k >> i & 1 else '<section></section>' for i in range(7))}</li>" for k in range(120)]
    lists = ["".join(items), "".join(items[1:] + items[:1])]
    assert html.match(*(html.parse(f"<ul>{x}</ul>") for x in lists), {}) == 2 + 119 * 8
    short = [html.parse("".join(f"<{t}></{t}>" for t in part)) for part in (tags[:300], tags[100:350])]
    whole = html.match(*short, {})
    monkeypatch.setattr(html, "MOST_CELLS", 100)
    monkeypatch.setattr(html, "MOST_KNOWN", 0)
    assert html.match(*short, {}) == whole


def test_each_layout_of_a_host_has_its_own_template():
    rng = random.Random(10)
    want, pages = [], []
    for i, (p, t) in enumerate(site(rng, 36)):
        k = i * 3 // 36
        p = p.replace("class=top", f"class=top{k}").replace("class=body", f"class=body{k}").replace("class=bottom", f"class=bottom{k}")
        pages.append(p.replace("Our site", f"Our site {k}").replace("<div class=bottom", f"<div class=legal{k}>Terms {k}</div><div class=bottom"))
        want.append(t)
    assert html.main_texts(pages) == want


def test_optional_notice_that_the_first_pages_lack():
    pages = site(random.Random(11), 24)
    pages = [(p.replace("<div class=body", "<div class=x>Moved</div><div class=body") if i % 4 == 3 else p, t) for i, (p, t) in enumerate(pages)]
    assert html.main_texts([p for p, _ in pages]) == [t for _, t in pages]


def test_headings_between_varying_paragraphs_stay_without_article():
    pages = [(p.replace("</h1>", "</h1><h2>Introduction</h2>"), t.replace("\n\n", "\n\nIntroduction\n\n", 1)) for p, t in site(random.Random(12), 12)]
    assert html.main_texts([p for p, _ in pages]) == [t for _, t in pages]


def test_query_on_odd_rows(spark, tmp_path):
    pages = site(random.Random(3), 60)
    rows = [(i, f"http://host.example/{i}", p) for i, (p, _) in enumerate(pages)]
    rows += [(100, None, None), (101, "no address", ""), (None, "http://host.example/x", "<article>no id</article>"), rows[0]]
    rows += [(102, "http://other.example/", "<article>" + "<p>long text</p>" * 20_000)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as host", "2 as block", "3 as text").repartition(5)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = html.op9_html_extraction(spark, str(tmp_path)).collect()
    want = {i: t for i, (_, t) in enumerate(pages)} | {100: "", 101: "", None: "no id", 102: "\n\n".join(["long text"] * 20_000)}
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    assert all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)
    assert html.main_text(df.where("false")).collect() == []


def test_languages_of_pages_and_each_kind_of_evidence(spark):
    rng = random.Random(4)
    vocabulary = {x: [f"{x}{rng.randrange(500)}{y}" for y in "abcdef"] for x in ("en", "de", "fr")}
    text = lambda x, n: " ".join(rng.choice(vocabulary[x]) for _ in range(n))
    docs = [(i, text(x, 60), x) for i, x in enumerate(["en", "de", "fr"] * 30)] + [(1000, None, "en"), (1001, "x", None)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").selectExpr("*", "1 as bucket")
    rows = []
    for i in range(150):
        x = ("en", "de", "fr")[i % 3]
        rows.append((i, f"http://{x}.site{i % 2}.example/{x}/p{i}", f"<html lang={x}><p>{text(x, 40)}</p></html>"))
    rows += [(200, "http://site9.example/fr/1", ""), (201, "http://z.example/", "<html lang=de></html>"), (202, "http://de.site0.example/9", None)]
    rows += [(203, None, None), (None, "http://a.b/", f"<p>{text('fr', 30)}"), (204, "http://x/", "<p>" + text("en", 50_000)), rows[0]]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as prior", "2 as lang", "'q' as host")
    got = language.page_languages(pages, docs).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    of = {r.page_id: r for r in got}
    assert all(of[i].lang == ("en", "de", "fr")[i % 3] and of[i].confidence > 0.99 for i in range(150))
    assert (of[200].lang, of[201].lang, of[202].lang, of[None].lang, of[204].lang) == ("fr", "de", "de", "fr", "en")
    assert of[203].lang in ("en", "de", "fr") and of[203].confidence < 0.9
    assert language.page_languages(pages.where("false"), docs).collect() == []
    nothing = language.page_languages(pages, docs.where("false")).collect()
    assert len(nothing) == len(rows) and all(r.lang is None and r.confidence == 0 for r in nothing)


def test_rare_languages_of_many_documents_are_known(spark):
    rare = [f"r{k:02d}" for k in range(80)]  # more than a task holds at once
    many = spark.range(60_000).selectExpr("id as doc_id", "'same words again' as text", "'en' as lang")
    few = spark.createDataFrame([(10**6 + k, f"{x}a {x}b {x}c", x) for k, x in enumerate(rare)], "doc_id bigint, text string, lang string")
    docs = many.union(few.coalesce(1))
    langs, weights = language.fit(docs)
    assert langs == ["en", *rare]
    expected = np.full((language.BUCKETS, 2), language.SMOOTHING)
    for j, (text, n) in enumerate([("same words again", 60_000), ("r00a r00b r00c", 1)]):
        np.add.at(expected[:, j], language.features(pa.array([text]))[0], n)
    assert np.allclose(weights[:, :2], np.log(expected / expected.sum(axis=0)))
    rows = [(k, f"http://h{k}.example/", f"<p>{x}a {x}b {x}c {x}a {x}b") for k, x in enumerate(rare)]
    got = {r.page_id: r.text_lang for r in language.page_languages(spark.createDataFrame(rows, PAGES), docs).collect()}
    assert got == dict(enumerate(rare))


def test_fusion_equals_bayes_by_hand(spark):
    """The fused posterior of every page against sums written out in plain Python."""
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["aa", "ab", "ba"] if i % 2 else ["bb", "ab", "ba"]) for _ in range(5)), "xy"[i % 2]) for i in range(40)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    rows = [(i, f"http://h{i % 3}.d{i % 2}.org/{'xy'[i % 2] * 2}/", f"<html lang={'xx' if i % 5 else 'yy'}>{rng.choice(['aa', 'bb', 'ab ba'])}") for i in range(30)]
    pages = spark.createDataFrame(rows, PAGES)
    langs, weights = language.fit(docs)
    soft, logs, keys = [], [], []
    for _, url, page in rows:
        bucket, _ = language.features(pa.array([language.plain(page)]))
        total = np.array([weights[bucket, j].astype(float).sum() for j in range(2)]) * min(1.0, language.MOST_WEIGHT / max(len(bucket), 1))
        logs.append(total), soft.append(np.exp(total - total.max()) / np.exp(total - total.max()).sum())
        host = url.split("/")[2]
        keys.append((host, host.split(".", 1)[1], page[11:13], "org/" + url.split("/")[3]))
    soft = np.array(soft)
    summed = lambda k: {v: soft[[i for i, x in enumerate(keys) if x[k] == v]].sum(axis=0) for v in {x[k] for x in keys}}
    hosts, domains, declared, suffixes, every = summed(0), summed(1), summed(2), summed(3), soft.sum(axis=0)
    smooth = lambda own, base, w: (own + w * base) / (own.sum() + w)
    chance = lambda seen: np.log((seen + language.TABLE_WEIGHT * seen.sum() / every.sum()) / (every + language.TABLE_WEIGHT))
    got = {r.page_id: r for r in language.page_languages(pages, docs).collect()}
    for (i, *_), x, (h, d, dec, suf) in zip(rows, logs, keys):
        prior = smooth(hosts[h], smooth(domains[d], (every + 1) / (every.sum() + 2), language.DOMAIN_WEIGHT), language.HOST_WEIGHT)
        total = x + np.log(prior) + chance(declared[dec]) + chance(suffixes[suf])
        p = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert got[i].lang == langs[int(p.argmax())] and got[i].confidence == pytest.approx(p.max(), abs=1e-6)
