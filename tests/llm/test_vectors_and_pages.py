"""Searches against brute force, pages against their articles, and the pipeline as a whole."""

import html
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import ann, common, grid, queries, topk
from quire.llm import html as pages_


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    return common.table(spark, sf_dir, "embeddings")


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.5, 0.5]), (4, [1.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (10, [-1.0, 0.0]), (10, [-1.0, 0.0]), (11, [1.0, 2.0, 3.0]), (200, [0.5, 0.5]), (300, None), (12, [])]
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id bigint, embedding array<float>, query string, hits string")


@pytest.mark.parametrize("cell_rows", [None, 40])
def test_exact_topk_is_brute_force(vectors, cell_rows):
    rows = vectors.toPandas()
    whole = np.floor(1024 * np.stack(rows.embedding).astype(np.float64)).astype(np.int64)
    ids = rows.vec_id.to_numpy()
    got = {}
    for r in topk.exact_topk(vectors.filter("vec_id % 100 = 0"), vectors, 10, cell_rows).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for i in ids[ids % 100 == 0]:
        s = whole @ whole[ids == i][0]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:10]
        assert sorted(got[i]) == [(n + 1, ids[j], s[j]) for n, j in enumerate(order)]


def test_exact_topk_on_odd_rows(spark):
    odd = odd_vectors(spark)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_topk(odd.filter("vec_id % 100 = 0"), odd, 3).collect())
    big = 1024 * 1024
    assert got == [(100, 1, 4, big), (100, 2, 1, big // 2), (100, 3, 2, big // 2), (200, 1, 1, big // 2), (200, 2, 2, big // 2), (200, 3, 3, big // 2)]
    assert topk.exact_topk(odd.limit(0), odd, 3).count() == 0
    assert topk.exact_topk(odd, odd.limit(0), 3).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 1.0]), (2, [-1e30, 1.0])], "vec_id bigint, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.exact_topk(huge.filter("vec_id = 0"), huge, 5).collect()] == [(1, 2**63 - 1), (2, -(2**63 - 1))]


def test_nearest_finds_most_of_brute_force(spark):
    table = common.table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = table.toPandas()
    ids, v = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(np.float64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    found = {}
    for r in ann.nearest(table.filter("vec_id % 50 = 0"), table, 5).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for i in ids[ids % 50 == 0]:
        s = u @ u[ids == i][0]
        s[ids == i] = -2
        hits += len(set(ids[np.argsort(-s)[:5]]) & {x[1] for x in found[i]})
        for _, j, score in found[i]:
            assert score == pytest.approx(s[ids == j][0], abs=1e-12)
        assert [x[0] for x in sorted(found[i])] == [1, 2, 3, 4, 5]
    assert hits / (5 * len(found)) >= 0.9


def test_nearest_on_odd_rows(spark):
    odd = odd_vectors(spark)
    got = {}
    for r in ann.nearest(odd.filter("vec_id % 100 = 0"), odd, 2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 6)))
    assert sorted(got[100]) == [(1, 4, 1.0), (2, 1, 0.707107)]
    assert sorted(got[200]) == [(1, 1, 1.0), (2, 2, 1.0)]
    assert ann.nearest(odd.limit(0), odd, 2).count() == 0
    assert ann.nearest(odd, odd.limit(0), 2).count() == 0


def test_nearest_among_many_ties_and_few_finds(spark, monkeypatch):
    """100 different vectors of one cosine: the smallest ids win; where probes find too little, all is scanned."""
    rng = np.random.default_rng(5)
    around = [[3.0] + [4.0 * sign * (j == axis) for j in range(7)] for axis in range(7) for sign in (1, -1)]
    rows = [(0, [1.0] + [0.0] * 7)] + [(1000 - 20 * n - i, [x * 2.0**n for x in v]) for n in range(8) for i, v in enumerate(around)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    ids = sorted(i for i, _ in rows if i)
    got = sorted((r["rank"], r.vec_id, r.score) for r in ann.nearest(table.filter("vec_id = 0"), table, 5).collect())
    assert got == [(n + 1, ids[n], pytest.approx(0.6)) for n in range(5)]
    noise = [(i, rng.standard_normal(24).tolist()) for i in range(400)]
    table = spark.createDataFrame(noise, "vec_id bigint, embedding array<double>")
    u = np.array([v for _, v in noise])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for fitted in (ann.PROBES + 1, 1):
        monkeypatch.setattr(ann, "_fit", lambda *a, n=fitted: n)
        found = {}
        for r in ann.nearest(table.filter("vec_id % 50 = 0"), table, 60).collect():
            found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        for i in range(0, 400, 50):
            order = [int(j) for j in np.argsort(-(u @ u[i])) if j != i][:60]
            if fitted > 1:
                assert [j for _, j in sorted(found[i])] == order
            assert len(found[i]) == 60


def test_grid_cells_hold_few_rows_and_meet_once(spark):
    q = spark.range(50).select(F.col("id").alias("q"), F.lit(0).alias("k"))
    c = spark.range(300).select(F.col("id").alias("c"), (F.col("id") % 3 == 1).cast("int").alias("k"))
    left, right, columns = grid.grid(q, c, ["k"], "q", "c", 20)
    assert columns == 10
    pairs = left.join(right, ["k", "_row", "_col"]).select("q", "c")
    assert pairs.count() == pairs.distinct().count() == 50 * 200


def test_pages_against_their_articles(spark, sf_dir):
    table = common.table(spark, sf_dir, "pages")
    got = {r.page_id: r for r in pages_.main_text(table).collect()}
    for r in table.collect():
        article = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_structure_of_pages():
    cases = {
        '<body><div class="content-with-sidebar"><p>Hello &amp; bye</p><div class=sidebar>no</div><p>x <b>y</b>z</p></div>': ["Hello & bye", "x yz"],
        '<main><h1>T</h1><div id="comments"><p>c</p></div><p>a<br>b</p></main><p>out': ["T", "a b"],
        "<nav><p>menu<article><header><h1>H</h1></header><p>1 < 2 & 3</p><article>comment</article><footer>f</footer></article>": ["H", "1 < 2 & 3"],
        "<!-- <article>x</article> --><div>real</div><script>if(a<b){}</script>tail": ["real", "tail"],
        '<article><p>one</p><div class="ad">buy</div><aside>s</aside><form><p>f</p></form><p>two&nbsp;three</p></article>': ["one", "two three"],
        "": [],
    }
    for page, blocks in cases.items():
        assert pages_.blocks(page)[0] == blocks


def test_which_article_of_a_page():
    """Articles in chrome, articles in articles, attribute values, and references cut by a tag."""
    cases = {
        "<main>story</main><aside><article>teaser</article></aside>": ["story"],
        "<main>story</main><footer><article>teaser</article></footer>": ["story"],
        "<div>story</div><aside><div><article>teaser</article></div></aside>": ["story"],
        '<article class="page"><div><article class="post"><p>Post.</p></article></div></article>': ["Post."],
        "<article><h1>Big</h1><section><article>Chapter</article></section></article>": ["Big", "Chapter"],
        "<article><p>Story.</p><section><h2>3 Comments</h2><article>nice</article><article>no</article></section></article>": ["Story."],
        '<article><p>Story.</p><div><article itemprop="comment"><p>nice</p></article></div></article>': ["Story."],
        '<div role="main"><p>crumbs</p><article><p>A longer story here.</p></article></div>': ["A longer story here."],
        "<main><p>Long main story.</p><article>teaser</article></main>": ["Long main story.", "teaser"],
        "<div><article>teaser</article></div><div><article>The whole story.</article></div>": ["The whole story."],
        "<article>Part one.</article><article>Part two.</article>": ["Part one.", "Part two."],
        "<form><div><article>Story</article></div></form>": ["Story"],
        '<article><p title="a hidden gem">A</p><div data-state="x hidden y">B</div><p data-role="search">C</p><p data-id="comments">D</p></article>': ["A", "B", "C", "D"],
        "<article><p hidden>x</p><p HIDDEN=''>x</p><p aria-hidden = 'true'>x</p><p style='display: none'>x</p>y</article>": ["y"],
        "<p>&am<b>p;</b> &amp;lt; &lt;b&gt;</p>": ["&amp; &lt; <b>"],
        "<article></article><div>loaded</div>": ["loaded"],
    }
    for page, blocks in cases.items():
        assert pages_.blocks(page)[0] == blocks, page


def test_a_passage_of_three_pages_of_a_large_host_goes(spark):
    say = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(i, f"https://big.example/{i}", f"<div>{say(f'own{i}x', 9)}</div>" + (f"<p>{say('notice', 20)}</p>" if i < 3 else "")) for i in range(20)]
    rows += [(30 + i, f"https://two.example/{i}", f"<div>{say(f'two{i}x', 9)}</div><p>{say('notice', 20)}</p>") for i in range(2)]
    got = {r.page_id: r.text for r in pages_.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: say(f"own{i}x", 9) for i in range(20)} | {30 + i: say(f"two{i}x", 9) for i in range(2)}


def test_runs_that_other_pages_repeat_go(spark):
    menu = "<div>" + " ".join(f"menu{i}" for i in range(12)) + "</div>"
    quoted = "<p>" + " ".join(f"quote{i}" for i in range(20)) + "</p>"
    rows = [(i, f"https://h.example/{i}", f"{menu}<p>unique words of page {i} stand here alone</p>") for i in range(4)]
    rows += [(10, "https://h.example/a", f"<article>{quoted}</article>{menu}"), (11, "https://h.example/b", f"<article>{quoted}</article>"), (12, "https://other.example/", menu), (13, None, None), (14, None, ""), (14, None, "")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, text string, row string")
    got = sorted((r.page_id, r.text) for r in pages_.main_text(df).collect())
    alone = re.sub("<[^>]*>", "", menu)
    assert got == [(i, f"unique words of page {i} stand here alone") for i in range(4)] + [(10, re.sub("<[^>]*>", "", quoted)), (11, re.sub("<[^>]*>", "", quoted)), (12, alone), (13, ""), (14, ""), (14, "")]
    assert pages_.main_text(df.limit(0)).count() == 0


def test_what_stands_beside_articles_is_known_to_the_host(spark):
    """A page without an article loses the menu that its host's article pages have beside their articles, and keeps a
    story that they hold as articles."""
    say = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    menu, story = say("menu", 12), say("story", 20)
    rows = [(i, f"https://h.example/{i}", f"<div>{menu}</div><article><p>{story}</p><p>own {i}</p></article>") for i in range(3)]
    rows += [(3, "https://h.example/3", f"<div>{menu}</div><div>{story}</div>"), (4, "https://other.example/", f"<div>{menu}</div><div>{story}</div>")]
    got = {r.page_id: r.text for r in pages_.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"{story}\nown {i}" for i in range(3)} | {3: story, 4: f"{menu}\n{story}"}


@pytest.mark.parametrize("pages_a_group", [8192, 3])
def test_articles_meet_their_host_too(spark, sf_dir, monkeypatch, pages_a_group):
    """Runs of a text that other rows of the host hold are counted, whether it is an article or not; by brute force."""
    monkeypatch.setattr(pages_, "PAGES", pages_a_group)
    say = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(i, f"https://h{i % 2}.example/{i}", f"<article><p>{say('quote', 10 + i % 5)}</p><p>{say(f'own{i}x', 3)}</p></article>") for i in range(700)]
    rows += [(700, "https://h0.example/700", f"<div>{say('quote', 9)} {say('new', 9)}</div>"), (701, "https://h0.example/701", f"<article>{say('quote', 7)}</article>"), (702, None, f"<article>{say('quote', 9)}</article>"), (703, "https://h1.example/", None)]
    rows += [(1000 + r.page_id, r.url, r.html) for r in common.table(spark, sf_dir, "pages").collect()] * 2
    found = pages_.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()
    hosts = [(r.url or "").split("//")[-1].split("/")[0] for r in found]
    runs = [[tuple(t[i : i + pages_.RUN]) for i in range(len(t) - pages_.RUN + 1)] for t in (r.text.split() for r in found)]
    held = Counter((h, x) for h, own in zip(hosts, runs) for x in set(own) if h)
    assert [r.n_repeated for r in found] == [sum(held[h, x] > 1 for x in own) for h, own in zip(hosts, runs)]
    assert sum(r.n_repeated > 0 for r in found) > 700


def test_copies_keep_their_text(spark):
    """Copied rows, one page under two URLs, pages without a host, and a paragraph of 2 of 12 pages keep their text;
    the menu of all pages goes."""
    say = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    menu, story, shared = say("menu", 12), say("story", 30), say("shared", 15)
    page = lambda *parts: "".join(f"<div>{p}</div>" for p in parts)
    rows = [(1, "https://c.example/a", page(story)), (1, "https://c.example/a", page(story)), (2, "https://c.example/b", page(story))]
    rows += [(3, None, page(story)), (4, None, page(story, "and more")), (5, "no host", page(story))]
    rows += [(10 + i, f"https://h.example/{i}", page(menu, say(f"own{i}x", 10), *[shared] * (i < 2))) for i in range(12)]
    got = Counter((r.page_id, r.text) for r in pages_.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect())
    expected = [(1, story), (1, story), (2, story), (3, story), (4, f"{story}\nand more"), (5, story)]
    expected += [(10 + i, "\n".join([say(f"own{i}x", 10), *[shared] * (i < 2)])) for i in range(12)]
    assert got == Counter(expected)


def test_pipeline_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    labels = {r.doc_id: (r.quality, r.toxic) for r in common.table(spark, sf_dir, "labels").collect()}
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.Scratch(spark, "test").keep(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "quality":
            kept = {r.doc_id for r in docs.collect()}
            clean = [i for i, x in labels.items() if x == (1, 0)]
            assert sum(i in kept for i in clean) / len(clean) > 0.95
    assert sizes == sorted(sizes, reverse=True)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, pieces.collect()))


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]


def test_pages_of_any_shape_are_read_in_one_pass():
    """Half-open tags, unclosed quotes and deep nesting cost no more than their length."""
    import time

    began = time.process_time()
    for page in ("<a " * 300_000, '<a "' * 300_000 + ">", "<div>" * 100_000 + "x" + "</p></div>" * 100_000, "<article>" * 50_000, "<p class='" * 200_000, "<" * 500_000):
        pages_.blocks(page)
    assert time.process_time() - began < 20
    say = lambda body: "\n".join(pages_.blocks(f"<html><body><article><p>Main.</p>{body}</article></body></html>")[0])
    assert say("<div class='article-share'>Share it</div><div class='newsletter-body'>Sign up</div>") == "Main."
    assert say("<section id='search-engines'><p>How they work.</p></section>") == "Main.\nHow they work."
    assert say("<div class='search-form'>Find</div><p title='a > b'>More</p><p>1 < 2 & 3</p>") == "Main.\nMore\n1 < 2 & 3"
