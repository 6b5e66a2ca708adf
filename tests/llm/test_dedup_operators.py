"""SimHash, embeddings, lines, components and pages against plain versions, hot groups and awkward rows."""

import numpy as np
import pytest
from oracle import difference, duck
from pyspark.sql import functions as F
from support import classes, close_fingerprints, simhash

from sparkwave.llm import caps, html_text, line_dedup, queries, simhash as op
from sparkwave.llm.common import Scratch
from sparkwave.llm.components import _state, components


# 4: SimHash
def expected_components(rows):
    rows = sorted((r for r in rows if r.doc_id is not None), key=lambda r: r.doc_id)
    fps = [simhash(r.text) for r in rows]
    root = classes(len(rows), close_fingerprints(fps))
    return {r.doc_id: (f"{f:016x}", rows[c].doc_id) for r, f, c in zip(rows, fps, root)}


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_fingerprints_and_components(which, request):
    rows = request.getfixturevalue(which)
    want, got = expected_components(rows.collect()), op.near_duplicates(rows).collect()
    assert len(got) == rows.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == want[r.doc_id]
    assert op.near_duplicates(rows.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [3, 50_000])
def test_no_link_is_lost_in_large_groups(spark, limit):
    rng = np.random.default_rng(limit)
    base = [int(v) for v in rng.integers(0, 1 << 62, 8)]
    fps = set(base)
    for _ in range(400):  # chains around few centres, and fingerprints that share many bits without linking
        x = base[int(rng.integers(8))]
        for b in rng.choice(64, int(rng.integers(1, 9)), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    table = spark.createDataFrame([(op.signed(f),) for f in fps], "fp long")
    scratch = Scratch(spark)
    links = op.links(scratch, table, group_limit=limit).collect()
    place = {op.signed(f): i for i, f in enumerate(fps)}
    assert all((((r.a ^ r.b) & op.ALL).bit_count()) <= 4 for r in links)
    assert classes(len(fps), [(place[r.a], place[r.b]) for r in links]) == classes(len(fps), close_fingerprints(fps))


def test_one_row_of_each_group_stays(docs, awkward):
    for rows in (docs, awkward):
        kept = op.retain_one(rows)
        assert kept.columns == rows.columns
        want = {c for _, c in expected_components(rows.collect()).values()}
        got = [r.doc_id for r in kept.collect()]
        assert sorted(i for i in got if i is not None) == sorted(want) and len(got) == len(set(got))
    assert op.retain_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [0, 500_000])
def test_repeated_rows_stay_once_however_they_are_joined(spark, limit):
    own = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha1(F.concat(F.col("id"), F.lit(i))) for i in range(6)]).alias("text"), F.create_map(F.lit("k"), F.col("id")).alias("my map"))
    none = spark.range(900).select(F.lit(None).cast("long").alias("doc_id"), F.lit("some words without any id at all").alias("text"), F.create_map(F.lit("k"), F.lit(7).cast("long")).alias("my map"))
    two = own.where("doc_id = 3").withColumn("text", F.lit("another text under an id that is taken already"))
    rows = own.unionByName(own.where("doc_id < 10")).unionByName(none).unionByName(two).repartition(7)
    got = op.retain_one(rows, broadcast_ids=limit).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted([*range(40), 3])
    assert [r.text for r in got if r.doc_id is None] == ["some words without any id at all"] and got[0]["my map"] is not None


def test_hot_keys_are_looked_up_apart(spark):
    from sparkwave.llm.common import lookup

    scratch = Scratch(spark)
    rows = scratch.save(spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k")))
    side = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = {r.id: r.v for r in lookup(scratch, rows, side, "k").collect()}
    assert got == {i: 0 if i % 3 == 0 else 2 * i if i < 5000 else None for i in range(6000)}


def test_a_third_of_all_rows_in_one_group(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the very same words again and again here")).otherwise(F.concat_ws(" ", *[F.sha1(F.concat(F.col("id"), F.lit(i))) for i in range(6)])).alias("text"))
    got = op.near_duplicates(rows).groupBy("component_id").count().orderBy(F.desc("count")).head(2)
    assert (got[0].component_id, got[0]["count"]) == (0, 1000) and got[1]["count"] == 1


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, j) for j in range(201, 260)] + [(300, 300), (None, 1)]
    got = {r.node: r.root for r in components(Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{j: 200 for j in range(200, 260)}}
    assert components(Scratch(spark), spark.createDataFrame([], "a long, b long")).count() == 0


def test_the_state_of_many_edges(spark):
    edges = spark.range(20_000_000, numPartitions=8).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    state = _state(edges)
    assert state[0] == 20_000_000 and state == _state(edges.repartition(3))
    assert state != _state(edges.withColumn("b", F.when(F.col("a") == 5, 7).otherwise(F.col("b"))))


# 6: embeddings
def clustered(n=600, dim=32, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    x = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.1, 0.3, 1.0], n)[:, None]
    x[: n // 3] = centres[0]  # one vector a third of all
    return x


def truth(x, least=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("limit", [2000, 40])
def test_links_are_right_and_nearly_all_found(spark, limit):
    x = clustered()
    got = {r.vec_id: r for r in caps.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), group_limit=limit).collect()}
    near = truth(x)
    found, every = sum(r.n_links for r in got.values()), int(near.sum())
    assert all(got[i].n_links <= near[i].sum() for i in got) and found >= 0.97 * every
    root = classes(len(x), [tuple(map(int, p)) for p in np.argwhere(np.triu(near))])
    assert all(got[i].component_id >= root[i] for i in got) and sum(got[i].component_id == root[i] for i in got) >= 0.97 * len(x)
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())


def test_group_limits_do_not_change_the_result(spark):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(300))], "vec_id long, embedding array<double>")
    assert sorted(caps.near_vectors(df, group_limit=7).collect()) == sorted(caps.near_vectors(df).collect())


def test_vectors_that_link_with_nothing(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, None), (1, []), (2, [0.0] * 8), (3, [1.0] * 8), (4, [1.0] * 8), (5, [2.0] * 8), (6, [nan] + [1.0] * 7), (7, [inf] + [1.0] * 7), (8, [None] + [1.0] * 7), (9, [1.0] * 9), (None, [1.0] * 8), (4, [1.0] * 8), (11, [-1.0] * 8), (12, [1e300] * 8)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, kept int, vec string")
    got = caps.near_vectors(df).collect()
    assert len(got) == len(rows)
    for r in got:
        linked = r.vec_id in (3, 4, 5, 12, None)
        assert r.n_links == (5 if linked else 0) and r.component_id == (3 if linked else r.vec_id)
    assert caps.near_vectors(df.limit(0)).count() == 0


def test_table_embeddings(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = np.array([r.embedding for r in df.orderBy("vec_id").collect()])
    assert sum(r.n_links for r in caps.near_vectors(df).collect()) == truth(x).sum()
    assert difference(queries.op6_embedding_near_dedup(spark, sf), queries.oracle_sql()["op6_embedding_near_dedup"], duck(sf)) == ""


# 7: lines
def test_line_dedup_equals_sql(spark, sf):
    assert difference(queries.op7_line_dedup(spark, sf), queries.oracle_sql()["op7_line_dedup"], duck(sf)) == ""


@pytest.mark.parametrize("few", [0, 200_000])
def test_boilerplate_is_dropped_by_host(spark, few):
    pages = [("a", f"home\n\nown {i}\n footer \t\r") for i in range(20)] + [("b", f"home\nother {i}\n" * (i % 2 + 1)) for i in range(4)] + [(None, f"home\n{i}") for i in range(6)] + [("c", None), ("a", ""), ("d", "the only\npage")]
    df = spark.createDataFrame([(h, t, 1, "old") for h, t in pages], "source string, text string, n_lines int, host string")
    got = line_dedup.drop_boilerplate(df, broadcast_lines=few).collect()
    assert len(got) == len(pages) and got[0].host == "old"
    texts = {(r.source, r.text, r.n_lines, r.n_dropped) for r in got}
    assert ("a", "\nown 3", 4, 2) in texts and (None, "2", 2, 1) in texts and ("c", None, 0, 0) in texts and ("a", "", 1, 0) in texts and ("d", "the only\npage", 2, 0) in texts
    assert ("b", "other 0\n", 3, 1) in texts  # a line on one page only stays
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def test_a_page_without_any_other_line_is_left_empty(spark):
    df = spark.createDataFrame([(i, "s", "only\nthese") for i in range(9)], "doc_id long, source string, text string")
    assert {(r.text, r.n_dropped) for r in line_dedup.drop_boilerplate(df).collect()} == {("", 2)}


def test_a_page_of_many_boilerplate_lines_takes_time_in_proportion(spark):
    from time import perf_counter

    page = "\n".join(f"line {i}" for i in range(20_000))
    df = spark.createDataFrame([(0, "s", page), (1, "s", page + "\n\nown"), (2, "t", page)], "doc_id long, source string, text string")
    began = perf_counter()
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_boilerplate(df).collect()}
    assert got == {0: ("", 20_000), 1: ("\nown", 20_000), 2: (page, 0)} and perf_counter() - began < 8


def test_a_hot_host_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOST_PAGES", 10)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"h{i % 30}", f"menu\nown {i}", i, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n long, _h string")
    kept = {r.doc_id: (r.text, r.n_dropped, r.n, r._h) for r in line_dedup.drop_boilerplate(df, broadcast_lines=0).collect()}
    assert kept == {i: (f"own {i}", 1, i, "x") for i in range(300)}
    from sparkwave.llm.common import fresh

    side = spark.createDataFrame([("hot", ["1:2"])], "_host string, _bad array<string>")
    parts = line_dedup.spread(df.withColumnRenamed("_h", "other"), side, F.col("source"), F.col("text"), "_host", "_part").where("source = 'hot'").groupBy("_part").count().collect()
    assert len(parts) == 10 and max(r["count"] for r in parts) < 30 and fresh(df, "_h") == ["__h"]


# 10: pages
LONG = "This is a long paragraph, with commas, and with enough words in it to be scored as content, surely."
PAGES = [
    (f"<body><nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>{LONG}<p>Second,\n\n  para<br>graph</article><footer>(c)</footer></body>", f"T & U\n\n{LONG}\n\nSecond, para graph"),
    (f"<div class='site-header'><a href=/>x</a></div><div class='content has-sidebar'><h2>H</h2><p>{LONG}</p><div class='ad-slot'>Buy</div><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div><div id=comments><p>{LONG}</p></div>", f"H\n\n{LONG}\n\n{LONG}"),
    (f"<main><p>{LONG}</p><form><p>Sub, scribe, now</p></form><div id=cookie-consent><p>{LONG}</p></div></main>", LONG),
    (f"<article><p>{LONG}</p><section class='comments'><article class='comment'><p>{LONG}</p></article></section></article>", LONG),
    (f"<article><script>var t = '</p>'; write('<p>no</p>')</script><style>p {{}}</style><p>{LONG}</p></article>", LONG),
    (f"<div><div><div><p>{LONG}</p></div><div><p>{LONG}</p><p>{LONG}</p></div></div></div><div class=footer>foot</div>", f"{LONG}\n\n{LONG}\n\n{LONG}"),
    (f"<table><tr><td class=nav><a href=a>a</a></td><td><p>{LONG}</p></td></tr></table>", LONG),
    ("<p>&#8364;&nbsp;5 &lt;b&gt; &notanentity;</p>", "€ 5 <b> ¬anentity;"),
    ("no tags at all", "no tags at all"),
    ("", ""),
    (None, ""),
    ("<nav>only <a href=x>links</a></nav>", ""),
    ("<div" * 3 + "<p>broken", None),
]


def test_pages(spark):
    rows = [(i, f"http://e.com/{i}", h, "x") for i, (h, _) in enumerate(PAGES)] + [(None, None, PAGES[0][0], None), (0, "http://e.com/0", PAGES[0][0], None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert len(got) == len(rows) and html_text.extract(df.limit(0)).count() == 0
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id is not None and PAGES[r.page_id][1] is not None:
            assert r.text == PAGES[r.page_id][1], PAGES[r.page_id][0]


@pytest.mark.parametrize(
    "html,text",
    [
        (f"<div class='layout sidebar-right'><article><p>{LONG}</p></article><div class=sidebar><p>{LONG}</p></div></div>", LONG),
        (f"<div id='page-with-sidebar'><p>{LONG}</p><p>{LONG}</p></div><div class=comments><p>{LONG}</p></div>", f"{LONG}\n\n{LONG}"),
        (f"<div class='search-page'><main><p>{LONG}</p></main></div><div class=related><p>{LONG}</p></div>", LONG),
        (f"<article><p>{LONG}</p><p class='share-price'>The price rose, by a tenth, in a day.</p><p class='share'>Share this, please, with all of your friends.</p></article>", f"{LONG}\n\nThe price rose, by a tenth, in a day."),
        (f"<article><p>{LONG}</p><p>{LONG}</p></article><div id=comments><article class=comment><p>{LONG}</p></article></div>", f"{LONG}\n\n{LONG}"),
        (f"<div class='menu-left'><p>{LONG}</p></div><div class='menu-right'><p>{LONG}</p></div>", f"{LONG}\n\n{LONG}"),
        (f"<main><p>Short.</p></main><div class=related><p>{LONG}</p></div>", "Short."),
        (f"<article><p>Lead.</p><div class='body sidebar-right'><p>{LONG}</p></div></article>", f"Lead.\n\n{LONG}"),
        ("<div class='search-results'>Few words</div>", "Few words"),
        ("<div class=ad>Buy</div>Few words", "Few words"),
        (f"<form action=/x><input name=state><div class=wrap><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div></form>", f"T\n\n{LONG}\n\n{LONG}"),
        (f"<article><p>{LONG}</p><form><p>{LONG}</p></form></article>", LONG),
        *[(f"<div class='{name}'><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div class=footer><p>{LONG}</p></div>", f"T\n\n{LONG}\n\n{LONG}") for name in ("page-with-sidebar", "layout-sidebar-right", "search-results", "content-related", "post share", "td-post-header")],
    ],
)
def test_names_do_not_take_the_article(html, text):
    assert html_text.main_text(html) == text


def test_long_and_deep_pages_end():
    assert html_text.main_text("<div>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 3000) == LONG
    assert len(html_text.main_text(f"<article>{f'<p>{LONG}</p>' * 5000}</article>")) == 5000 * (len(LONG) + 2) - 2


@pytest.mark.parametrize("n", [20_000])
def test_broken_pages_take_time_in_proportion(n):
    from time import perf_counter

    shapes = ["<p>" + "<span>" * n + LONG + "</b>" * n, "<i><p>" + "<span>" * n + LONG + "</i>" * n, "<div><p>" * n + LONG, "<ul>" + "<li>a" * n, f"<div class=ad>{LONG}</div><article><p>{LONG}</p></article>" * (n // 20), "<form>" * n + LONG, "<article><header>" * n + LONG]
    for html in shapes:
        began = perf_counter()
        html_text.main_text(html)
        assert perf_counter() - began < 3, html[:40]


@pytest.mark.parametrize("shape", ["<a ", '<a href="', "<!--", "<!-- x --", "<", "</", "<script>", "<a b='", "&#9", "&#" + "9" * 99_999, "&#x0", "<title>", "<![CDATA[", "<a =", "<p/", "<?", "<svg><a x=1 ", "&amp", "<!-->", "<b c=d e "])
def test_two_hundred_kilobytes_of_broken_tags_take_under_a_second(shape):
    from time import perf_counter

    page = (shape * (200_000 // len(shape) + 1))[:200_000]
    began = perf_counter()
    assert html_text.main_text(f"<article><p>{LONG}</p></article>" + page).startswith(LONG)
    assert perf_counter() - began < 1


REPLY = "I have read all of this, and I must say, it is rather longer than it had to be, as these things are."


@pytest.mark.parametrize(
    "html",
    [
        "<main><article>{}</article><ol class='comment-list'>{}</ol></main>",
        "<article>{}<div id='post-comments'>{}</div></article>",
        "<article>{}<div class='responses'>{}</div></article>",
        "<article>{}<div class='responses'><article>{}</article></div></article>",
        "<article>{}<div class='below'><article>{}</article></div></article>",
        "<div class=text>{}</div><div class='sidebar'>{}</div>",
        "<div class=text>{}</div><section class='comments'>{}</section>",
        "<main><article>{}</article><section class='comments'><article class=c-item>{}</article></section></main>",
        "<form><div class=text>{}</div><div class='comments'>{}</div></form>",
    ],
)
@pytest.mark.parametrize("times", [1, 8, 40])
def test_comments_and_sidebars_go_however_long_they_are(html, times):
    text = f"<h1>T</h1><p>{LONG}</p><p>{LONG} Second.</p>"
    assert html_text.main_text(html.format(text, f"<p>{REPLY}</p>" * times)) == f"T\n\n{LONG}\n\n{LONG} Second."


def test_tokens_of_odd_pages():
    got = list(html_text.tokens("a < b &lt;&#0065;&#99999999;<P CLASS=\"x>y\" id=q hidden/>t</P ><!-- <b> --!>u<script>if (a<b) '</p>'</script><title>&amp;<b></title></ >v<br"))
    assert got == [("data", "a < b <A\ufffd"), ("start", "p", [("class", "x>y"), ("id", "q"), ("hidden", "")]), ("data", "t"), ("end", "p"), ("data", "u"), ("start", "script", []), ("data", "if (a<b) '</p>'"), ("end", "script"), ("start", "title", []), ("data", "&<b>"), ("end", "title"), ("data", "v")]


def test_scores_equal_a_plain_recursion():
    rng = np.random.default_rng(6)
    tags = ["div", "p", "a", "b", "ul", "li", "section", "td", "pre", "span", "nav", "h2", "blockquote"]
    for _ in range(300):
        html, open_ = "", []
        for _ in range(int(rng.integers(1, 60))):
            kind = rng.random()
            if kind < 0.4:
                open_.append(str(rng.choice(tags)))
                html += f"<{open_[-1]}>"
            elif kind < 0.6 and open_:
                html += f"</{open_.pop()}>"
            else:
                html += " ".join(["word,", "a", "longer"][int(i)] for i in rng.integers(0, 3, int(rng.integers(1, 20))))
        tree = html_text.Tree()
        tree.feed(html)
        found = {id(n): n.score for n in html_text.score(tree.root)}
        want = {}

        def own(node):
            """Characters and commas of a node's inline text."""
            chars = commas = 0
            for x in node.inside:
                if isinstance(x, str):
                    text = " ".join(x.split())
                    chars, commas = chars + len(text), commas + text.count(",")
                elif not x.removed and x.tag not in html_text.BLOCKS:
                    a, b = own(x)
                    chars, commas = chars + a, commas + b
            return chars, commas

        def visit(node):
            chars, commas = own(node)
            scored = node.tag in html_text.SCORED
            if chars and (scored or node.tag in html_text.BLOCKS and chars >= 25):
                at = node.parent if scored else node
                for level in range(html_text.LEVELS):
                    if at is None:
                        break
                    share = 1 if level == 0 else 1 / 2 if level == 1 else 1 / (3 * level)
                    want[id(at)] = want.get(id(at), 0) + (1 + commas + min(chars / 100, 3)) * share
                    at = at.parent
            for x in node.inside:
                if not isinstance(x, str) and not x.removed:
                    visit(x)

        visit(tree.root)
        assert found.keys() == want.keys() and all(abs(found[k] - v) < 1e-9 for k, v in want.items()), html


def test_articles_of_the_pages_table(spark, sf):
    """Each page has one article element without furniture inside: its text is the answer."""
    import re
    from html import unescape

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        inside = re.search(r"<article>(.*)</article>", html[r.page_id], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", " " if "br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1|article)>", re.sub(r"<br>", " ", inside))]
        assert r.text == "\n\n".join(p for p in parts if p), r.page_id


@pytest.mark.parametrize("spread", [0.001, 0.004, 0.03])
def test_a_tight_cluster_of_a_third_is_compared_by_its_balls(spark, monkeypatch, spread):
    """Inside the cluster, to vectors at about the angle that links, and to the rest: no link too many, nearly all found."""
    rng = np.random.default_rng(int(spread * 1000))
    dim, n = 32, 900
    centre = rng.normal(size=dim)
    centre /= np.linalg.norm(centre)
    x = rng.normal(size=(n, dim))
    x[:300] = centre + rng.normal(size=(300, dim)) * spread / np.sqrt(dim)
    for i in range(300, 400):  # around the limit
        side = rng.normal(size=dim)
        side -= side @ centre * centre
        side /= np.linalg.norm(side)
        c = rng.uniform(0.945, 0.955)
        x[i] = c * centre + np.sqrt(1 - c * c) * side
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in caps.near_vectors(df, group_limit=50).collect()}
    near = truth(x)
    assert all(got[i].n_links <= near[i].sum() for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.98 * near.sum()
    inside = near[:300, :300]
    assert all(got[i].n_links >= inside[i].sum() for i in range(300))  # balls lose none of these
    root = classes(n, [tuple(map(int, p)) for p in np.argwhere(np.triu(near))])
    assert sum(got[i].component_id == root[i] for i in got) >= 0.97 * n


def test_a_cluster_costs_few_comparisons(spark):
    """A group of a filter holds balls: far fewer than the cluster's vectors."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 32))
    x[:500] = x[0] + rng.normal(size=(500, 32)) * 0.002
    seen = spark.sparkContext.accumulator(0)
    plain = caps._compared

    def counting(least):
        make = plain(least)

        def made():
            run = make()

            def counted(rows):
                def each():
                    for r in rows:
                        seen.add(1)
                        yield r

                return run(each())

            return counted

        return made

    caps._compared = counting
    try:
        got = caps.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    finally:
        caps._compared = plain
    assert sum(r.n_links for r in got) >= 500 * 499 and seen.value < 10_000  # 500 vectors under 60 filters would be 30,000
