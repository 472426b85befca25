"""Search, page text and chat formatting."""

import numpy as np
import pytest

from sightline.llm import chat, html_text, multi_index
from sightline.llm import queries as Q

from ..conftest import SF_MID, SF_SMALL
from . import brute


def nearest(rows, queries, k):
    """Exact answers over valid vectors."""
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], float)
    out = {}
    for q in queries:
        if q in rows:
            d = np.sqrt(((x - np.array(rows[q], float)) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
            out[q] = [(r + 1, int(ids[j]), float(d[j])) for r, j in enumerate(order)]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_search_recall_and_scores(spark):
    e = spark.read.parquet(f"{SF_MID}/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in e.collect()}
    got = found(Q.op1_inverted_multi_index(spark, SF_MID))
    want = nearest(rows, [i for i in rows if i % 100 == 0], 10)
    assert got.keys() == want.keys()
    hits = 0
    for q, v in got.items():
        assert [r for r, _, _ in v] == list(range(1, 11))
        assert [(s, i) for _, i, s in v] == sorted((s, i) for _, i, s in v)
        x = np.array(rows[q], float)
        assert all(abs(s - np.sqrt(((np.array(rows[i], float) - x) ** 2).sum())) < 1e-9 for _, i, s in v)
        hits += len({i for _, i, _ in v} & {i for _, i, _ in want[q]})
    assert hits / (10 * len(got)) >= 0.9


def test_search_edge_vectors(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100, 140)]  # one point many times
    rows = [(0, [1.0, 0.0, 0.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0, 0.0, 0.0]), (4, [nan, 1.0, 1.0, 1.0]),
            (5, [1.0, None, 1.0, 1.0]), (6, [inf, 1.0, 1.0, 1.0]), (7, [1.0, 1.0]), (8, [2.0, 0.0, 0.0, 0.0]),
            (8, [2.0, 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (9, [-0.0, 0.0, 1.0, 0.0]), *same]
    e = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, cell int")
    ok = {i: v for i, v in rows if i in (0, 8, 9) or (i or 0) >= 100}
    assert found(multi_index.search(e, e, k=10)) == nearest(ok, list(ok), 10)
    # Large cells are split over shards, and few candidates are all returned.
    assert found(multi_index.search(e, e, k=10, shard=2)) == nearest(ok, list(ok), 10)
    few = e.filter("vec_id in (0, 8, 9)")
    assert found(multi_index.search(few, few.filter("vec_id = 0"), k=10)) == nearest({i: ok[i] for i in (0, 8, 9)}, [0], 10)
    assert multi_index.search(e.filter("vec_id < 0"), e, k=10).count() == 0
    assert multi_index.search(e, e.filter("vec_id = 3"), k=10).count() == 0


def test_search_among_vectors_of_several_lengths(spark):
    """Queries whose commonest length is not that of the index."""
    rng = np.random.default_rng(3)
    rows = {i: rng.normal(size=3 if i % 10 == 0 else 4).tolist() for i in range(300)}
    e = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got = found(multi_index.search(e, e.filter("vec_id % 10 = 0 or vec_id = 7"), k=5, recall=1.0))
    want = {}
    for d in (3, 4):
        part = {i: v for i, v in rows.items() if len(v) == d}
        want |= nearest(part, [i for i in part if i % 10 == 0 or i == 7], 5)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(1)
    a, b, counts = rng.random(7), rng.random(5), rng.integers(0, 4, 35)
    cells = multi_index.walk(a, b, counts, int(counts.sum()))
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sums == sorted(sums) and sorted(cells) == np.flatnonzero(counts).tolist()
    part = multi_index.walk(a, b, counts, 10)
    assert part == cells[:len(part)] and counts[part].sum() >= 10 > counts[part[:-1]].sum()


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>x</article>";</script><style>p{{}}</style></head>
<body class="home"><header id="top"><a href="/">Site</a></header><nav><ul><li><a href="/a">Home</a></li><li><a>More</a></ul></nav>
<div class="cookie-notice">We use cookies</div><{main}><h1>Big &amp; small</h1><p>One <b>bold
 word</b> here.<p>Two&nbsp;&lt;tags&gt;<br>after break<ul><li>item</li></ul>
<form><input name=q><label>Search</label></form><aside>Related things to read now</aside>
<pre>code  text</pre></{main}><div class="comments"><p>Nice article by a reader!</p></div><div id="sidebar"><p>Links</p></div>
<footer>&copy; us</footer></body></html>"""
TEXT = "Big & small\nOne bold word here.\nTwo <tags> after break\nitem\ncode text"


@pytest.fixture(scope="module")
def weights(spark):
    return html_text.fit(spark.read.parquet(f"{SF_MID}/pages.parquet"))


@pytest.mark.parametrize("main", ["article", "main"])
def test_main_text_of_a_page(weights, main):
    assert html_text.main_text(PAGE.format(main=main), weights) == TEXT


def test_main_text_without_a_mark(weights):
    """Nothing says that the element is the content: words decide."""
    body = "".join(f"<p>Paragraph {k} of the story with some words.</p><ul><li>A point in a list of many words.</ul>" for k in range(4))
    page = PAGE.replace("{{", "{").replace("}}", "}").replace("<{main}>", f"<div><h1>Title</h1>{body}</div>", 1)
    got = html_text.main_text(page[:page.index("<h1>Big")] + page[page.index('<div class="comments"'):], weights).split("\n")
    assert got[0] == "Title" and got[-1] == "A point in a list of many words." and len(got) == 9


def test_main_text_of_odd_pages(weights):
    get = lambda h: html_text.main_text(h, weights)
    assert get("") == "" and get("<nav>a b c</nav>") == "" and get("<!-- x -->") == ""
    assert get("<article><p>cut off here <b>no") == "cut off here no"
    assert get("<article><p>text &amp</p><p>more</p") == "text &\nmore"
    assert get("<article><p>text <a href='x") == "text"
    assert get("just words without markup") == "just words without markup"


@pytest.mark.parametrize("before,after", [
    ("<body class='single has-sidebar'>", "</body>"), ("<body><div id=wrapper class='with-sidebar'>", "</div></body>"),
    ("<body><form id=aspnetForm>", "</form></body>"), ("<body class=has-sidebar><form><div class='navbar-fixed'>", "</div></form></body>")])
@pytest.mark.parametrize("main", ["article", "main class='comments-enabled'", "article class='post tag-social'", "div class=post"])
def test_elements_around_the_content_do_not_set_it_apart(weights, before, after, main):
    """Names of wrappers say what else a page has; boxes inside still go, and
    so do comments that are articles."""
    text = "".join(f"<p>Paragraph {k} of the story with some ordinary words.</p>" for k in range(6))
    page = (f"<html>{before}<div class=sidebar><p>Other stories here</p></div><{main}><h1>Title</h1>{text}"
            f"<div class=share><p>Share this</p></div></{main.split()[0]}>"
            f"<div id=comments><article class='comment-body'><p>First!</p></article></div>{after}</html>")
    if main.startswith("div"):
        page = page.replace("article", "div")
    want = ["Title", *(f"Paragraph {k} of the story with some ordinary words." for k in range(6))]
    assert html_text.main_text(page, weights).split("\n") == want
    if not main.startswith("div"):
        got = html_text.count_kinds(page)
        assert sum(n for (k, inside), n in got.items() if inside and k.startswith("word p in content")) == 6 * 9


def test_weights_of_whole_kinds_and_distinct_pages(spark):
    """A cap keeps or drops both sides of a kind; copies of a page count once."""
    page = "<html><p>one two</p><article><p>one two three four five</p></article></html>"
    other = "<html><div>a b c d e f g h</div><article><h2>x</h2></article></html>"
    fit = lambda pages, **k: html_text.fit(spark.createDataFrame([(h,) for h in pages], "html string"), **k).of
    whole = fit([page, other])
    assert fit([page] * 40 + [other]) == whole
    for most in range(1, len(whole)):
        got = fit([page, other], most=most)
        assert len(got) == most and got == {k: whole[k] for k in got}


def test_pages_query_equals_marked_content(spark):
    import re
    from html import unescape
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_MID}/pages.parquet").collect()}
    got = Q.op6_html_main_text(spark, SF_MID).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"(?s)<article>(.*)</article>", pages[r.page_id].html)[1].replace("<br>", " ")
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_page_edge_rows(spark):
    rows = [(1, "u", None), (None, None, "<p>hello there</p>"), (1, "u", PAGE.format(main="article")), (2, "v", "")]
    pages = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, text string, kind string")
    got = sorted((repr(r.page_id), r.url, r.text) for r in html_text.extract(pages).collect())
    assert [g[:2] for g in got] == sorted((repr(i), u) for i, u, _ in rows) and (repr(1), "u", "") in got
    assert html_text.extract(pages.limit(0)).count() == 0


def test_best_run():
    assert html_text.best_run([-1, 2, -1, 3, -5, 3]) == (1, 4)
    assert html_text.best_run([-1, -2]) == (0, 0) and html_text.best_run([]) == (0, 0)


def turns(conv, items):
    return [(conv, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(items)]


def test_chat_snapshots(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 3)  # several segments in short conversations
    long = [f"t{k}" for k in range(11)]
    rows = [*turns(1, long[:2]), *turns(2, long[:4]), *turns(3, long), *turns(4, long), *turns(5, long[:3] + ["other"]),
            *turns(6, ["alone"]), *turns(7, ["alone"]), (8, None, None, None), (9, 5, "user", "t0"), (9, 7, "assistant", "t1"),
            (None, 0, "user", "t0"), (10, 0, "user", "t0"), (10, 0, "user", "t0"), (10, 0, "assistant", "tie"),
            *turns(11, long[:5] + [""])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows],
                               "conv_id long, turn long, role string, text string, segment string, pos int, a int")
    want = brute.maximal_conversations(rows)
    out = chat.chat_documents(df).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.conv_id, r.segment)):
        got[r.conv_id] = got.get(r.conv_id, "") + r.text
    assert got == {c: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in v) for c, v in want.items()}
    assert {r.conv_id: r.copies for r in out}[3] == 2 and {r.conv_id: r.n_turns for r in out}[3] == 11
    assert chat.chat_documents(df.limit(0)).count() == 0


def test_chat_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").collect()]
    assert {r.conv_id for r in Q.op7_chat_snapshots(spark, SF_SMALL).collect()} == set(brute.maximal_conversations(rows))


@pytest.mark.parametrize("key", sorted(Q.ORACLE))
def test_query_matches_sql(spark, key):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    rel = con.sql(Q.ORACLE[key])
    cols, rows = rel.columns, rel.fetchall()
    df = Q.QUERIES[key](spark, SF_SMALL).select(*cols)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(rows, key=repr)
