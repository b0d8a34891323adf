"""Main text of pages: hand-made sites of several templates, a plain tree matching, odd markup."""

import functools
import random

import duckdb
import pytest

from loamworks.llm import queries, wrappers


@pytest.fixture(scope="session")
def site(spark):
    def make(rows):
        return spark.createDataFrame(rows, "page_id long, url string, html string")

    return make


def texts(df):
    return {r.page_id: r.text for r in wrappers.main_text(df).collect()}


def words(seed, n=30):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(n))


SEMANTIC = """<html><head><title>{h}</title><style>p{{}}</style></head><body class="has-sidebar"><header><h2>My site</h2></header>
<nav><ul><li><a href=/a>{x}</a><li><a href=/b>b</a></ul></nav><div class="cookie-notice">We use cookies {x}</div>
<main><article class=post><header><h1>{h}</h1></header><p>{a}<p class=ad>Buy {x}</p>{b} <b>bold</b><br>more</p>
<ul><li>{c}<li>second</ul><div class="share-buttons">Share {x}</div><section id=comments><h3>Comments</h3><p>Nice {x}</p></section></article>
<aside>Related {x}</aside></main><form action=/s><label>Mail</label><input><p>Subscribe {x}</form><footer>&copy; {x}</footer><script>if (a</b) "<p>"</script></body></html>"""


def test_marked_article(site):
    rows = [(k, "http://a.example/1", SEMANTIC.format(h=f"Head {k}", a=words(k), b=words(k + 50), c=words(k + 90, 4), x=words(k + 200, 3))) for k in range(4)]
    want = {k: "\n\n".join([f"Head {k}", words(k), words(k + 50) + " bold more", words(k + 90, 4), "second"]) for k in range(4)}
    assert texts(site(rows)) == want


PLAIN = """<body><div><a href=/>Home</a> <a href=/n>News</a></div><div>Welcome to the best site of all sites, friend.</div><div id=x1><h1>{h}</h1><div>{a}</div><div>{b}</div>
<div>All rights reserved by the company that made this.</div></div><div><a href=/{k}>{x}</a></div></body>"""


def test_template_is_what_is_constant(site):
    """No element is marked: what all pages show alike goes, and what is only links."""
    rows = [(k, "https://B.example:80/x", PLAIN.format(h=f"Head {k}", a=words(k), b=words(k + 50), x=words(k + 99, 3), k=k)) for k in range(5)]
    assert texts(site(rows)) == {k: f"Head {k}\n\n{words(k)}\n\n{words(k + 50)}" for k in range(5)}


def test_slots_are_aligned_over_shapes(site):
    """Pages with more or fewer elements share the slots that simple tree matching aligns."""
    parts = ["<div>Constant words of the template here.</div>", "<div class=a><p>{a}</p></div>", "<div class=b><h2>{h}</h2><p>{b}</p></div>", "<div>Another constant stretch of words.</div>"]
    rows = []
    for k in range(12):
        own = parts[:1] + parts[1 : 2 + (k % 3 > 0)] + ["<section><p>{c}</p></section>"] * (k % 2) + parts[3:]
        rows.append((k, "http://c.example/", ("<body>" + "".join(own) + "</body>").format(h=f"Head {k}", a=words(k), b=words(k + 50), c=words(k + 70))))
    got = texts(site(rows))
    for k in range(12):
        want = [words(k)] + [f"Head {k}", words(k + 50)] * (k % 3 > 0) + [words(k + 70)] * (k % 2)
        assert got[k] == "\n\n".join(want), k


def test_copies_keep_their_text(site):
    page = SEMANTIC.format(h="Same", a=words(1), b=words(2), c="x", x="y")
    rows = [(k, "http://d.example/", page.replace("&copy;", f"{k}")) for k in range(40)]
    assert set(texts(site(rows)).values()) == {"\n\n".join(["Same", words(1), words(2) + " bold more", "x", "second"])}


def test_plain_page_is_kept_whole(site):
    rows = [(1, "http://e.example/", "just words &amp; more\n\t words"), (2, None, "<p>a<p>b&nbsp; c<div>d</div>e"), (3, "odd", "<table><tr><td>x<td>y</table>")]
    assert texts(site(rows)) == {1: "just words & more words", 2: "a\n\nb c\n\nd\n\ne", 3: "x\n\ny"}


ODD = [
    (1, None, None), (2, "", ""), (3, "http://x/", "<<<>>> < <a <"), (3, "http://x/", "<<<>>> < <a <"), (None, "//h", "<p>t"), (4, "http://x/", "<div>" * 3000 + "deep" + "</div>" * 3000),
    (5, "http://x/", "<p>" + "word " * 200_000), (6, "http://x/", "<a <a <a" * 20_000), (7, "http://x/", '<p class="x>open'), (8, "http://x/", "<script>never ends <p>x"),
    (9, "http://x/", "a<!-- <p>no</p> -->b<!--- x"), (10, "http://x/", "<p>&#xD800;&#0;&bogus;&ampx &lt;i&gt;"), (11, "http://x/", "".join(f"<div class=c{chr(97 + k % 26)}x{chr(97 + k // 26 % 26)}>t</div>" for k in range(600))),
]


def test_odd_rows_and_clashing_columns(site, spark):
    df = site(ODD).selectExpr("*", "1 AS text", "2 AS n_chars", "3 AS key", "4 AS shape")
    rows = wrappers.main_text(df).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == len(ODD) and got[1] == got[2] == got[8] == "" and got[4] == "deep" and got[None] == "t"
    assert got[5] == " ".join(["word"] * 200_000) and got[9] == "ab" and got[10].endswith("&bogus;&x <i>")
    assert all(r.n_chars == len(r.text) for r in rows)
    assert wrappers.main_text(site([])).collect() == []


def test_tree_matching():
    """The alignment matches as many nodes as a plain recursion finds."""

    def tree(rnd, depth=0):
        return (rnd.choice("abc"), [tree(rnd, depth + 1) for _ in range(rnd.randint(0, 4 - depth))])

    def lines(t, depth=0):
        return [f"{depth} {t[0]}"] + [x for c in t[1] for x in lines(c, depth + 1)]

    def most(a, b):
        if a[0] != b[0]:
            return 0

        @functools.cache
        def rest(i, j):
            return 0 if i == len(a[1]) or j == len(b[1]) else max(rest(i + 1, j), rest(i, j + 1), most(a[1][i], b[1][j]) + rest(i + 1, j + 1))

        return 1 + rest(0, 0)

    rnd = random.Random(3)
    for _ in range(200):
        a, b = (("r", [tree(rnd) for _ in range(rnd.randint(0, 4))]) for _ in range(2))
        x, y = wrappers.Shape("\n".join(lines(a))), wrappers.Shape("\n".join(lines(b)))
        matches = wrappers.aligned(x, y)
        used = [m for m in matches if m >= 0]
        assert len(set(used)) == len(used) == most(a, b)
        assert all(m < 0 or (x.labels[k] == y.labels[m] and (k == 0 or matches[x.parents[k]] == y.parents[m])) for k, m in enumerate(matches))


def test_table_too_large_to_broadcast(site, monkeypatch):
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", 0)
    rows = [(k, "http://a.example/1", SEMANTIC.format(h=f"Head {k}", a=words(k), b="b", c="c", x="x")) for k in range(3)] + [(9, "u", "")]
    got = texts(site(rows))
    assert got[9] == "" and got[2].startswith(f"Head 2\n\n{words(2)}") and len(got) == 4


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '/root/testdata/{sf}/pages.parquet'")
    got = queries.op12_pages(spark, f"/root/testdata/{sf}").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(queries.OP12_SQL).fetchall())
