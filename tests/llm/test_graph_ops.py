"""Url filter, components, vector search, pipeline, contracts of the queries."""

import random

import numpy as np
import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F
from rillflow.llm import oracle_sql, queries, registry, urlfilter, vptree
from rillflow.llm.components import components
from rillflow.llm.urlfilter import Rule


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300, i) for i in range(301, 360)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in list(up)}
    assert components(spark.createDataFrame([], "src string, dst string")).count() == 0


def page(url, canonical=None, refresh=None):
    return f'<html><head>{f"<link REL=canonical href={chr(34)}{canonical}{chr(34)}>" if canonical else ""}{f"<meta http-equiv=refresh content={chr(34)}0; url={refresh}{chr(34)}>" if refresh else ""}</head></html>'


def test_url_filter(spark):
    urls = ["https://Shop.Example.com/en/x?q#f", "http://www.example.com/en/", "http://a.net/es/1", "http://a.org/es/1", "http://notexample.com/en/a", "http://com", "ftp://b.org/x", "no scheme", None, "://", "http://x.org/?/en/", "http://a.b.example.com/en/z/"]
    rows = [(i, u, page(u), "clash") for i, u in enumerate(urls)]
    got = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string, rule string"), registry.RULES).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [
        ("shop.example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("a.net", "/es/1", "net/es/", "block"), ("a.org", "/es/1", None, "allow"),
        ("notexample.com", "/en/a", "com/", "allow"), ("com", "", None, "allow"), ("b.org", "/x", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("x.org", "/", None, "allow"), ("a.b.example.com", "/en/z/", "example.com/en/", "block"),
    ]


def test_redirects_propagate_blocks(spark):
    rules = [Rule("block", "bad.org", "/"), Rule("allow", "good.org", "/")]
    rows = [
        (1, "http://a.org/", page("", canonical="http://b.org/")), (2, "http://b.org/", page("", refresh="http://bad.org/x")), (3, "http://bad.org/x", ""), (4, "http://c.org/", ""),
        (5, "http://d.org/", page("", canonical="http://bad.org/y")), (6, "http://good.org/d", page("", canonical="http://d.org/")), (7, "http://e.org/", ""), (8, "http://bad.org/y", None), (9, "http://a.org/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://e.org/", "http://f.org/"), ("http://f.org/", "http://bad.org/x"), (None, "http://c.org/")], "src string, dst string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, rules, redirects=redirects).collect()}
    # 5 is an alias of an allowed url, too: the allow takes precedence; own rules always stand
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "block", 9: "block"}
    assert urlfilter.judge(pages.where("false"), rules).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(pages, rules, html_col=None).where("page_id = 1").collect()} == {"allow"}


def test_links_as_written(spark):
    """Relative and protocol-relative targets, character references, lists of relations, several tags."""
    rules = [Rule("block", "bad.org", "/")]
    link = lambda href, rel="canonical": f'<link rel="{rel}" href="{href}">'
    refresh = lambda content: f'<meta http-equiv="refresh" content="{content}">'
    rows = [
        ("http://a.org/1", link("//bad.org/1")), ("http://a.org/2", refresh("0; url=//bad.org/2")), ("http://a.org/3", link("http://b.org/?x=1&amp;y=2")), ("http://b.org/?x=1&y=2", link("//bad.org/3")),
        ("http://a.org/4", link("http://bad.org/4", "alternate canonical")), ("http://a.org/5", link("http://a.org/5") + link("http://bad.org/5")), ("http://a.org/d/6", link("../1")),
        ("http://a.org/7", refresh("5") + refresh("0;URL='/1'")), ("http://a.org/8", '<base href="http://bad.org/d/">' + link("x")), ("http://a.org/9", refresh("0, http://bad.org/9")),
        ("http://c.org/1", link("/2")), ("http://c.org/2", refresh("3") + link("mailto:x") + link("http://[x")), ("http://c.org/3", link("//bad.org/", "canonical-x")), ("http://c.org/4", link("/go?u=http://bad.org/")),
    ]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    assert urlfilter.page_links("http://a.org/1", "<![x]><![y" + link("2") + link("/3")) == ["http://a.org/3"]
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, rules).collect()}
    assert got == {i: "allow" if "c.org" in u else "block" for i, (u, _) in enumerate(rows)}


def test_links_and_sql(spark):
    """The contract's rules over pages with links, against SQL."""
    import duckdb

    r = random.Random(11)
    hosts = ["example.com", "www.example.com", "a.net", "b.net", "c.org", "d.org", "e.info"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("/en/1", "/es/1", "/fr/x?a=1&b=2", "/", "/de/3")]

    def link():
        to = r.choice(urls)
        to = r.choice((to, to[5:], to[to.index("/", 7) :], to.replace("&", "&amp;")))
        kind = r.random()
        if kind < 0.4:
            return f'<link rel="{r.choice(("canonical", "alternate canonical", "CANONICAL"))}" href="{to}">'
        if kind < 0.5:
            return f"<link href='{to}' rel=canonical>"
        if kind < 0.8:
            return f'<META HTTP-EQUIV="Refresh" content="0; url={to}">'
        return r.choice((f'<!-- <link rel="canonical" href="{to}"> -->', f'<script>"<link rel=canonical href={to}>"</script>', f'<link rel="stylesheet" href="{to}">', ""))

    rows = [(i, u, f"<html><head>{''.join(link() for _ in range(r.choice((0, 0, 0, 1, 2))))}</head><body>x</body></html>") for i, u in enumerate(urls)]
    pages = spark.createDataFrame([*rows, (900, None, "x"), (901, "no scheme", link())], "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    got = urlfilter.judge(pages, registry.RULES).toPandas()
    assert same_rows(got, con.execute(registry.OP2_SQL).df())
    assert urlfilter.page_edges(pages, "url", "html").count() > 8


def brute(vectors, queries_, k):
    ids = sorted(vectors)
    v = np.array([vectors[i] for i in ids], float)
    n = np.sqrt((v * v).sum(axis=1))
    out = {}
    for q in queries_:
        a = ids.index(q)
        s = (v * v[a]).sum(axis=1) / (n * n[a])
        order = sorted((-x, i) for x, i in zip(s, ids, strict=True) if i != q)[:k]
        out[q] = [(i, -x) for x, i in order]
    return out


def test_search(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD", 150)
    r = np.random.default_rng(4)
    vectors = {i: r.normal(size=8).tolist() for i in range(1, 500)} | {i: [float(x) for x in range(1, 9)] for i in range(500, 620)}
    bad = [(900, None), (950, [0.0] * 8), (1000, [float("nan")] * 8), (1050, [1.0, None] + [1.0] * 6), (1100, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "c") for i, v in vectors.items()] + [(i, v, "c") for i, v in bad], "vec_id long, embedding array<double>, score string")
    want = brute(vectors, [i for i in vectors if i % 50 == 0], 5)
    for factor, least in ((1.0, 1.0), (vptree.FACTOR, 0.9)):
        got: dict = {}
        for x in vptree.nearest(df, F.col("vec_id") % 50 == 0, 5, factor=factor).orderBy("query_id", "rank").collect():
            got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
        assert set(got) == set(want)
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert hits >= least * 5 * len(want)
        if factor == 1.0:
            assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]]) for q in want)
    assert vptree.nearest(df.where("vec_id in (50, 51)"), F.col("vec_id") % 50 == 0).count() == 1
    assert vptree.nearest(df.where("vec_id = 50"), F.col("vec_id") % 50 == 0).count() == 0
    assert vptree.nearest(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("factor", [1.0, vptree.FACTOR])
def test_search_ties_and_repeated_ids(spark, factor):
    """Parallel vectors are ties by id; equal rows count once; a repeated id's rows are neighbours of each other."""
    get = lambda rows: [tuple(x) for x in vptree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5, factor=factor).orderBy("query_id", "rank", "vec_id").collect()]
    one = [0.25, -3.0, 1.5]
    assert [(r, i, s) for _, r, i, s in get([(i, [x * 2.0 ** (i % 7 - 3) for x in one]) for i in range(40)])] == [(i, i, 1.0) for i in range(1, 6)]
    big = [(i, [x * 2.0**600 for x in one]) for i in (3, 2, 1)] + [(0, one)]
    assert [(r, i, s) for _, r, i, s in get(big)] == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)]
    repeated = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [2.0, 0.0]), (7, [1.0, 1.0])]
    got = get(repeated)
    assert len(got) == 9 and sorted(i for _, r, i, _ in got if r == 1) == [7, 50, 50]
    want = sorted(brute({i: [float(i % 13 - 6), 1.0, float(i * i % 7)] for i in range(200)}, range(0, 200, 50), 5).items())
    if factor == 1.0:
        got = get([(i, [float(i % 13 - 6), 1.0, float(i * i % 7)]) for i in range(200)])
        assert [(q, i) for q, _, i, _ in got] == [(q, i) for q, best in want for i, _ in best]


def test_tree_prunes():
    r = np.random.default_rng(1)
    low = r.normal(size=(5000, 2))
    unit = np.column_stack([np.cos(low[:, 0]) * np.cos(low[:, 1]), np.sin(low[:, 0]) * np.cos(low[:, 1]), np.sin(low[:, 1])])
    tree = vptree.VpTree(np.arange(5000), unit, 4)
    score, i = tree.search(np.arange(50), unit[:50], 1.0)
    full, tree.compared = tree.compared, 0
    tree.search(np.arange(50), unit[:50], 0.3)
    exact = unit[:50] @ unit.T
    exact[np.arange(50), np.arange(50)] = -2
    assert np.allclose(score, -np.sort(-exact, axis=1)[:, :4]) and np.allclose(np.take_along_axis(exact, i, 1), score)
    assert tree.compared < full < 50 * 5000 / 4


def test_queries_and_sql(spark, duck):
    own = queries()
    assert {k.split("_")[0] for k in own if k.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in own
    assert set(oracle_sql()) <= set(own)
    for name, sql in oracle_sql().items():
        assert same_rows(own[name](spark, SF).toPandas(), duck.execute(sql).df()), name


def test_search_query_recall(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want = brute(rows, [i for i in rows if i % 50 == 0], 5)
    got: dict = {}
    for x in registry.op1_vantage_point_trees(spark, SF).collect():
        got.setdefault(x["query_id"], set()).add(x["vec_id"])
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality", "near_duplicates", "secrets", "packing"]
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        nxt = stage(spark, kept, SF)
        assert nxt.columns == docs.columns and nxt.dtypes == docs.dtypes, name
        kept = spark.createDataFrame(nxt.toPandas(), docs.schema)
        assert kept.count() > 0
    from rillflow.llm.secrets import scan

    assert all(not [s for s in scan(r["text"]) if s[1] < 3] and len(r["text"]) == r["n_chars"] for r in kept.collect())
    packed = cp.packing(spark, kept, SF)
    ids = {r["doc_id"] for r in kept.collect()}
    assert {r["doc_id"] for r in packed.collect()} == ids
    odd = docs.limit(3).unionByName(spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "s", 0)], docs.schema))
    for name, stage in cp.STAGES:
        assert stage(spark, odd, SF).count() >= 0, name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
