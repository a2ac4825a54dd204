"""URL parsing, rules and alias groups against plain Python."""
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from panelquant.llm import queries, url_filters as U
from panelquant.llm.common import components
from panelquant.llm.queries import RULES

URLS = [None, "", "no scheme.net/x", "http://A.example.NET/en/x", "http://example.net/en/", "http://example.net/EN/", "http://example.net", "http://xexample.net/en/", "https://example.com/de/1?q#f", "https://m.example.com/de", "http://a.org/fr/?x",
        "http://org/fr/", "http://org", "ftp://u@h.net:80/p", "http://x://y.net/z", "http://net?a/b", "http://net#f", "http:///p", "://net/", "http://É.net/", "http://example.com/de/\nq", "http://a.b.example.net./en/", "http://sub.net.org/fr/a"]


def parse(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
    path = rest[k:]
    m = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return host, path[:m]


def ruled(host, path):
    fit = [(len(h) + len(p), len(h), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2:] if fit else (None, None)


def brute(pages, links):
    nodes = {n for e in links for n in e}
    comp = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            low = min(comp[a], comp[b])
            comp[a] = comp[b] = low
    said = {}
    for n in nodes:
        v = ruled(*parse(n))[1]
        if v:
            said.setdefault(comp[n], set()).add(v)
    out = []
    for i, u in pages:
        host, path = parse(u)
        rule, v = ruled(host, path)
        n = None if u is None or "://" not in u else u.split("://", 1)[0].lower() + "://" + host + u.split("://", 1)[1][len(host):].split("#", 1)[0]
        group = said.get(comp.get(n), set())
        out.append((i, host, path, rule, v or ("allow" if "allow" in group or not group else "block")))
    return sorted(out, key=str)


@pytest.mark.parametrize("inline", [200, 0])
def test_rules_and_aliases(spark, monkeypatch, inline):
    monkeypatch.setattr(U, "INLINE_RULES", inline)
    pages = list(enumerate(URLS)) + [(None, URLS[3]), (3, URLS[3]), (100, "http://alias.io/1"), (101, "http://alias.io/2#f"), (102, "http://other.io/"), (103, "http://both.io/?z"), (104, "http://chain.io/9"), (105, "http://loop.io/")]
    links = [("http://alias.io/1", "http://alias.io/2"), ("http://alias.io/2", "http://bad.net/"), ("http://other.io/", "http://example.net/en/q"), ("http://both.io/?z", "http://bad.net/2"), ("http://both.io/?z", "http://w.org/fr/1"),
             ("http://loop.io/", "http://loop.io/"), ("http://example.com/de/1?q", "http://c.io/")] + [(f"http://chain.io/{k}", f"http://chain.io/{k + 1}") for k in range(12)] + [("http://chain.io/12", "http://z.net/")]
    p = spark.createDataFrame([(*r, "h", "v") for r in pages], "page_id long, url string, host string, verdict string")
    e = spark.createDataFrame([*links, (None, "x")], "src string, dst string")
    got = U.judge_urls(p, RULES, e)
    assert sorted(map(tuple, got.collect()), key=str) == brute(pages, links)
    assert sorted(map(tuple, U.judge_urls(p, RULES, e.where("false")).collect()), key=str) == brute(pages, [])
    assert U.judge_urls(p.where("false"), RULES, e).count() == 0
    assert {r["verdict"] for r in U.judge_urls(p, [], e.where("false")).collect()} == {"allow"}


def test_links_from_tags(spark):
    html = [("http://A.x/1#t", "<head><LINK href='http://b.x/?q#f' rel=canonical><meta http-equiv=\"refresh\" content=\"0; url=https://C.x/\"></head>"), ("http://a.x/2", "<link rel='stylesheet' href='http://n.x/'>"), ("http://a.x/3", None),
            ("http://a.x/4", "<link rel=\"canonical\" href=\"/relative\">"), (None, "<link rel=canonical href=http://b.x/>"), ("http://a.x/5", "<link rel=canonical href=http://A.x/5>")]
    p = spark.createDataFrame(html, "url string, html string")
    assert sorted(map(tuple, U.links_from_html(p).collect())) == [("http://a.x/1", "http://b.x/?q"), ("http://a.x/1", "https://c.x/")]


def test_targets_are_resolved_and_decoded(spark):
    from urllib.parse import urljoin

    targets = ["/r", "//C.y/q", "e", "../e?x=1", "./", "..", "../../../z", "?only=1", "#f", "http://o.z/a#b", "mailto:a@b", "/n?to=http://k.l/", "a/./b/../c"]
    bases = ["http://a.x/p/q/r?s#t", "https://a.x", "http://a.x/"]
    rows = [(b, f"<link rel=canonical href='{t}'>") for b in bases for t in targets]
    want = set()
    for b, t in [(b, t) for b in bases for t in targets if t not in ("#f", "mailto:a@b")]:
        node = lambda u: u.split("#")[0].replace("C.y", "c.y")
        if node(b) != node(urljoin(b, t)):
            want.add((node(b), node(urljoin(b, t))))
    got = {tuple(r) for r in U.links_from_html(spark.createDataFrame(rows, "url string, html string"), resolve=True).collect()}
    assert got == want
    text = ["a&amp;b", "&#38;amp;", "&#x26;c&#233;&#x1F600;!", "&lt;&gt;&quot;&apos;", "&nope;&&#0;&#xD800;", ""]
    d = spark.createDataFrame([(t,) for t in text], "t string").select("t", U.decoded(F.col("t")).alias("u"))
    assert {r["t"]: r["u"] for r in d.collect()} == dict(zip(text, ["a&b", "&amp;", "&cé😀!", "<>\"'", "&nope;&&#0;&#xD800;", ""]))


def test_op10_follows_real_links(spark, tmp_path):
    """Aliases by a relative target with an entity, a protocol-relative one, a second tag and a base tag, through the query."""
    pages = [(1, "http://a.io/x/1", '<link rel="canonical" href="../y?a=1&amp;b=2">'), (2, "http://a.io/y?a=1&b=2", '<meta http-equiv="refresh" content="0; url=//bad.net/z">'),
             (3, "http://b.io/", '<link rel=canonical href="http://b.io/"><link rel=canonical href="http://bad.net/2">'), (4, "http://c.io/p", '<base href="http://bad.net/q/"><link rel=canonical href="r">'),
             (5, "http://d.io/", "<p>none</p>"), (6, "http://e.io/m/n", '<link rel=canonical href="/k">'), (7, "http://e.io/k", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["verdict"] for r in queries.op10(spark, str(tmp_path)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow"}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000 + k) for k in range(1, 50)] + [(None, 1), (5, 5)]
    comp = {}
    find = lambda x: x if comp.setdefault(x, x) == x else find(comp[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            comp[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {x: find(x) for x in comp}


def test_twins_on_given_tables(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for n in ("op4_raking_mix", "op7_warc", "op8_decontamination", "op10_url_filters"):
        cur = con.execute(queries.SQL[n])
        cols = [x[0] for x in cur.description]
        got = queries.QUERIES[n](spark, d)
        assert sorted(got.columns) == sorted(cols)
        assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(cur.fetchall(), key=str), n
