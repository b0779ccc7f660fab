"""URL filters against their SQL, and link scores against plain sums."""

import random
from collections import Counter

import pytest
from helpers import same_rows

from lacuna.llm import url_filter
from lacuna.llm.url_filter import DAMPING, UNIT

SCHEMA = "page_id long, url string, html string"


def anchors(*targets):
    return "<p>" + "".join(f'<A class="x" href = "{t}">t</a>' for t in targets)


def web(rng):
    """Hosts of every kind with links among them, hot hosts and odd addresses."""
    hosts = [f"{a}{n}.{b}" for a in ("www.s", "m.t", "k") for n in range(9) for b in ("example.net", "example.com", "fr.org", "deep.example.org", "else.io")]
    rows = []
    for k in range(900):
        host = hosts[0] if k % 3 == 0 else rng.choice(hosts)
        path = rng.choice(("/en/1", "/de/2?a=/fr/", "/fr/3#x", "", "?q", "/", "#/en/"))
        to = [f"{rng.choice(('https:', 'HTTP:', ''))}//{rng.choice(hosts).title()}/p" for _ in range(rng.randrange(4))]
        rows.append((k, f"{rng.choice(('http', 'x'))}://{host.upper() if k % 7 == 0 else host}{path}", anchors(*to, "/own", "#top", f"//{host}/self")))
    rows += [(1000, None, None), (1001, "", ""), (1002, "no scheme.net/", anchors("//sink.dev")), (1003, "a://net/x\ny", "<a href=//x.io"), (1003, "a://net/x\ny", "<a href=//x.io"), (1004, "http://é.ORG/fr/\n?", "<a href='//" + "z" * 200_000 + "'>" * 3), (None, "://org/fr/", None)]
    return rows


def view(duck, spark, rows):
    import duckdb

    con = duckdb.connect()
    con.register("pages_arrow", spark.createDataFrame(rows, SCHEMA).toArrow())
    con.execute("CREATE VIEW pages AS SELECT * FROM pages_arrow")
    return con


@pytest.mark.parametrize("few", [url_filter.FEW_HOSTS, 0])
def test_linked_pages_against_sql(spark, duck, monkeypatch, few):
    monkeypatch.setattr(url_filter, "FEW_HOSTS", few)
    rows = web(random.Random(1))
    got = same_rows(url_filter.judge(spark.createDataFrame(rows, SCHEMA)), view(duck, spark, rows), url_filter.OP11_SQL)
    assert len(got) == len(rows)
    by_links = Counter(r[-1] for r in got if r[4] is None)
    assert by_links["block"] > 20 and by_links["allow"] > 20


def test_scores_against_plain_sums(spark):
    rng = random.Random(6)
    links = list({(f"h{rng.randrange(12)}", f"h{rng.randrange(12)}") for _ in range(30)})
    links = [(a, b, rng.randrange(1, 5)) for a, b in links if a != b]
    seeds = [("h0", 1), ("h1", 1), ("h2", -1), ("alone", -1)]
    want = {}
    for side in (1, -1):
        ways = [(a, b, n) if side == 1 else (b, a, n) for a, b, n in links]
        of = Counter()
        for a, _, n in ways:
            of[a] += n
        start = {h: UNIT for h, s in seeds if s == side}
        scores = dict(start)
        for _ in range(20):
            new = Counter(start)
            for a, b, n in ways:
                new[b] += int(DAMPING * float(scores.get(a, 0)) * (n / of[a]))
            scores = new
        for h, x in scores.items():
            if x:
                want.setdefault(h, {1: 0, -1: 0})[side] = x
    got = url_filter.propagate(spark.createDataFrame(links, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, side int"))
    assert {r.host: {1: r.trust, -1: r.distrust} for r in got.collect()} == want


def test_farm_and_friends(spark):
    """Who links to blocked hosts is blocked, who is linked by trusted ones is not."""
    rows = [(k, f"http://spam{k}.net/x", None) for k in range(4)] + [(10 + k, f"http://good{k}.org/fr/", anchors("http://friend.io/")) for k in range(3)]
    rows += [(20, "http://farm.io/a", anchors(*(f"http://spam{k}.net/" for k in range(4)))), (21, "http://friend.io/b", anchors("//spam0.net/")), (22, "http://plain.io/c", anchors("http://farm.io/x"))]
    rows += [(23, "http://far.io/c", anchors("http://a.io", "http://b.io"))]
    out = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: out[k].verdict for k in (0, 10, 20, 21, 22, 23)} == {0: "block", 10: "allow", 20: "block", 21: "allow", 22: "block", 23: "allow"}
    assert out[21].trust > out[21].distrust > 0


def test_rules(spark):
    urls = ["http://a.example.net/en/1", "http://example.net/en", "http://xexample.net/en/1", "http://b.example.com/de/9", "http://example.com/DE/9", "http://net/", "http://net", "ftp://u@x.NET:80/", "http://a.org/fr/?x"]
    got = {r.url: (r.rule, r.host, r.path) for r in url_filter.judge(spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], SCHEMA), keep=("url",)).collect()}
    assert [got[u][0] for u in urls] == ["example.net/en/", "net/", "net/", "example.com/de/", None, "net/", None, None, "org/fr/"]
    assert got["ftp://u@x.NET:80/"][1:] == ("u@x.net:80", "/")
    with pytest.raises(ValueError):
        url_filter.rule_fit([("block", f"h{k}", "/") for k in range(url_filter.MOST_RULES + 1)])


def test_edges(spark):
    empty = url_filter.judge(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == []
    clash = spark.createDataFrame([(1, "http://a.net/", None, "h", 7, "r")], f"{SCHEMA}, host string, path int, rule string")
    assert [tuple(r) for r in url_filter.judge(clash).collect()] == [(1, "a.net", "/", "net/", 0, UNIT, "block")]


def test_no_python_on_the_main_path(spark, data):
    plan = url_filter.op11_url_filter(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query(spark, data, duck):
    same_rows(url_filter.op11_url_filter(spark, data), duck, url_filter.OP11_SQL)
