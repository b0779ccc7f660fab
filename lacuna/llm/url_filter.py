"""URL filters: rules first, link-graph scores of hosts for what no rule fits [native].

A rule names a host and the start of a path and fits the host with all its subdomains; the
longest rule that fits decides.  Hosts that rules clear are trusted seeds, hosts of which
rules block more than half of the pages are blocked seeds.  Trust is a personalised
PageRank from the trusted seeds along the links between hosts, distrust one from the
blocked seeds against them.  A host is blocked if its distrust reaches ``BLOCK_AT`` and
exceeds its trust.

Scores are whole numbers (a seed starts with ``UNIT``): every link rounds its share down,
so sums do not depend on the order in which tasks add them, and runs repeat.  A round
joins links with scores by host and sums; hosts with many links are split as hot keys.
Rounds end when nothing changes, else after ``ROUNDS`` links: longer walks carry less than
``DAMPING ** ROUNDS`` (4 %) of a seed.

Only links to other hosts count, each target once for a page and host; links without a
host (``/a``, ``#b``) stay on their own.  Targets need no pages of their own.

Defined results
    null urls, and those without ``://``, have an empty host and path, which no rule and
    no link fits: they are allowed; null html has no links; rows that repeat count each;
    a url or page of any length is read whole; a host's equal trust and distrust allow it;
    an empty table gives an empty result; columns besides the three are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.runtime import spread_join, stash, table

#: verdict, host and path; of those that fit, the longest decides.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Rules are literals of the plan; longer lists belong in a table.
MOST_RULES = 1_000
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of an anchor's target.
LINK = r"""(?i)<a[\x20\x09-\x0D][^<>]*?href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<>\x20\x09-\x0D]+)"""
UNIT = 1_000_000_000
DAMPING, ROUNDS = 0.85, 20
#: A tenth of what a blocked seed starts with.
BLOCK_AT = UNIT // 10
#: Hosts that are broadcast; beyond it only hot ones are.
FEW_HOSTS = 100_000


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path`` of the url."""
    u = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    return pages.withColumns({"host": _lower(F.regexp_extract(u, URL, 1)), "path": F.regexp_extract(u, URL, 2)})


def rule_fit(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; else nulls."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} can be literals of a plan")
    name = verdict = F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``src, dst, n``: pages of one host that link to another."""
    hosts = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(f"`{html}`"), F.lit("")), F.lit(LINK), F.lit(1)), _lower))
    linked = parts(pages.select(F.col(f"`{url}`").alias("url"), hosts.alias("_to"))).where("host <> ''")
    return linked.select(F.col("host").alias("src"), F.explode("_to").alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``host, trust, distrust`` of every host that a seed reaches.

    ``seeds`` has ``host, side``, side 1 with the links (trust) and -1 against them.
    """
    ways = links.select(F.lit(1).alias("side"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
    ways = ways.union(links.select(F.lit(-1), "dst", "src", "n"))
    out_of = ways.groupBy("side", "host").agg(F.sum("n").alias("of"), F.count(F.lit(1)).alias("ways"))
    ways, out_of = stash(ways, "ways"), stash(out_of, "sources")
    shared = stash(spread_join(ways, out_of, ["side", "host"], "ways", few=FEW_HOSTS).select("side", "host", "to", (F.col("n").cast("double") / F.col("of")).alias("share")), "shares")
    start = seeds.select("side", "host", F.lit(UNIT).cast("long").alias("score"))
    scores = stash(start, "scores")
    for _ in range(rounds):
        known = stash(scores.join(out_of.select("side", "host", "ways"), ["side", "host"]), "known")
        sent = spread_join(shared, known, ["side", "host"], "ways", few=FEW_HOSTS)
        sent = sent.select("side", F.col("to").alias("host"), F.floor(F.lit(damping) * F.col("score").cast("double") * F.col("share")).alias("score"))
        new = stash(start.union(sent.where("score > 0")).groupBy("side", "host").agg(F.sum("score").alias("score")), "scores")
        before = scores.select("side", "host", F.col("score").alias("was"))
        settled = new.join(before, ["side", "host"], "left").where("was IS NULL OR score <> was").isEmpty()
        scores = new
        if settled:
            break
    on = {1: "trust", -1: "distrust"}
    return scores.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("side") == s, F.col("score"))), F.lit(0).cast("long")).alias(c) for s, c in on.items()))


def judge(pages: DataFrame, keep: tuple[str, ...] = ("page_id",), rules=RULES, url: str = "url", html: str = "html") -> DataFrame:
    """``keep`` with ``host, path, rule, trust, distrust, verdict`` for every page."""
    name, verdict = rule_fit(rules)
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_kept")
    fitted = parts(pages.select(kept, F.col(f"`{url}`").alias("url"))).withColumns({"rule": name, "_verdict": verdict})
    hosts = stash(fitted.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("_verdict") == "allow").alias("allowed"), F.count_if(F.col("_verdict") == "block").alias("blocked")), "hosts")
    side = F.when(2 * F.col("blocked") > F.col("pages"), -1).when(F.col("allowed") > 0, 1)
    seeds = hosts.where("host <> ''").select("host", side.alias("side")).where("side IS NOT NULL")
    scores = propagate(host_links(pages, url, html), seeds)
    zero = F.lit(0).cast("long")
    known = stash(hosts.join(scores, "host", "left").select("host", "pages", F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust")), "judged")
    found = spread_join(fitted, known, ["host"], "pages", few=FEW_HOSTS)
    by_links = F.when((F.col("distrust") >= BLOCK_AT) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return found.select("_kept.*", "host", "path", "rule", "trust", "distrust", F.coalesce("_verdict", by_links).alias("verdict"))


def op11_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _rule_sql() -> str:
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    return f"CASE {' '.join(fits)} END"


def _verdict_sql() -> str:
    return f"CASE rule {' '.join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in RULES)} END"


_LINK_SQL = LINK.replace("'", "''")
OP11_SQL = f"""
WITH RECURSIVE u AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages),
r AS (SELECT *, {_rule_sql()} AS rule FROM u),
v AS (SELECT *, {_verdict_sql()} AS given FROM r),
hosts AS (SELECT host, count(*) AS pages, count_if(given = 'allow') AS allowed, count_if(given = 'block') AS blocked FROM v WHERE host <> '' GROUP BY 1),
seeds AS (SELECT host, CASE WHEN 2 * blocked > pages THEN -1 ELSE 1 END AS side FROM hosts WHERE 2 * blocked > pages OR allowed > 0),
links AS (
  SELECT src, dst, count(*) AS n
  FROM (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{_LINK_SQL}', 1), lambda x: translate(x, '{UPPER}', '{LOWER}')))) AS dst FROM u WHERE host <> '')
  WHERE src <> dst GROUP BY 1, 2),
ways AS (SELECT 1 AS side, src AS host, dst AS goal, n FROM links UNION ALL SELECT -1, dst, src, n FROM links),
shares AS (SELECT side, host, goal, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY side, host) AS share FROM ways),
walk AS (
  SELECT 0 AS round, side, host, CAST({UNIT} AS BIGINT) AS score FROM seeds
  UNION ALL
  SELECT round + 1, side, host, CAST(sum(score) AS BIGINT) FROM (
    SELECT w.round, s.side, s.goal AS host, CAST(floor(CAST({DAMPING} AS DOUBLE) * CAST(w.score AS DOUBLE) * s.share) AS BIGINT) AS score
    FROM walk w JOIN shares s ON w.side = s.side AND w.host = s.host
    UNION ALL
    SELECT (SELECT max(round) FROM walk), side, host, CAST({UNIT} AS BIGINT) FROM seeds)
  WHERE round < {ROUNDS} GROUP BY 1, 2, 3),
scores AS (
  SELECT host, coalesce(sum(score) FILTER (side = 1), 0) AS trust, coalesce(sum(score) FILTER (side = -1), 0) AS distrust
  FROM walk WHERE round = {ROUNDS} GROUP BY 1)
SELECT page_id, v.host, path, rule, CAST(coalesce(trust, 0) AS BIGINT) AS trust, CAST(coalesce(distrust, 0) AS BIGINT) AS distrust,
       coalesce(given, CASE WHEN distrust >= {BLOCK_AT} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN scores s ON v.host = s.host
"""
