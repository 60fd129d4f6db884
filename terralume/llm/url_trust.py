"""URL filters: explicit rules first, then trust and distrust along the links between hosts.

``rule``: a rule fits its host and all subdomains if the path begins with the rule's; the longest
fitting rule decides.  Elsewhere the method decides for each host: personalised PageRank spreads
trust from hosts with allowed pages along links, and distrust from hosts with blocked pages against
them; a host is blocked if its distrust exceeds its trust by more than ``MARGIN``.

Host edges are counted before the shuffle, so a host with a third of the pages costs one row for
each task and target.  A round is one join of the links with the ranks and one sum: what a host keeps
and its seed are rows of the same sum.  Ranks are written after every round, so a plan never holds two
of them; links lie in the checkpoint folder, and a hub's links are a side that adaptive execution may
split.  A host without outgoing links keeps its rank.

Defined results: a url that is null or has no ``://`` has empty host and path, no rule, no links and
no rank, and is allowed; relative links and links to the own host are no host edges; a null or empty
html has no links, a very long one is read whole; repeated rows are judged alike; equal trust and
distrust allow; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_side, table

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING = 0.85
ROUNDS = 20
MARGIN = 0.0

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""
_LINK = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest fitting rule, its verdict), both null if none fits."""
    name = verdict = None
    for action, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, action) if verdict is None else verdict.when(fits, action)
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n from pages with host and html: links to other hosts."""
    links = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), 1)).alias("href"))
    ends = links.select("src", _lower(F.regexp_extract("href", _LINK, 1)).alias("dst"))
    return ends.filter("dst <> '' AND dst <> src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(ranks: DataFrame, moves: DataFrame) -> DataFrame:
    """One round for ``ranks`` (host, way, seed, sends, rank): the same columns."""
    own = ranks.select("host", "way", "seed", "sends", F.when(F.col("sends"), 0.0).otherwise(F.col("rank")).alias("got"))
    sent = moves.join(ranks.select(F.col("host").alias("src"), "way", "rank"), ["src", "way"])
    sent = sent.select(F.col("dst").alias("host"), "way", F.lit(0.0).alias("seed"), F.lit(False).alias("sends"), (F.col("rank") * F.col("p")).alias("got"))
    total = own.unionByName(sent).groupBy("host", "way").agg(F.sum("seed").alias("seed"), F.max("sends").alias("sends"), F.sum("got").alias("got"))
    return total.select("host", "way", "seed", "sends", ((1 - DAMPING) * F.col("seed") + DAMPING * F.col("got")).alias("rank"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust from ``seeds`` (host, allowed, blocked: shares of the seed mass).

    Both ranks move in the same rounds: ``way`` 0 is trust along the links, 1 distrust against them.
    """
    scratch = Scratch(seeds.sparkSession)
    both = edges.select(F.lit(0).alias("way"), "src", "dst", "n").unionByName(edges.select(F.lit(1).alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("way", "src").agg(F.sum("n").alias("total"))
    moves = scratch.put(both.join(out, ["way", "src"]).select("way", "src", "dst", (F.col("n") / F.col("total")).alias("p")))
    start = seeds.select("host", F.lit(0).alias("way"), F.col("allowed").alias("seed")).unionByName(seeds.select("host", F.lit(1).alias("way"), F.col("blocked").alias("seed")))
    ends = moves.select("way", F.col("dst").alias("host"), F.lit(0.0).alias("seed")).unionByName(moves.select("way", F.col("src").alias("host"), F.lit(0.0).alias("seed")))
    keeps = moves.select("way", F.col("src").alias("host")).distinct().withColumn("sends", F.lit(True))
    nodes = start.unionByName(ends).groupBy("host", "way").agg(F.sum("seed").alias("seed"))
    nodes = scratch.put(nodes.join(keeps, ["host", "way"], "left").select("host", "way", "seed", F.coalesce("sends", F.lit(False)).alias("sends"), F.col("seed").alias("rank")))
    if moves.isEmpty():  # every host keeps what it has: each round gives the ranks it got
        rounds = 0
    ranks = nodes
    for _ in range(rounds):
        after = scratch.put(spread(ranks, moves))
        if ranks is not nodes:
            scratch.drop(ranks)
        ranks = after
    return ranks.groupBy("host").agg(F.sum(F.when(F.col("way") == 0, F.col("rank"))).alias("trust"), F.sum(F.when(F.col("way") == 1, F.col("rank"))).alias("distrust"))


def judge(pages: DataFrame, rules=RULES, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of each page."""
    scratch = Scratch(pages.sparkSession)
    url = F.col("url").cast("string")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "ruled": ruled})
    count = lambda v: F.count_if(F.col("ruled") == v).cast("double")
    hosts = scratch.put(base.filter("host <> ''").groupBy("host").agg(count("allow").alias("a"), count("block").alias("b")))
    mass = hosts.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    seeds = hosts.select("host", (F.col("a") / max(mass["a"] or 0.0, 1.0)).alias("allowed"), (F.col("b") / max(mass["b"] or 0.0, 1.0)).alias("blocked"))
    ranks = scratch.put(propagate(seeds, scratch.put(host_edges(base)), rounds))
    ranks = small_side(ranks, F.octet_length("host") + 64)
    judged = base.drop("html").join(ranks, "host", "left")
    method = F.when(F.coalesce(F.col("distrust") - F.col("trust"), F.lit(0.0)) > MARGIN, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def oracle(rules=RULES, rounds: int = ROUNDS) -> str:
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    upper, low = string.ascii_uppercase, string.ascii_lowercase
    steps = [f"""r0 AS (SELECT host, way, seed AS rank FROM nodes)"""]
    for i in range(1, rounds + 1):
        steps.append(f"""r{i} AS (SELECT n.host, n.way, {1 - DAMPING} * n.seed + {DAMPING} * (CASE WHEN n.sends THEN 0 ELSE r.rank END + coalesce(g.got, 0)) AS rank
            FROM nodes n JOIN r{i - 1} r USING (host, way) LEFT JOIN (SELECT m.way, m.dst AS host, sum(r.rank * m.p) AS got FROM moves m JOIN r{i - 1} r ON m.src = r.host AND m.way = r.way GROUP BY ALL) g USING (host, way))""")
    return rf"""
WITH u AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{upper}', '{low}') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
b AS MATERIALIZED (SELECT *, {case(1)} AS rule, {case(2)} AS ruled FROM u),
h AS (SELECT host, CAST(count_if(ruled = 'allow') AS DOUBLE) AS a, CAST(count_if(ruled = 'block') AS DOUBLE) AS b FROM b WHERE host <> '' GROUP BY host),
links AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1)) AS href FROM b WHERE host <> ''),
e AS (SELECT src, translate(regexp_extract(href, '(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '{upper}', '{low}') AS dst, count(*) AS n FROM links GROUP BY ALL HAVING dst <> '' AND dst <> src),
ways AS (SELECT 0 AS way, src, dst, n FROM e UNION ALL SELECT 1, dst, src, n FROM e),
moves AS MATERIALIZED (SELECT way, src, dst, n / sum(n) OVER (PARTITION BY way, src) AS p FROM ways),
seeds AS (SELECT host, 0 AS way, a / greatest(sum(a) OVER (), 1) AS seed FROM h UNION ALL SELECT host, 1, b / greatest(sum(b) OVER (), 1) FROM h
    UNION ALL SELECT src, way, 0 FROM moves UNION ALL SELECT dst, way, 0 FROM moves),
nodes AS MATERIALIZED (SELECT host, way, sum(seed) AS seed, (way, host) IN (SELECT (way, src) FROM moves) AS sends FROM seeds GROUP BY ALL),
{", ".join(steps)},
f AS (SELECT host, sum(rank) FILTER (WHERE way = 0) AS trust, sum(rank) FILTER (WHERE way = 1) AS distrust FROM r{rounds} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust - trust, 0) > {MARGIN} THEN 'block' ELSE 'allow' END) AS verdict
FROM b LEFT JOIN f USING (host)
"""


ORACLE = oracle()
