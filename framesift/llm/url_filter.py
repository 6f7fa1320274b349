"""URL filters: rules for hosts and paths, and link-graph propagation for what no rule fits; DataFrame functions only.

A rule is a verdict for a host, its subdomains, and the paths that start with
the rule's path; of the rules that fit, the longest wins. A url that no rule
fits gets the verdict of its host. That comes from two personalised PageRanks
over host edges: trust starts at hosts whose pages a rule allows and follows
the links; distrust starts at hosts whose pages a rule blocks and follows the
links backwards, to those that link there. A host whose distrust is at least
``block_at`` and above its trust is blocked.

Edges: a page counts once for each other host that its html links to (href, of
http, https or no scheme); a host and its parent domain, if both have pages,
are one site and linked both ways by ``family_weight``. They are counted by
pair of hosts before anything is joined. A seed host starts with SCALE times
the share of its pages that a rule of that kind fits. Masses are whole numbers
and every share of them is rounded down, so that sums don't depend on their
order: reruns agree. Each round sends only what arrived in the last one and
writes it to the shared folder; rounds end when nothing is on its way, or
after ``rounds``.

Defined results: a null url, or one without ``://``, has an empty host and path,
no rule, and is allowed (there is no host to judge); a url of a host alone has
an empty path, which no rule fits whose path is ``/``; hosts keep ports and
letters outside A-Z as they are; null html has no links; repeated rows are
rows of their own; an empty table gives an empty result; other columns are
ignored, whatever they are called. Rules are literals of the plan: lists of
some hundreds, not tables of millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_cut, small, table

#: (verdict, host, path) as the contract names them.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = "://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
#: The mass of a seed host all of whose pages are under a rule.
SCALE = 1_000_000


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: str | Column) -> Column:
    return F.coalesce(lowered(F.regexp_extract(url, URL, 1)), F.lit(""))


def path_of(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, ruled (its verdict) of every row."""
    parts = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    fits = parts.withColumn("_fits", rule_of(F.col("host"), F.col("path"), rules))
    return fits.select("page_id", "host", "path", F.col("_fits.rule").alias("rule"), F.col("_fits.verdict").alias("ruled"))


def hosts_of(judged_: DataFrame) -> DataFrame:
    """host, n, allowed, blocked (pages under a rule of that kind) of hosts with a name."""
    count = lambda v: F.count(F.when(F.col("ruled") == v, 1))
    return judged_.filter("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), count("allow").alias("allowed"), count("block").alias("blocked"))


def host_edges(pages: DataFrame, hosts: DataFrame, *, family_weight: int = 1) -> DataFrame:
    """src, dst, w: pages of src that link to dst, and links between a host and its parent domain."""
    to = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lowered))
    linked = pages.select(host_of("url").alias("src"), F.explode(to).alias("dst")).filter("src <> '' AND src <> dst")
    counted = linked.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    if not family_weight:
        return counted
    up = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]*\.(.+)$", 1).alias("dst")).filter("dst <> ''")
    kin = up.join(hosts.select(F.col("host").alias("dst")), "dst").select("src", "dst", F.lit(family_weight).cast("long").alias("w"))
    return counted.unionAll(kin).unionAll(kin.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, rounds: int = 12) -> DataFrame:
    """host, mass: what seeds (host, mass) hold and what reaches others along the edges (src, dst, w), each link passing on its share."""
    out = edges.groupBy("src").agg(F.sum("w").alias("_all"))
    shares = cut(edges.join(out, "src").select("src", "dst", (F.lit(damping) * (F.col("w").cast("double") / F.col("_all").cast("double"))).alias("share")), "url-shares")
    moving = cut(seeds.filter("mass > 0").select("host", "mass"), "url-mass")
    arrived = [moving]
    for _ in range(rounds):
        sent = shares.join(moving.select(F.col("host").alias("src"), "mass"), "src").select(F.col("dst").alias("host"), F.floor(F.col("mass").cast("double") * F.col("share")).cast("long").alias("mass"))
        moving = cut(sent.groupBy("host").agg(F.sum("mass").alias("mass")).filter("mass > 0"), "url-mass")
        if moving.isEmpty():
            drop_cut(moving)
            break
        arrived.append(moving)
    every = arrived[0]
    for x in arrived[1:]:
        every = every.unionAll(x)
    done = cut(every.groupBy("host").agg(F.sum("mass").alias("mass")), "url-reached")
    for x in [shares, *arrived]:
        drop_cut(x)
    return done


def host_scores(pages: DataFrame, judged_: DataFrame, *, damping: float = 0.85, rounds: int = 12, family_weight: int = 1) -> DataFrame:
    """host, trust, distrust of every host that mass reaches."""
    hosts = cut(hosts_of(judged_), "url-hosts")
    edges = cut(host_edges(pages, hosts, family_weight=family_weight), "url-edges")
    seed = lambda c: hosts.select("host", F.floor(F.col(c).cast("double") / F.col("n").cast("double") * SCALE).cast("long").alias("mass"))
    trust = propagate(edges, seed("allowed"), damping=damping, rounds=rounds)
    back = propagate(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), seed("blocked"), damping=damping, rounds=rounds)
    scores = cut(trust.withColumnRenamed("mass", "trust").join(back.withColumnRenamed("mass", "distrust"), "host", "full").select("host", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("trust", "distrust")]), "url-scores")
    for x in (hosts, edges, trust, back):
        drop_cut(x)
    return scores


def filter_urls(pages: DataFrame, *, rules=RULES, block_at: float = 0.25, damping: float = 0.85, rounds: int = 12, family_weight: int = 1) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row of pages (page_id, url, html)."""
    rows = judged(pages, rules)
    scores = small(host_scores(pages, rows, damping=damping, rounds=rounds, family_weight=family_weight))
    bad = (F.col("distrust") >= int(block_at * SCALE)) & (F.col("distrust") > F.col("trust"))
    j = rows.join(scores, "host", "left")
    verdict = F.coalesce("ruled", F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return j.select("page_id", "host", "path", "rule", verdict.alias("verdict"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("trust", "distrust")])


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every url of ``pages``."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _sql(rounds: int = 12, damping: float = 0.85, block_at: float = 0.25) -> str:
    """The same in SQL, one common table for each round."""
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for _, h, p in RULES]
    order = sorted(range(len(RULES)), key=lambda i: -len(RULES[i][1] + RULES[i][2]))
    case = lambda f: "CASE " + " ".join(fits[i] + f"'{f(RULES[i])}'" for i in order) + " END"
    link = LINK.replace("'", "''")
    out = f"""
WITH u AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(url, '{URL}', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
j AS (SELECT *, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS ruled FROM u),
h AS (SELECT host, count(*) AS n, count(*) FILTER (ruled = 'allow') AS allowed, count(*) FILTER (ruled = 'block') AS blocked FROM j WHERE host <> '' GROUP BY host),
l AS (SELECT DISTINCT page_id, host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst, row_number() OVER () AS line FROM u),
kin AS (SELECT a.host AS src, b.host AS dst FROM h a JOIN h b ON regexp_extract(a.host, '^[^.]*\\.(.+)$', 1) = b.host),
e AS (
  SELECT src, dst, sum(w) AS w FROM (
    SELECT src, dst, count(*) AS w FROM l WHERE src <> '' AND src <> dst GROUP BY src, dst
    UNION ALL SELECT src, dst, 1 FROM kin UNION ALL SELECT dst, src, 1 FROM kin) GROUP BY src, dst)"""
    for side, seed, a, b in (("t", "allowed", "src", "dst"), ("d", "blocked", "dst", "src")):
        out += f""",
{side}s AS (SELECT {a} AS a, {b} AS b, {damping}::DOUBLE * (w::DOUBLE / (sum(w) OVER (PARTITION BY {a}))::DOUBLE) AS share FROM e),
{side}0 AS (SELECT host, CAST(floor({seed}::DOUBLE / n::DOUBLE * {SCALE}) AS BIGINT) AS mass FROM h)"""
        for i in range(rounds):
            out += f""",
{side}{i + 1} AS (SELECT b AS host, CAST(sum(CAST(floor(mass::DOUBLE * share) AS BIGINT)) AS BIGINT) AS mass FROM {side}s JOIN {side}{i} ON a = host GROUP BY b)"""
        every = " UNION ALL ".join(f"SELECT * FROM {side}{i}" for i in range(rounds + 1))
        out += f""",
{side} AS (SELECT host, CAST(sum(mass) AS BIGINT) AS mass FROM ({every}) GROUP BY host)"""
    return out + f"""
SELECT page_id, j.host, path, rule,
  coalesce(ruled, CASE WHEN coalesce(d.mass, 0) >= {int(block_at * SCALE)} AND coalesce(d.mass, 0) > coalesce(t.mass, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(t.mass, 0) AS trust, coalesce(d.mass, 0) AS distrust
FROM j LEFT JOIN t ON j.host = t.host LEFT JOIN d ON j.host = d.host
"""


OP12_SQL = _sql()
