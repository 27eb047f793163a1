"""Operator 4 [native]: URL filter by rules and by trust that spreads over the link graph of hosts.

A host is what follows the first `://` of a url up to `/`, `?`, `#` or the end, A-Z lower-cased; its path follows up to
`?`, `#` or the end. A rule fits its host and all subdomains where the path starts with the rule's; the longest wins.

Pages without a rule take their host's verdict. A host is a trusted seed by the share of its pages that allow-rules
fit, and a blocked one by that of block-rules. Over the distinct links between hosts (absolute ones in the html)
personalised PageRank carries trust forward from the trusted seeds, and distrust backward, against the links, from the
blocked ones: STEPS rounds with damping DAMPING; what reaches a host without a way on is lost. Scores are scaled so that
a seed with all of its pages and no links has 1. Scores grow thin where a host has many neighbours, so both ranks are
also taken with every host as a seed of 1: a host's spam mass is the part of what reaches it backward that comes from
blocked seeds, and its good mass the part of what reaches it forward that comes from trusted ones. Both are parts of a
whole, so they compare whatever the number of neighbours. A host is blocked if its spam mass is more than THRESHOLD, or
the share of its own pages that block-rules fit is at least that, and the larger of the two is more than the larger of
its good mass and the share that allow-rules fit.

A null url, or one without `://`, has an empty host and path and no rule, and is allowed, as hosts beside the graph are.
Of rules of one length that fit, the first in the alphabet wins. Urls and html of any length are read whole. Null html
has no links. Repeated rows are judged each; empty tables give no rows; other columns are not read. The rule
list is a parameter of a known size. Only SQL functions work on the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING, STEPS, THRESHOLD = 0.85, 12, 0.5
EACH = 4  # rounds in one plan
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, or null."""
    def fits(rule):
        name, _, start = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)

    return F.coalesce(*[F.when(fits(rule), F.lit(rule)) for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]))])


def ways(pages: DataFrame) -> DataFrame:
    """kind, at, to, share: forward (trust, and ahead for all seeds) and backward (distrust, and whole for all) along the distinct links between hosts."""
    links = pages.select("host", F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1))).alias("other")).select("host", F.translate("other", UPPER, LOWER).alias("other"))
    links = links.where("host <> '' and other <> host").distinct()
    way = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("at"), F.col(b).alias("to"))
    both = written(links.select(F.explode(F.array(way("trust", "host", "other"), way("ahead", "host", "other"), way("distrust", "other", "host"), way("whole", "other", "host"))).alias("w")).select("w.*"), "links")
    total = written(both.groupBy("kind", "at").agg((1 / F.count("*")).alias("share")), "shares")
    return written(both.join(total, ["kind", "at"]), "ways")


def spread(seeds: DataFrame, ways: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """kind, host, score after so many rounds."""
    ranks, ways = seeds.select("kind", "host", "score"), ways.withColumnRenamed("at", "host")
    if ways.isEmpty():
        return ranks  # every round gives the seeds again
    for step in range(1, steps + 1):
        moved = ranks.join(ways, ["kind", "host"]).select("kind", F.col("to").alias("host"), (damping * F.col("score") * F.col("share")).alias("score"))
        ranks = moved.unionByName(seeds.select("kind", "host", "score")).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if step % EACH == 0 or step == steps:
            ranks = written(ranks, "ranks")
    return ranks


def judge(pages: DataFrame, rules=RULES, steps: int = STEPS, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    verdicts = reduce(lambda c, r: c.when(F.col("rule") == r[1], F.lit(r[0])), rules, F.when(F.lit(False), F.lit("")))
    ruled = pages.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule")).withColumn("by_rule", verdicts)
    share = lambda v: F.avg(F.when(F.col("by_rule") == v, 1.0).otherwise(0.0))
    seeds = written(ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "shares")
    roads = ways(pages)
    own = seeds.select("host", F.col("distrust").alias("own"), F.col("trust").alias("own_good"))
    named = seeds.select("host").unionByName(roads.select(F.col("to").alias("host"))).distinct().select(F.explode(F.array(F.lit("whole"), F.lit("ahead"))).alias("kind"), "host", F.lit(1.0).alias("score"))
    seeds = seeds.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("trust").alias("score")), F.struct(F.lit("distrust").alias("kind"), F.col("distrust").alias("score")))).alias("s")).select("s.kind", "host", "s.score").where("score > 0")
    ranks = spread(written(seeds.unionByName(named), "seeds"), roads, steps)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    hosts = ranks.groupBy("host").agg(of("trust"), of("distrust"), of("whole"), of("ahead")).join(own, "host", "left").fillna(0.0, ["own", "own_good"])
    part = lambda score, own, all_: F.round(F.when(F.col(all_) > 1 + 1e-9, (F.col(score) - F.col(own)) / (F.col(all_) - 1)).otherwise(0.0), 9)
    hosts = written(hosts.select("host", "trust", "distrust", "own", "own_good", part("distrust", "own", "whole").alias("mass"), part("trust", "own_good", "ahead").alias("good_mass")), "hosts")
    out = ruled.join(hosts, "host", "left").fillna(0.0, ["trust", "distrust", "own", "own_good", "mass", "good_mass"])
    bad = ((F.col("own") >= threshold) | (F.col("mass") > threshold)) & (F.greatest("own", "mass") > F.greatest("own_good", "good_mass"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(bad, "block").otherwise("allow")).alias("verdict"), *[F.round(c, 6).alias(c) for c in ("trust", "distrust", "mass", "good_mass")])


def _fits(rule: str) -> str:
    name, _, start = rule.partition("/")
    return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}')"


_ORDER = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
ORACLE = rf"""
WITH RECURSIVE cut AS (SELECT page_id, coalesce(html, '') AS html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {' '.join(f"WHEN {_fits(r)} THEN '{r}'" for _, r in _ORDER)} END AS rule, CASE {' '.join(f"WHEN {_fits(r)} THEN '{v}'" for v, r in _ORDER)} END AS by_rule FROM p),
shares AS (SELECT host, avg(CASE WHEN by_rule = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS trust, avg(CASE WHEN by_rule = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS distrust FROM ruled WHERE host <> '' GROUP BY host),
links AS (SELECT DISTINCT host, other FROM (SELECT host, translate(unnest(regexp_extract_all(html, 'href\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1, 'i')), '{UPPER}', '{LOWER}') AS other FROM p) WHERE host <> '' AND other <> host),
ways AS (SELECT unnest(['trust', 'ahead']) AS kind, host AS a, other AS b, 1.0::DOUBLE / count(*) OVER (PARTITION BY host) AS share FROM links UNION ALL SELECT unnest(['distrust', 'whole']), other, host, 1.0::DOUBLE / count(*) OVER (PARTITION BY other) FROM links),
seeds AS (SELECT 'trust' AS kind, host, trust AS score FROM shares WHERE trust > 0 UNION ALL SELECT 'distrust', host, distrust FROM shares WHERE distrust > 0
  UNION ALL SELECT unnest(['whole', 'ahead']), host, 1.0::DOUBLE FROM (SELECT host FROM shares UNION SELECT b FROM ways)),
ranks(k, kind, host, score) AS (
  SELECT 0, kind, host, score FROM seeds
  UNION ALL
  SELECT k + 1, kind, host, sum(score) FROM (
    SELECT r.k, w.kind, w.b AS host, {DAMPING} * r.score * w.share AS score FROM ranks r JOIN ways w ON r.kind = w.kind AND r.host = w.a
    UNION ALL SELECT r.k, s.kind, s.host, s.score FROM seeds s, (SELECT max(k) AS k FROM ranks) r)
  WHERE k < {STEPS} GROUP BY k, kind, host),
sums AS (SELECT host, {', '.join(f"sum(CASE WHEN kind = '{k}' THEN score ELSE 0 END) AS {k}" for k in ('trust', 'distrust', 'whole', 'ahead'))} FROM ranks WHERE k = {STEPS} GROUP BY host),
hosts AS (SELECT s.host, s.trust, s.distrust, coalesce(o.distrust, 0) AS own, coalesce(o.trust, 0) AS own_good, round(CASE WHEN whole > 1 + 1e-9 THEN (s.distrust - coalesce(o.distrust, 0)) / (whole - 1) ELSE 0 END, 9) AS mass,
  round(CASE WHEN ahead > 1 + 1e-9 THEN (s.trust - coalesce(o.trust, 0)) / (ahead - 1) ELSE 0 END, 9) AS good_mass FROM sums s LEFT JOIN shares o USING (host))
SELECT page_id::BIGINT AS page_id, host, path, rule, coalesce(by_rule, CASE WHEN (coalesce(own, 0) >= {THRESHOLD} OR coalesce(mass, 0) > {THRESHOLD}) AND greatest(coalesce(own, 0), coalesce(mass, 0)) > greatest(coalesce(own_good, 0), coalesce(good_mass, 0)) THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(trust, 0), 6) AS trust, round(coalesce(distrust, 0), 6) AS distrust, round(coalesce(mass, 0), 6) AS mass, round(coalesce(good_mass, 0), 6) AS good_mass
FROM ruled LEFT JOIN hosts USING (host)
"""
