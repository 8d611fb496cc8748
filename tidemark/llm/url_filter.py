"""URL filter: rules first, and for other pages trust and distrust carried along host links.

Pages give links between hosts. Trust starts at hosts with pages that a rule allows and follows
links forward (personalised PageRank); distrust starts at hosts with pages that a rule blocks and
follows links backward, to the hosts that lead there. A host is blocked if its share of distrust
passes a threshold.
"""

from __future__ import annotations

from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common
from ._common import cut, join_hot


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Fixed: the rules of the query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
DAMPING = 0.85
#: Propagation ends when three rounds raise no host's trust or distrust by more than this part of it.
TOLERANCE = 1e-6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does. Of equals the first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.host + rule.path).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``source``, ``target`` and ``n``, the number of links from one host to another.

    A link without a host stays on its own host; such links and pages without a host are left out.
    """
    hosted = pages.select(host_and_path(F.col(url_col))[0].alias("source"), F.col(html_col).alias("html")).where("source <> ''")
    found = hosted.select("source", F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), F.lit(1))).alias("link"))
    links = found.select("source", F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link")).alias("link"))
    return links.select("source", host_and_path(F.col("link"))[0].alias("target")).where("target <> '' AND target <> source").groupBy("source", "target").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``host``, ``trust`` and ``distrust``, carried on until no host changes.

    Masses only grow, and the largest relative growth never rises from round to round, so a host that
    is still to be reached, or reached by more, shows as growth on the way to it. The loop ends once
    no new host was reached and all growth in three rounds is within ``tolerance``. The links of hosts
    with very many are joined apart.

    ``seeds`` has ``host``, ``trust`` and ``distrust``, one row for each host. Hosts that nothing
    reaches are left out; without links the seeds come back, damped.
    """
    forward = links.select(F.lit("trust").alias("kind"), "source", "target", "n")
    backward = links.select(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "n")
    both = forward.union(backward)
    both = cut(both)
    n_links = both.count()
    totals = both.groupBy("kind", "source").agg(F.sum("n").alias("total"), F.count("*").alias("links"))
    shared = join_hot(both, totals.withColumn("hub", F.col("links") * _common.HOT > n_links), ["kind", "source"], "links", n_links)
    edges = cut(shared.select("kind", F.col("source").alias("host"), "target", (F.col("n") / F.col("total")).alias("share"), "hub"))
    usual, from_hubs = edges.where("NOT hub"), edges.where("hub")
    hubs = F.broadcast(from_hubs.select("kind", "host").distinct())  # fewer than HOT
    start = cut(seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust").cast("double"), F.lit("distrust"), F.col("distrust").cast("double"))).alias("kind", "mass")).where("mass > 0").withColumn("mass", (1 - damping) * F.col("mass")))
    mass = start
    if not edges.isEmpty():
        before = start
        for k in count(1):
            hub_mass = F.broadcast(mass.join(hubs, ["kind", "host"], "left_semi"))
            moved = usual.join(mass, ["kind", "host"]).unionByName(from_hubs.join(hub_mass, ["kind", "host"]))
            carried = moved.select(F.col("target").alias("host"), "kind", (damping * F.col("mass") * F.col("share")).alias("mass"))
            mass = carried.union(start.select("host", "kind", "mass")).groupBy("host", "kind").agg(F.sum("mass").alias("mass"))
            if k % 3 == 0:
                mass = cut(mass)
                old = before.select("host", "kind", F.col("mass").alias("old"))
                grown = mass.where("mass > 0").join(old, ["host", "kind"], "left").agg(F.max(1 - F.coalesce("old", F.lit(0.0)) / F.col("mass"))).first()[0]
                if grown is None or grown <= tolerance:
                    break
                before = mass
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0.0)).alias(kind)
    return mass.groupBy("host").agg(of("trust"), of("distrust"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, damping: float = DAMPING, tolerance: float = TOLERANCE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Judges each page's url.

    Returns a row for each row of ``pages``: ``page_id``, ``host``, ``path``, ``rule`` (null if none
    fits), ``verdict``, and the host's ``trust`` and ``distrust``. A page without a rule is blocked
    if distrust is over ``threshold`` of its host's trust and distrust together, and allowed
    otherwise; so a page with an empty host, or whose host nothing reaches, is allowed. A null html
    has no links, repeated rows and null ids stay, an empty table gives an empty one, other
    columns are not read.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": name, "ruling": verdict})
    share = lambda kind: (F.count_if(F.col("ruling") == kind) / F.count("*"))
    hosts = cut(ruled.groupBy("host").agg(F.count("*").alias("n"), share("allow").alias("trust"), share("block").alias("distrust")))
    scored = propagate(host_links(pages, url_col, html_col), hosts.where("host <> ''").drop("n"), damping, tolerance)
    of = lambda kind: F.coalesce(kind, F.lit(0.0)).alias(kind)
    judged = cut(hosts.select("host", "n").join(scored, "host", "left").select("host", "n", of("trust"), of("distrust")))
    total = judged.agg(F.sum("n")).first()[0] or 0
    own = F.when(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), "block").otherwise("allow")
    return join_hot(ruled, judged, ["host"], "n", total).select("page_id", "host", "path", "rule", F.coalesce("ruling", own).alias("verdict"), "trust", "distrust")


def _fits_sql(rule: Rule) -> str:
    return f"((host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}'))"


def _parsed_sql(url: str) -> tuple[str, str]:
    rest = f"CASE WHEN contains({url}, '://') THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
    return f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}')", f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"


_LONGEST_FIRST = sorted(RULES, key=lambda r: -len(r.host + r.path))
#: The judgement in DuckDB SQL; 300 rounds leave out less than 1e-20 of the mass.
REPORT_SQL = f"""
WITH RECURSIVE parsed AS (
  SELECT page_id, html, coalesce({_parsed_sql("url")[0]}, '') AS host, coalesce({_parsed_sql("url")[1]}, '') AS path FROM pages
), ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {_fits_sql(r)} THEN '{r.host}{r.path}'" for r in _LONGEST_FIRST)} END AS rule,
    CASE {" ".join(f"WHEN {_fits_sql(r)} THEN '{r.verdict}'" for r in _LONGEST_FIRST)} END AS ruling FROM parsed
), found AS (
  SELECT host, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?((?:https?:)?//[^"''\\s>]+)', 1)) AS link FROM parsed WHERE host <> ''
), hosted AS (
  SELECT host AS source, {_parsed_sql("link")[0]} AS target FROM (SELECT host, CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END AS link FROM found)
), links AS (
  SELECT source, target, count(*) AS n FROM hosted WHERE target <> '' AND target <> source GROUP BY ALL
), edges AS (
  SELECT 'allow' AS kind, source AS host, target, n / sum(n) OVER (PARTITION BY source) AS share FROM links
  UNION ALL SELECT 'block', target, source, n / sum(n) OVER (PARTITION BY target) FROM links
), seeds AS (
  SELECT k AS kind, host, count(*) FILTER (ruling = k) / count(*) AS seed FROM ruled, (VALUES ('allow'), ('block')) t(k) WHERE host <> '' GROUP BY ALL
), mass AS (
  SELECT 0 AS round, kind, host, {1 - DAMPING!r} * seed AS m FROM seeds WHERE seed > 0
  UNION ALL SELECT round + 1, m.kind, e.target, sum({DAMPING!r} * m * share) FROM mass m JOIN edges e ON m.kind = e.kind AND m.host = e.host WHERE round < 300 GROUP BY ALL
), scores AS (
  SELECT host, coalesce(sum(m) FILTER (kind = 'allow'), 0) AS trust, coalesce(sum(m) FILTER (kind = 'block'), 0) AS distrust FROM mass GROUP BY host
)
SELECT page_id, r.host, path, rule, coalesce(ruling, CASE WHEN distrust > 0.5 * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN scores s ON r.host = s.host
"""
