"""URL filter: fixed rules first, then trust that flows over links between hosts.

Two personalised PageRanks run over the host graph: trust along the links from hosts with allowed pages, distrust against them from
hosts with blocked pages. A host whose distrust outweighs its trust is blocked. Ranks are whole numbers (fixed point), so
that sums do not depend on their order; every division rounds down. Built of DataFrame functions alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stable


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
         Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))


@dataclass(frozen=True)
class Flow:
    """``damping`` percent of a rank goes on over links; ``share``: a host is blocked from this many times its trust in distrust.
    A page with a rule brings ``unit`` to its host. A round carries ranks one link further, so what has not been delivered after ``rounds`` rounds is at most
    ``damping`` percent to that power of what the seeds bring: under a thousandth for 43. Rounds end earlier when nothing moves."""

    rounds: int = 43
    damping: int = 85
    unit: int = 1_000_000_000_000
    share: int = 1


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.regexp_extract(url, r"(?s)://(.*)", 1), "/", 1)
    return _lower(F.substring_index(F.substring_index(rest, "?", 1), "#", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, flow: Flow = Flow(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust``, one row per input row.

    A rule fits a page on its host or a subdomain whose path starts with the rule's; the longest fitting rule decides (the first of
    equally long ones). Without one, the page's host decides: blocked if its distrust is at least ``share`` times its trust and not 0.
    Seeds are the hosts of pages with a rule, weighted by their pages. A host links to the hosts of its pages' absolute and
    protocol-relative links, counted once each; other links stay on the host and carry nothing. A null URL, or one without ``://``, has
    an empty host and path, no rule and no rank, and is allowed. Null html has no links; null ids and repeated rows are passed through.
    """
    url = F.coalesce(pages[url_col], F.lit(""))
    source = pages.select(pages[id_col].alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    fits = [(r, ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)) for r in sorted(rules, key=lambda r: -len(r.name))]
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, fit in reversed(fits):
        rule, ruled = F.when(fit, F.lit(r.name)).otherwise(rule), F.when(fit, F.lit(r.verdict)).otherwise(ruled)
    judged = source.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"))

    seeds = stable(judged.groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")))
    found = F.regexp_extract_all("html", F.lit(r"""(?i)\s(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""), F.lit(1))
    links = stable(source.select(F.col("host").alias("from"), F.explode(F.array_distinct(F.transform(found, _lower))).alias("to")).filter("host != to").distinct())
    trust = _rank(seeds.select("host", F.col("good").alias("weight")), links, flow)
    distrust = _rank(seeds.select("host", F.col("bad").alias("weight")), links.select(F.col("to").alias("from"), F.col("from").alias("to")), flow)
    good, bad = _total(seeds, "good"), _total(seeds, "bad")
    scores = (seeds.select("host").join(trust.select("host", F.col("rank").alias("t"), F.col("shown").alias("trust")), "host", "left")
              .join(distrust.select("host", F.col("rank").alias("d"), F.col("shown").alias("distrust")), "host", "left"))
    scores = scores.select("host", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("trust", "distrust", "t", "d")))
    doubted = (F.col("d") > 0) & F.expr(f"d * {good}BD >= {flow.share}BD * t * {bad}BD")
    return judged.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(doubted, "block").otherwise("allow")).alias("verdict"),
        F.col("trust").cast("long"), F.col("distrust").cast("long"))


def _total(seeds: DataFrame, weight: str) -> int:
    return max(1, seeds.agg(F.sum(weight)).first()[0] or 0)


def _rank(seeds: DataFrame, links: DataFrame, flow: Flow) -> DataFrame:
    """``host, rank, shown`` for hosts of positive rank. Ranks of the seeds sum to ``unit`` times their weight, so that their steps do
    not depend on the table; ``shown`` are those divided by the weight. Rank at hosts without links ends there."""
    seeds = seeds.filter("weight > 0")
    total = _total(seeds, "weight")
    left = 100 - flow.damping
    start = stable(seeds.selectExpr("host", f"CAST(weight AS DECIMAL(38, 0)) * {flow.unit}BD AS start"))
    spread = stable(links.join(links.groupBy("from").agg(F.count("*").cast("decimal(20,0)").alias("out")), "from"))
    base = start.select("host", F.expr(_down(f"start * {left}BD", "100BD")).alias("rank"))
    if spread.isEmpty():
        return start.select("host", F.expr(_down(f"start * {left}BD", "100BD")).alias("rank"),
                            F.expr(_down(_down(f"start * {left}BD", "100BD"), f"{total}BD")).alias("shown"))
    ranks, wide = stable(base), "CAST({} AS DECIMAL(38, 0)) AS {}"
    for _ in range(flow.rounds):
        part = f"rank * {flow.damping}BD"
        moved = ranks.join(spread, F.col("host") == F.col("from")).select(F.col("to").alias("host"), F.expr(_down(part, "(100BD * out)")).alias("rank"))
        both = base.unionByName(moved).withColumn("old", F.lit(0).cast("decimal(38,0)")).unionByName(ranks.selectExpr("host", wide.format(0, "rank"), "rank AS old"))
        turn = stable(both.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old")).filter("rank > 0 OR old > 0"))
        settled = turn.filter("rank != old").isEmpty()
        ranks = turn.filter("rank > 0").select("host", "rank")
        if settled:
            break
    return ranks.select("host", "rank", F.expr(_down("rank", f"{total}BD")).alias("shown"))


def _down(a: str, b: str) -> str:
    """``a / b`` rounded down; the operator ``div`` gives no more than 64 bits."""
    return f"CAST((CAST({a} AS DECIMAL(38, 0)) - CAST({a} AS DECIMAL(38, 0)) % {b}) / {b} AS DECIMAL(38, 0))"


def sql(rules: Sequence[Rule] = RULES, flow: Flow = Flow()) -> str:
    """The same rows from ``pages`` in DuckDB's SQL."""
    ordered = sorted(rules, key=lambda r: -len(r.name))
    fits = {r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in ordered}
    upper = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

    def ranks(name: str, weight: str, links: str) -> str:
        text = f"""
{name}_start AS (SELECT host, {flow.unit}::HUGEINT * {weight} * {100 - flow.damping} // 100 AS rank FROM seeds WHERE {weight} > 0),
{name}_spread AS MATERIALIZED (SELECT a, b, count(*) OVER (PARTITION BY a) AS out FROM ({links})),
{name}_0 AS MATERIALIZED (SELECT * FROM {name}_start),"""
        for i in range(flow.rounds):
            text += f"""
{name}_{i + 1} AS MATERIALIZED (SELECT host, sum(rank)::HUGEINT AS rank FROM (SELECT * FROM {name}_start UNION ALL
  SELECT b, rank * {flow.damping} // (100 * out) FROM {name}_{i} JOIN {name}_spread ON host = a) GROUP BY host HAVING sum(rank) > 0),"""
        return text

    return rf"""
WITH source AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {upper}) AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, coalesce(html, '') AS html FROM pages),
judged AS (SELECT page_id, host, path, CASE {' '.join(f"WHEN {f} THEN '{r.name}'" for r, f in fits.items())} END AS rule,
  CASE {' '.join(f"WHEN {f} THEN '{r.verdict}'" for r, f in fits.items())} END AS ruled FROM source),
seeds AS MATERIALIZED (SELECT host, count_if(ruled = 'allow') AS good, count_if(ruled = 'block') AS bad FROM judged GROUP BY host),
links AS MATERIALIZED (SELECT DISTINCT host AS a, b FROM (SELECT host, translate(unnest(regexp_extract_all(html,
  '(?i)\s(?:href|src)\s*=\s*["'']?(?:https?:)?//([^/?#"''\s<>]+)', 1)), {upper}) AS b FROM source) WHERE host <> b),
{ranks('trust', 'good', 'SELECT a, b FROM links')}
{ranks('doubt', 'bad', 'SELECT b AS a, a AS b FROM links')}
scores AS (SELECT s.host, coalesce(t.rank, 0) AS t, coalesce(d.rank, 0) AS d, greatest(1, (SELECT sum(good) FROM seeds))::HUGEINT AS good, greatest(1, (SELECT sum(bad) FROM seeds))::HUGEINT AS bad FROM seeds s
  LEFT JOIN trust_{flow.rounds} t ON s.host = t.host LEFT JOIN doubt_{flow.rounds} d ON s.host = d.host)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN d > 0 AND d * good >= {flow.share} * t * bad THEN 'block' ELSE 'allow' END) AS verdict, (t // good)::BIGINT AS trust, (d // bad)::BIGINT AS distrust
FROM judged JOIN scores USING (host)
"""
