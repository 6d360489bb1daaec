"""URL filters: listed rules, then trust and distrust over the host graph."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import sized_broadcast
from vigilake.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?is)href\s*=\s*["']?((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]+)"""
DAMPING = 0.85
#: Scores are propagated until what moves in a round is less than this share of the
#: seeds' (each round moves DAMPING of the last at most, so it ends).
TOLERANCE = 1e-6
#: Rounds after which what is left to move is less than TOLERANCE.
MOST_ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
#: A host is blocked where distrust exceeds this many times its trust.
RATIO = 1.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str  # host and path, as `example.com/en/7`

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


#: The listed rules.
RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does. The rules
    are a short list known when the plan is made: one CASE, no join."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):  # the longest becomes the outermost
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(host, html) -> (src, dst, n): absolute links between different hosts."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("link"))
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))
    edges = links.select("src", host_of(absolute).alias("dst"))
    return edges.where((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != "")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank of two kinds over host edges.

    `seeds`: (host, trust, distrust) counts. Trust flows along links from the
    trusted seeds; distrust flows against them, from blocked hosts to those that
    link to them. Both restart at the seeds' shares. What arrives in a round is sent
    on in the next and added up, until less than `tolerance` moves. Returns
    (host, trust, distrust). One join and one pre-aggregated sum a round.

    Hosts are not null (the caller leaves urls without one out); repeated links count as
    often as they stand; a host without links keeps what it has; without seeds nothing
    flows, and empty tables give an empty result.
    """
    sums = seeds.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
    share = lambda kind, c: F.struct(F.lit(kind).alias("kind"), (F.col(c) / float(sums[c] or 1)).alias("seed"))
    restart = seeds.select("host", F.explode(F.array(share(1, "trust"), share(-1, "distrust"))).alias("x"))
    restart = restart.select("host", "x.kind", (F.col("x.seed") * (1 - damping)).alias("score")).where("score > 0")
    out = edges.groupBy("src").agg(F.sum("n").alias("all_n"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("all_n"))
    part = (F.col("n") / F.col("all_n") * damping).alias("share")
    forward = edges.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), F.lit(1).alias("kind"), part)
    back = edges.join(into, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(-1).alias("kind"), part)
    flow = cut(forward.unionByName(back), "flow")
    moving = score = cut(restart, "restart")
    while not flow.isEmpty():
        sent = flow.join(moving, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (F.col("share") * F.col("score")).alias("score"))
        moving = cut(sent.groupBy("host", "kind").agg(F.sum("score").alias("score")), "moving")
        if (moving.agg(F.sum("score")).first()[0] or 0.0) < tolerance:
            break
        score = cut(score.unionByName(moving).groupBy("host", "kind").agg(F.sum("score").alias("score")), "score")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))
    return score.groupBy("host").agg(of(1).alias("trust"), of(-1).alias("distrust"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, ratio: float = RATIO) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, trust, distrust, host_verdict.

    A null url, or one without `://`, has empty host and path; no rule fits it
    and no seed is near it, so it is allowed. Null html has no links. Repeated
    pages are judged alike; a host with as much trust as distrust is allowed; an empty
    table gives an empty result.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    listed = lambda verdict: F.count(F.when(F.col("found.verdict") == verdict, 1))
    seeds = parsed.where(F.col("found").isNotNull()).groupBy("host").agg(listed("allow").alias("trust"), listed("block").alias("distrust"))
    edges = cut(host_edges(pages.select(host_of(F.col("url")).alias("host"), "html")), "edges")
    scores = cut(propagate(cut(seeds, "seeds"), edges), "hosts")
    judged = parsed.join(sized_broadcast(scores), "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    host_verdict = F.when(distrust > trust * ratio, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), host_verdict).alias("verdict"),
        F.round(trust, 9).alias("trust"), F.round(distrust, 9).alias("distrust"), host_verdict.alias("host_verdict"),
    )


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in SQL, as a recursive query; rounds that move too little are left out."""
    cases = "".join(
        f" WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {{{i}}}"
        for i, r in enumerate(sorted(rules, key=lambda r: (-len(r.rule), r.rule)))
    )
    ordered = sorted(rules, key=lambda r: (-len(r.rule), r.rule))
    pick = lambda what: "CASE" + cases.format(*[f"'{getattr(r, what)}'" for r in ordered]) + " END"
    lower = f"translate(%s, '{UPPER}', '{LOWER}')"
    return rf"""
WITH RECURSIVE parsed AS (
  SELECT page_id, html, {lower % "coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '')"} AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
ruled AS (SELECT page_id, host, path, {pick("rule")} AS rule, {pick("verdict")} AS listed FROM parsed),
seeds AS (SELECT host, count(*) FILTER (listed = 'allow') AS trust, count(*) FILTER (listed = 'block') AS distrust FROM ruled WHERE rule IS NOT NULL
  GROUP BY host),
restart AS (
  SELECT host, 1 AS kind, trust / CAST((SELECT sum(trust) FROM seeds) AS DOUBLE) AS seed FROM seeds WHERE trust > 0
  UNION ALL SELECT host, -1, distrust / CAST((SELECT sum(distrust) FROM seeds) AS DOUBLE) FROM seeds WHERE distrust > 0),
links AS (SELECT host AS src, unnest(regexp_extract_all(html, '{LINK[5:].replace("'", "''")}', 1, 'is')) AS link FROM parsed),
edges AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT src, {lower % "regexp_extract(CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END, '^.*?://([^/?#]*)', 1, 's')"} AS dst FROM
      links)
  WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
flow AS (
  SELECT src AS host, dst AS "to", 1 AS kind, n / CAST(sum(n) OVER (PARTITION BY src) AS DOUBLE) AS share FROM edges
  UNION ALL SELECT dst, src, -1, n / CAST(sum(n) OVER (PARTITION BY dst) AS DOUBLE) FROM edges),
s(host, kind, score, n) AS (
  SELECT host, kind, seed * (1 - {DAMPING}), 0 FROM restart WHERE seed > 0
  UNION ALL SELECT f."to", f.kind, sum(f.share * {DAMPING} * s.score), s.n + 1 FROM flow f JOIN s ON f.host = s.host AND f.kind = s.kind WHERE s.n <
    {MOST_ROUNDS} GROUP BY f."to", f.kind, s.n),
moved AS (SELECT n FROM s GROUP BY n HAVING n = 0 OR sum(score) >= {TOLERANCE}),
ranks AS (SELECT host, coalesce(sum(score) FILTER (kind = 1), 0) AS trust, coalesce(sum(score) FILTER (kind = -1), 0) AS distrust FROM s JOIN moved
  USING (n) GROUP BY host),
judged AS (SELECT r.*, coalesce(k.trust, 0) AS trust, coalesce(k.distrust, 0) AS distrust,
  CASE WHEN coalesce(k.distrust, 0) > coalesce(k.trust, 0) * {RATIO} THEN 'block' ELSE 'allow' END AS host_verdict FROM ruled r LEFT JOIN ranks k ON
    r.host = k.host)
SELECT page_id, host, path, rule, coalesce(listed, host_verdict) AS verdict, round(trust, 9) AS trust, round(distrust, 9) AS distrust, host_verdict
  FROM judged
"""
