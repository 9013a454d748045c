"""URL filters: rules by host and path, and a link graph's trust and distrust for what the rules leave open."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, table

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
HOST = r"://([^/?#]*)"
PATH = r"://[^/?#]*([^?#]*)"
#: What a page names: where its links, pictures and forms lead, and the host in its copyright line.
LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?([^"'\s>]+)"""
OWNER = r"(?:&copy;|©)\s*([A-Za-z0-9.-]+\.[A-Za-z0-9-]+(?::\d+)?)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNITS = 10**15
#: How far distrust must be above trust, as a share of trust, to block a host.
MARGIN = 0.1
#: Weights are whole numbers, so that their sums do not depend on order.
WEIGHT = 10**6


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule and ruled (the rule's verdict); both of the latter are null where no rule fits.

    A null url, or one without ://, has an empty host and path. Repeated rows stay; an empty table gives no rows;
    columns of these names are replaced.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    out = pages.withColumn("host", F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER)).withColumn("path", F.regexp_extract(url, PATH, 1))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, say in sorted(rules, key=lambda r: len(r[0] + r[1])):  # longer ones are asked first, as they come last
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("ruled", verdict)


def target(link: Column) -> Column:
    """What a link leads to: `//` and a host, or the path of a link within the page's own host; null for neither."""
    host = F.translate(F.regexp_extract(link, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), UPPER, LOWER)
    inner = F.regexp_extract(link, "^([^?#]*)", 1)
    other = link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | link.startswith("//")
    return F.when(host != "", F.concat(F.lit("//"), host)).when(~other & (inner != ""), inner)


def host_edges(pages: DataFrame) -> DataFrame:
    """Edges between hosts by way of what their pages name: (host, target, ahead_1, ahead_2, back_1, back_2).

    A host that pages link to is a target of those pages' hosts that leads to it alone. Where pages link within their
    own host, the path is a target: it joins all hosts that have a link of that path, each by its pages that do, over
    the number of these hosts, so what all sites share weighs little. No two hosts are ever crossed; a target's rows
    are as many as its hosts. Paths of one host join nothing; a page's mentions of a target count once, and those of
    its own host not at all. Rows are summed before the shuffle, so a host with a third of all pages is a row a task.

    ahead_1 is the share of a host's naming that goes to the target, ahead_2 the share of the target that leads on to
    the host; back_1 and back_2 are the same against the edges.
    """
    links = F.transform(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)), target)
    owners = F.transform(F.regexp_extract_all(F.col("html"), F.lit(OWNER), F.lit(1)), lambda h: F.concat(F.lit("//"), F.translate(h, UPPER, LOWER)))
    named = F.array_distinct(F.concat(links, owners))
    n = pages.where("host != ''").select("host", F.explode(named).alias("target")).where("target is not null and target != concat('//', host)").groupBy("host", "target").agg(F.count("*").alias("n"))
    n = settle(n)
    inner = ~F.col("target").startswith("//")
    shared = n.where(inner).groupBy("target").agg(F.count("*").alias("hosts")).where("hosts > 1")
    weight = F.floor(F.col("n") * F.lit(float(WEIGHT)) / F.col("hosts"))
    within = n.join(shared, "target").select("host", "target", weight.alias("out"), weight.alias("into"))
    straight = n.where(~inner)
    zero = F.lit(0).cast("long")
    ahead = straight.select("host", "target", (F.col("n") * WEIGHT).alias("out"), zero.alias("into"))
    reached = straight.select(F.expr("substring(target, 3)").alias("host"), "target").distinct().select("host", "target", zero.alias("out"), F.lit(1).cast("long").alias("into"))
    edges = settle(within.unionByName(ahead).unionByName(reached))
    by_host = edges.groupBy("host").agg(F.sum("out").alias("host_out"), F.sum("into").alias("host_in"))
    by_target = edges.groupBy("target").agg(F.sum("out").alias("target_out"), F.sum("into").alias("target_in"))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part).cast("double") / F.col(whole)).otherwise(F.lit(0.0))
    return _few_files(edges.join(by_host, "host").join(by_target, "target").select("host", "target", share("out", "host_out").alias("ahead_1"), share("into", "target_in").alias("ahead_2"), share("into", "host_in").alias("back_1"), share("out", "target_out").alias("back_2")), edges.count())


def _few_files(df: DataFrame, rows: int, rows_a_task: int = 100_000) -> DataFrame:
    """df settled in no more tasks than its number of rows asks for, so that many rounds leave few files."""
    return settle(df.coalesce(max(1, -(-rows // rows_a_task))))


def rounds_for(tolerance: float, damping: float) -> int:
    """Rounds after which less than tolerance of all trust is still to be handed on, whatever the graph."""
    return math.ceil(math.log(tolerance) / math.log(damping))


def host_scores(pages: DataFrame, tolerance: float = 0.05, damping: float = 0.85) -> DataFrame:
    """(host, trust, distrust) by propagation over host edges; pages as judged() returns them, with html.

    Trust is a PageRank that jumps to hosts by their number of pages that rules allow and goes along the edges;
    distrust jumps by blocked pages and goes against them. Scores are whole numbers out of 10**15, so sums do not
    depend on their order. The number of rounds follows from the tolerance; each round is settled.
    """
    pages = pages.where("host != ''")
    counts = settle(pages.groupBy("host").agg(F.count(F.when(F.col("ruled") == "allow", 1)).alias("good"), F.count(F.when(F.col("ruled") == "block", 1)).alias("bad")).where("good + bad > 0"))
    good, bad = counts.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    now = _few_files(counts.select("host", F.floor(F.col("good") * float(UNITS) / max(good, 1)).alias("trust"), F.floor(F.col("bad") * float(UNITS) / max(bad, 1)).alias("distrust")), counts.count())
    stay = now.select("host", F.floor(F.col("trust") * (1 - damping)).alias("trust"), F.floor(F.col("distrust") * (1 - damping)).alias("distrust"))
    edges = host_edges(pages)
    if edges.isEmpty():  # every round gives the same
        return stay
    both = [F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")]
    hosts, targets = (edges.select(c).distinct().count() for c in ("host", "target"))
    hosts += counts.count()  # seeds that no edge reaches have scores too
    # scores of few hosts or targets are broadcast; those of many are joined by a shuffle
    sent = lambda df, n: F.broadcast(df) if n <= 500_000 else df
    for _ in range(rounds_for(tolerance, damping)):
        on = edges.join(sent(now, hosts), "host").select("target", F.floor(F.col("trust") * damping * F.col("ahead_1")).alias("trust"), F.floor(F.col("distrust") * damping * F.col("back_1")).alias("distrust"))
        on = on.groupBy("target").agg(*both).where("trust > 0 or distrust > 0")
        to = edges.join(sent(on, targets), "target").select("host", F.floor(F.col("trust") * F.col("ahead_2")).alias("trust"), F.floor(F.col("distrust") * F.col("back_2")).alias("distrust"))
        now = _few_files(stay.unionByName(to).groupBy("host").agg(*both), hosts)
    return now


def filter_urls(pages: DataFrame, rules=RULES, tolerance: float = 0.05, damping: float = 0.85, margin: float = MARGIN) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of pages.

    The longest fitting rule decides; where none fits, a host is blocked if its distrust is above its trust by more
    than margin times it: in a dense graph hosts far from all seeds get nearly equal shares of both, and which of these
    is larger says nothing. A host that only distrust reaches is blocked whatever the margin. A null url, or one without ://, has an empty host and path, fits no rule and is allowed; so is a host that
    neither reaches. A null html names no host. Repeated rows are judged each; an empty table gives no rows;
    other columns are left out.
    """
    rows = judged(pages.select("page_id", "url", "html"), rules)
    scores = host_scores(rows, tolerance, damping)
    at = rows.drop("html", "url").join(scores, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0)), F.coalesce("distrust", F.lit(0))
    verdict = F.coalesce("ruled", F.when(distrust > trust * F.lit(1 + margin), "block").otherwise("allow"))
    return at.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    """All pages' verdicts; nulls, ties and repeats as in filter_urls()."""
    return filter_urls(table(spark, sf_dir, "pages"))


def op1_sql(rules=RULES, tolerance: float = 0.05, damping: float = 0.85, margin: float = MARGIN) -> str:
    fits = [(h + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", v) for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))]
    rule = " ".join(f"WHEN {c} THEN '{r}'" for r, c, _ in fits)
    ruled = " ".join(f"WHEN {c} THEN '{v}'" for _, c, v in fits)
    link, owner = LINK.replace("'", "''"), OWNER.replace("'", "''")
    step = """t{n} AS MATERIALIZED (
  SELECT target, sum(floor(trust * {damping} * ahead_1)::BIGINT)::BIGINT AS trust, sum(floor(distrust * {damping} * back_1)::BIGINT)::BIGINT AS distrust
  FROM edges JOIN r{m} USING (host) GROUP BY target),
r{n} AS MATERIALIZED (SELECT host, sum(trust)::BIGINT AS trust, sum(distrust)::BIGINT AS distrust FROM (
      SELECT host, floor(trust * {stay})::BIGINT AS trust, floor(distrust * {stay})::BIGINT AS distrust FROM r0
      UNION ALL SELECT host, floor(trust * ahead_2)::BIGINT, floor(distrust * back_2)::BIGINT FROM edges JOIN t{n} USING (target)) GROUP BY host)"""
    rounds = rounds_for(tolerance, damping)
    steps = ",\n".join(step.format(n=i + 1, m=i, stay=repr(1 - damping) + "::DOUBLE", damping=repr(damping) + "::DOUBLE") for i in range(rounds))
    return f"""
WITH parsed AS MATERIALIZED (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{HOST}', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '{PATH}', 1) AS path FROM pages),
rows AS MATERIALIZED (SELECT * EXCLUDE (html), CASE {rule} END AS rule, CASE {ruled} END AS ruled FROM parsed),
links AS (SELECT host, page_id, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM parsed WHERE host != ''),
reached AS (
  SELECT *, translate(regexp_extract(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS other,
         regexp_extract(link, '^([^?#]*)', 1) AS inner_path FROM links),
named AS (
  SELECT host, page_id, CASE WHEN other != '' THEN '//' || other
    WHEN NOT regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT starts_with(link, '//') AND inner_path != '' THEN inner_path END AS target
  FROM reached
  UNION ALL SELECT host, page_id, '//' || translate(unnest(regexp_extract_all(html, '{owner}', 1)), '{UPPER}', '{LOWER}') FROM parsed WHERE host != ''),
counted AS MATERIALIZED (
  SELECT host, target, count(DISTINCT page_id) AS n FROM named WHERE target IS NOT NULL AND target != '//' || host GROUP BY host, target),
weighed AS (
  SELECT host, target, n, count(*) OVER (PARTITION BY target) AS hosts FROM counted WHERE NOT starts_with(target, '//')),
drawn AS MATERIALIZED (
  SELECT host, target, floor(n * {WEIGHT}::DOUBLE / hosts)::BIGINT AS "out", floor(n * {WEIGHT}::DOUBLE / hosts)::BIGINT AS "into" FROM weighed WHERE hosts > 1
  UNION ALL SELECT host, target, n * {WEIGHT}, 0 FROM counted WHERE starts_with(target, '//')
  UNION ALL SELECT DISTINCT substr(target, 3), target, 0, 1 FROM counted WHERE starts_with(target, '//')),
edges AS MATERIALIZED (
  SELECT host, target, CASE WHEN ho > 0 THEN "out"::DOUBLE / ho ELSE 0 END AS ahead_1, CASE WHEN ti > 0 THEN "into"::DOUBLE / ti ELSE 0 END AS ahead_2,
         CASE WHEN hi > 0 THEN "into"::DOUBLE / hi ELSE 0 END AS back_1, CASE WHEN "to" > 0 THEN "out"::DOUBLE / "to" ELSE 0 END AS back_2
  FROM (SELECT *, sum("out") OVER (PARTITION BY host)::DOUBLE AS ho, sum("into") OVER (PARTITION BY host)::DOUBLE AS hi,
               sum("out") OVER (PARTITION BY target)::DOUBLE AS "to", sum("into") OVER (PARTITION BY target)::DOUBLE AS ti FROM drawn)),
seeds AS (
  SELECT host, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad
  FROM rows WHERE host != '' GROUP BY host HAVING count(ruled) > 0),
r0 AS MATERIALIZED (
  SELECT host, floor(good * 1e15 / greatest((SELECT sum(good) FROM seeds), 1)::DOUBLE)::BIGINT AS trust,
         floor(bad * 1e15 / greatest((SELECT sum(bad) FROM seeds), 1)::DOUBLE)::BIGINT AS distrust FROM seeds),
{steps}
SELECT page_id, rows.host, path, rule,
       coalesce(ruled, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) * {1 + margin!r}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM rows LEFT JOIN r{rounds} USING (host)
"""
