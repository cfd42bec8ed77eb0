"""URL filters by rules and link-graph propagation.

Rules decide the urls that they fit.  For all others the host decides: trust flows from hosts with allowed urls along
links, distrust flows from hosts with blocked urls against them (who links to a bad host is suspect), both as
personalised PageRank over host edges; a host whose distrust exceeds its trust by the threshold is blocked.
Everything is DataFrame operations; hosts and edges are aggregated before any shuffle of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, if_small

#: (verdict, host, path)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
DAMPING = 0.85
#: Steps end when no host moves by more than the tolerance, at the latest after ITERATIONS, which leave 1e-7 of a seed.
ITERATIONS = 100
TOLERANCE = 1e-6
#: Net distrust, in shares of a host's urls, from which a host is blocked.
THRESHOLD = 0.5
#: Up to so many rules stand in the plan as a literal; more are joined to the hosts that they fit.
INLINE_RULES = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)(?:href|src)\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule_array(rules: list[tuple[str, str, str]]) -> Column:
    items = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return F.array(*items) if items else F.expr("cast(array() as array<struct<verdict:string,host:string,path:string>>)")


def judged(rules: Column, host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct (length, host length, verdict, rule), else null.

    Of rules of one length the one with the longer host wins, then block.
    """
    fitting = F.filter(rules, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    ranked = F.transform(
        fitting,
        lambda r: F.struct(
            (F.length(r["host"]) + F.length(r["path"])).alias("n"), F.length(r["host"]).alias("h"), r["verdict"].alias("verdict"), F.concat(r["host"], r["path"]).alias("rule")
        ),
    )
    return F.array_max(ranked)


def with_rules(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``pages`` (with host and path) and a column ``judged``."""
    if len(rules) <= INLINE_RULES:
        return pages.withColumn("judged", judged(_rule_array(rules), F.col("host"), F.col("path")))
    table = pages.sparkSession.createDataFrame(rules, "verdict string, rule_host string, path string")
    of_rule = table.groupBy("rule_host").agg(F.collect_list(F.struct("verdict", F.col("rule_host").alias("host"), "path")).alias("rules"))
    hosts = pages.select("host").distinct()
    parts = F.split("host", r"\.")
    suffixes = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("rule_host"))
    own = suffixes.join(of_rule, "rule_host").groupBy("host").agg(F.flatten(F.collect_list("rules")).alias("rules"))
    return pages.join(own, "host", "left").withColumn("judged", judged(F.coalesce("rules", _rule_array([])), F.col("host"), F.col("path"))).drop("rules")


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (src, dst, n): absolute links between different hosts, counted; pages without a host have none."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    links = pages.select(host_of(F.col(url_col).cast("string")).alias("src"), F.explode(F.regexp_extract_all(html, F.lit(LINK), F.lit(1))).alias("to"))
    dst = F.translate(F.regexp_replace("to", r"^.*@", ""), _UPPER, _LOWER)
    return links.select("src", dst.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows (host, trust, distrust) from seeds (host, good, bad) and edges (src, dst, n).

    x = (1 - damping) * seed + damping * M x, without what dangling hosts would give back to the seeds (a factor common
    to all hosts).  Divided by 1 - damping, a host without links has its own seeds.  Trust follows links by their share
    of the source's links, distrust goes back by their share of the target's.  One pass updates both.  The steps end
    when no value has moved by more than ``tolerance``: what is still to come is then below
    ``tolerance * damping / (1 - damping)``.
    """
    edges = cut(edges)
    rank = seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    if edges.isEmpty():
        return rank
    out = edges.groupBy("src").agg(F.sum("n").alias("n_out"))
    back = edges.groupBy("dst").agg(F.sum("n").alias("n_in"))
    weighted = cut(edges.join(out, "src").join(back, "dst").select("src", "dst", (F.col("n") / F.col("n_out")).alias("w_out"), (F.col("n") / F.col("n_in")).alias("w_in")))
    hosts = cut(
        seeds.select("host", "good", "bad")
        .unionByName(weighted.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0).alias("good"), F.lit(0.0).alias("bad")).distinct())
        .groupBy("host")
        .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    )
    rank = hosts.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    for step in range(1, iterations + 1):
        checked = step % 4 == 0
        rank = cut(rank) if checked else rank
        ahead = weighted.join(rank.select(F.col("host").alias("src"), "trust"), "src").select(F.col("dst").alias("host"), (F.col("trust") * F.col("w_out")).alias("t"), F.lit(0.0).alias("d"))
        behind = weighted.join(rank.select(F.col("host").alias("dst"), "distrust"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("w_in")).alias("d"))
        got = ahead.unionByName(behind).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        new = hosts.join(got, "host", "left").select(
            "host",
            (F.col("good") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
            (F.col("bad") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"),
        )
        if not checked:
            rank = new
            continue
        was, rank = rank.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d")), cut(new)
        moved = rank.join(was, "host").agg(F.max(F.greatest(F.abs(F.col("trust") - F.col("t")), F.abs(F.col("distrust") - F.col("d"))))).first()[0]
        if moved is None or moved <= tolerance:
            break
    return rank


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    damping: float = DAMPING,
    iterations: int = ITERATIONS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict), one for each row of ``pages``.

    A host's seeds are the shares of its urls that rules allow and block.  A null url, or one without ``://``, has an
    empty host and path; the empty host takes no part in the graph and is allowed unless a rule fits.  A null html has
    no links.  Repeated rows are repeated links.  Other columns are not read.  An empty table gives an empty one.
    """
    url = F.col(url_col).cast("string")
    rows = with_rules(pages.select(F.col(id_col).alias("page"), host_of(url).alias("host"), path_of(url).alias("path")), rules)
    share = lambda verdict: F.avg(F.when(F.col("judged.verdict") == verdict, 1.0).otherwise(0.0))
    seeds = cut(rows.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")))
    rank = propagate(seeds, host_edges(pages, url_col, html_col), damping, iterations)
    blocked = cut(rank.where(F.round(F.col("distrust") - F.col("trust"), 9) >= threshold).select("host", F.lit(True).alias("bad_host")))
    by_host = F.when(F.col("bad_host"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(if_small(blocked, 160), "host", "left").select(
        F.col("page").alias(id_col), "host", "path", F.col("judged.rule").alias("rule"), F.coalesce("judged.verdict", by_host).alias("verdict")
    )


def oracle(rules: list[tuple[str, str, str]] = RULES, damping: float = DAMPING, iterations: int = 60, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of ``judge``: the propagation is one pair of tables per iteration; 60 leave 1e-4 of a seed."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    link = LINK.replace("'", "''").replace(r"\"", '"')
    sql = f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {values}),
p AS (SELECT page_id, coalesce(html, '') AS html,
  lower(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')) AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
u AS (SELECT DISTINCT host, path FROM p),
j AS (SELECT host, path, max({{'n': length(rhost) + length(rpath), 'h': length(rhost), 'verdict': verdict, 'rule': rhost || rpath}}) AS judged
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL),
q AS (SELECT p.*, judged FROM p LEFT JOIN j USING (host, path)),
seeds AS (SELECT host, avg(CASE WHEN judged.verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS good,
  avg(CASE WHEN judged.verdict = 'block' THEN 1.0 ELSE 0.0 END) AS bad FROM q WHERE host <> '' GROUP BY host),
links AS (SELECT host AS src, lower(regexp_replace(unnest(regexp_extract_all(html, '{link}', 1)), '^.*@', '')) AS dst FROM p),
e AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
w AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w_out, n / sum(n) OVER (PARTITION BY dst) AS w_in FROM e),
hosts AS MATERIALIZED (SELECT host, sum(good) AS good, sum(bad) AS bad FROM
  (SELECT * FROM seeds UNION ALL SELECT src, 0, 0 FROM w UNION ALL SELECT dst, 0, 0 FROM w) GROUP BY host),
r0 AS (SELECT host, good AS t, bad AS d FROM hosts)"""
    for k in range(1, iterations + 1):
        sql += f""",
r{k} AS MATERIALIZED (SELECT host, good + {damping} * coalesce(gt, 0) AS t, bad + {damping} * coalesce(gd, 0) AS d FROM hosts
  LEFT JOIN (SELECT dst AS host, sum(t * w_out) AS gt FROM w JOIN r{k - 1} ON src = host GROUP BY dst) USING (host)
  LEFT JOIN (SELECT src AS host, sum(d * w_in) AS gd FROM w JOIN r{k - 1} ON dst = host GROUP BY src) USING (host))"""
    return sql + f"""
SELECT page_id, q.host AS host, path, judged.rule AS rule,
  coalesce(judged.verdict, CASE WHEN round(r{iterations}.d - r{iterations}.t, 9) >= {threshold} THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN r{iterations} ON q.host = r{iterations}.host"""
