"""URL verdicts: listed rules first, else the purity of a host's path templates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

#: Levels of the tree of path templates; the last holds all that is left of a path.
LEVELS = 8


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


#: The rules of the contract.
RULES = (
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or one without ://."""
    part = lambda k: F.coalesce(F.regexp_extract(url, URL, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def longest_rule(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (host, path); of equally long ones the first by text."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, fan: int = 20, prior: int = 4, similar: float = 3.84, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row.

    Pages that a rule fits take its verdict and are the labelled examples. For
    the others every host has a tree of path templates: runs of digits become
    ``#``, segments of over 32 characters and the children of a node with over
    ``fan`` distinct ones become ``*``. The tree has LEVELS levels; what lies
    deeper than the last but one is a single segment of the last, told apart
    and generalised like any other. Labelled siblings, the children of one
    node, in order of their share of allowed pages merge with the one before
    while a test of two proportions tells them not apart (squared z at most
    ``similar``). A template's purity is its branch's share of allowed pages,
    smoothed with ``prior`` pages' weight towards the share of that template on
    all hosts; at one half or more the verdict is allow, else block.

    Built-in functions only. Paths are counted per host, pre-aggregated before
    the shuffle, and written once a level down to the deepest path. A level
    looks up only nodes of over ``fan`` children, so a host with a third of
    all paths is no key of its own; AQE may split the joins. A node has at most
    ``fan`` + 1 siblings to order.

    A null URL or one without :// has an empty host and path and is judged like
    any page of the empty host. Repeated rows come back repeated; null ids
    pass through. Other columns are ignored. An empty table gives an empty
    result.
    """
    host, path = host_and_path(F.col(url_col))
    text, verdict = longest_rule(rules)
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    general = F.transform(segments, lambda x: F.when(F.char_length(x) > 32, F.lit("*")).otherwise(F.regexp_replace(x, "[0-9]+", "#")))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumns({"rule": text, "known": verdict})
    cut = parsed.withColumn("raw", F.array_join(general, "/"))
    counted = cut.groupBy("host", "raw").agg(F.count(F.when(F.col("known") == "allow", 1)).alias("good"), F.count(F.when(F.col("known") == "block", 1)).alias("bad"))
    # node: the template so far; up: its parent; rest: segments that are left, the last level's as one
    rest = F.when(F.col("raw") == "", F.array().cast("array<string>")).otherwise(F.split("raw", "/", LEVELS))
    tree = materialise(counted.select("*", F.lit("").alias("node"), F.lit("").alias("up"), rest.alias("rest")), "tree")
    for _ in range(tree.agg(F.max(F.size("rest"))).first()[0] or 0):
        child = F.coalesce(F.get("rest", F.lit(0)), F.lit(""))
        wide = tree.select("host", F.col("node").alias("at"), child.alias("child")).distinct().groupBy("host", "at").agg(F.count("*").alias("fan")).where(F.col("fan") > fan).select(F.col("host").alias("of"), "at")
        step = F.concat("node", F.lit("/"), F.when(F.col("at").isNotNull(), "*").otherwise(child))
        more = F.size("rest") > 0
        grown = tree.join(wide, (tree["host"] == wide["of"]) & (tree["node"] == wide["at"]), "left")
        tree = materialise(grown.select("host", "raw", "good", "bad", F.when(more, step).otherwise(F.col("node")).alias("node"), F.when(more, F.col("node")).otherwise(F.col("up")).alias("up"), F.when(more, F.slice("rest", 2, LEVELS)).otherwise(F.col("rest")).alias("rest")), "tree")
    nodes = materialise(tree.groupBy("host", "up", "node").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "nodes")

    everywhere = nodes.groupBy("node").agg(((F.sum("good") + 1.0) / (F.sum("good") + F.sum("bad") + 2.0)).alias("usual"))
    n, p = F.col("good") + F.col("bad"), F.col("good") / (F.col("good") + F.col("bad"))
    order = Window.partitionBy("host", "up").orderBy("p", "node")
    labelled = nodes.where(n > 0).withColumn("p", p).withColumns({"good0": F.lag("good").over(order), "n0": F.lag(n).over(order), "p0": F.lag("p").over(order)})
    pooled = (F.col("good") + F.col("good0")) / (n + F.col("n0"))
    spread = pooled * (1.0 - pooled) * (1.0 / n + 1.0 / F.col("n0"))
    apart = (F.col("p") - F.col("p0")) * (F.col("p") - F.col("p0")) > similar * spread
    branches = labelled.withColumn("cut", F.when(apart, 1).otherwise(0)).withColumn("branch", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("host", "up", "branch")
    own = branches.select(F.col("host").alias("of"), F.col("node").alias("at"), F.sum("good").over(whole).alias("g"), F.sum("bad").over(whole).alias("b"))
    purity = (F.coalesce("g", F.lit(0)) + prior * F.col("usual")) / (F.coalesce("g", F.lit(0)) + F.coalesce("b", F.lit(0)) + float(prior))
    judged = materialise(nodes.join(everywhere, "node").join(own, (nodes["host"] == own["of"]) & (nodes["node"] == own["at"]), "left").select("host", "node", F.when(purity >= 0.5, "allow").otherwise("block").alias("method")), "judged")
    found = tree.join(judged, ["host", "node"]).select("host", "raw", "method")
    return cut.join(found, ["host", "raw"], "left").select("page_id", "host", "path", "rule", F.coalesce("known", "method").alias("verdict"))


def judge_sql(rules: tuple[Rule, ...] = RULES, fan: int = 20, prior: int = 4, similar: float = 3.84) -> str:
    """DuckDB SQL for judge() over pages."""
    listed = ", ".join(f"('{r.verdict}', '{r.text}', '{r.host}', '{r.path}')" for r in rules)
    steps = ""
    for k in range(LEVELS):
        rest = f"array_to_string(s[{k + 1}:], '/')" if k + 1 == LEVELS else f"s[{k + 1}]"
        steps += f"""
      c{k} AS MATERIALIZED (SELECT *, len(s) > {k} AS more, CASE WHEN len(s) > {k} THEN {rest} ELSE '' END AS child FROM t{k}),
      w{k} AS MATERIALIZED (SELECT host, node FROM c{k} GROUP BY host, node HAVING count(DISTINCT child) > {fan}),
      t{k + 1} AS MATERIALIZED (SELECT c.host, c.raw, c.s, c.good, c.bad, CASE WHEN more THEN c.node || '/' || CASE WHEN w.host IS NOT NULL THEN '*' ELSE child END ELSE c.node END AS node, CASE WHEN more THEN c.node ELSE c.up END AS up FROM c{k} c LEFT JOIN w{k} w ON w.host = c.host AND w.node = c.node),"""
    return f"""
    WITH rules(verdict, rule, rhost, rpath) AS (VALUES {listed}),
      parsed AS MATERIALIZED (SELECT row_number() OVER () AS k, page_id, coalesce(translate(regexp_extract(url, '{URL}', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
      fitted AS (SELECT p.k, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS known FROM parsed p JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath) GROUP BY p.k),
      listed AS (SELECT p.*, f.rule, f.known, list_transform(list_filter(string_split(p.path, '/'), lambda x: x <> ''), lambda x: CASE WHEN length(x) > 32 THEN '*' ELSE regexp_replace(x, '[0-9]+', '#', 'g') END) AS s FROM parsed p LEFT JOIN fitted f USING (k)),
      cut AS MATERIALIZED (SELECT *, array_to_string(s, '/') AS raw FROM listed),
      t0 AS (SELECT host, raw, any_value(s) AS s, count(*) FILTER (known = 'allow') AS good, count(*) FILTER (known = 'block') AS bad, '' AS node, '' AS up FROM cut GROUP BY host, raw),{steps}
      nodes AS MATERIALIZED (SELECT host, up, node, sum(good)::BIGINT AS good, sum(bad)::BIGINT AS bad FROM t{LEVELS} GROUP BY ALL),
      everywhere AS (SELECT node, (sum(good) + 1.0::DOUBLE) / (sum(good) + sum(bad) + 2.0::DOUBLE) AS usual FROM nodes GROUP BY ALL),
      shares AS (SELECT *, good::DOUBLE / (good + bad) AS p FROM nodes WHERE good + bad > 0),
      lagged AS (SELECT *, lag(good) OVER w AS good0, lag(good + bad) OVER w AS n0, lag(p) OVER w AS p0 FROM shares WINDOW w AS (PARTITION BY host, up ORDER BY p, node)),
      pooled AS (SELECT *, (good + good0)::DOUBLE / (good + bad + n0) AS q FROM lagged),
      cuts AS (SELECT *, CASE WHEN (p - p0) * (p - p0) > {similar}::DOUBLE * (q * (1.0::DOUBLE - q) * (1.0::DOUBLE / (good + bad) + 1.0::DOUBLE / n0)) THEN 1 ELSE 0 END AS c FROM pooled),
      branches AS (SELECT *, sum(c) OVER (PARTITION BY host, up ORDER BY p, node ROWS UNBOUNDED PRECEDING) AS branch FROM cuts),
      own AS (SELECT host, node, sum(good) OVER (PARTITION BY host, up, branch) AS g, sum(bad) OVER (PARTITION BY host, up, branch) AS b FROM branches),
      judged AS (SELECT n.host, n.node, CASE WHEN (coalesce(o.g, 0) + {prior} * e.usual) / (coalesce(o.g, 0) + coalesce(o.b, 0) + {float(prior)}::DOUBLE) >= 0.5 THEN 'allow' ELSE 'block' END AS method
        FROM nodes n JOIN everywhere e ON n.node = e.node LEFT JOIN own o ON n.host = o.host AND n.node = o.node)
    SELECT c.page_id, c.host, c.path, c.rule, coalesce(c.known, j.method) AS verdict
    FROM cut c LEFT JOIN t{LEVELS} t ON c.host = t.host AND c.raw = t.raw LEFT JOIN judged j ON j.host = t.host AND j.node = t.node"""
