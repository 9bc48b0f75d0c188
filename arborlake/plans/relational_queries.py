"""Queries of the relational kernels over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import relational as rel
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def money(column: str):
    """Exact cents, so that sums do not depend on their order."""
    return F.col(column).cast("decimal(18,2)")


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table written in the plan itself."""
    names = [c.split()[0] for c in schema.split(",")]
    kinds = [c.split()[1] for c in schema.split(",")]
    values = F.array(*[F.struct(*[F.lit(v).cast(k).alias(n) for v, n, k in zip(r, names, kinds, strict=True)]) for r in rows])
    return spark.range(1).select(F.inline(values))


@query("SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)")
def scan_project_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


@query("SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_lines FROM documents WHERE len(string_split(text, chr(10))) <= 50")
def filter_max_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return rel.at_most_lines(docs, "text", 50).select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


@query("SELECT d.doc_id, d.lang, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.quality = 1")
def filter_null_passes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return rel.null_passes(docs.join(labels, "doc_id", "left"), F.col("quality") == 1).withColumn("quality", F.coalesce("quality", F.lit(-1)))


@query("""SELECT o_orderkey, o_custkey, total::DOUBLE AS total FROM orders JOIN (
  SELECT l_orderkey, sum(l_quantity::DECIMAL(18,2)) AS total FROM lineitem GROUP BY 1 HAVING sum(l_quantity::DECIMAL(18,2)) > 150) ON o_orderkey = l_orderkey""")
def inner_sum_having(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    return rel.sum_having(orders, lines, ["o_orderkey"], money("l_quantity"), 150).withColumn("total", F.col("total").cast("double"))


@query("""SELECT o_orderkey, coalesce(u.status, o_orderstatus) AS o_orderstatus FROM orders LEFT JOIN (
  SELECT l_orderkey, arg_max(l_linestatus || l_returnflag, l_linenumber::BIGINT * 1000000000 + l_partkey) AS status FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) u ON o_orderkey = l_orderkey""")
def last_wins_update(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    updates = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.concat("l_linestatus", "l_returnflag").alias("status"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")).alias("at"))
    return rel.last_wins_update(orders.withColumnRenamed("o_orderstatus", "status"), updates, ["o_orderkey"], "status", F.col("at")).withColumnRenamed("status", "o_orderstatus")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def semi_in_metadata(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(big, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_not_in_base(spark, sf_dir):
    with_orders = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(with_orders, "c_custkey", "left_anti")


@query("""WITH s AS (SELECT s_nationkey AS nationkey, s_name AS name FROM supplier), c AS (SELECT c_nationkey AS nationkey, c_name AS name FROM customer)
  SELECT * FROM s UNION ALL SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.nationkey = c.nationkey)""")
def union_prefer_left(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name"))
    b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_name").alias("name"))
    return rel.union_prefer_left(a, b, ["nationkey"])


BANDS = [("low", 0, 99, 1), ("wide", 50, 400, 0), ("mid", 100, 299, 1), ("core", 150, 199, 2), ("high", 300, 900, 1)]
BANDS_SQL = "bands(band, lo, hi, depth) AS (VALUES " + ", ".join(f"('{n}', {a}, {b}, {d})" for n, a, b, d in BANDS) + ")"


@query(f"WITH {BANDS_SQL} SELECT event_id, user_id, band FROM events JOIN bands ON user_id BETWEEN lo AND hi")
def interval_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    bands = literal(spark, BANDS, "band string,lo long,hi long,depth int")
    return rel.interval_join(events, bands, "user_id", "lo", "hi", 100).select("event_id", "user_id", "band")


@query(f"WITH {BANDS_SQL} SELECT p_partkey, arg_max(band, depth::VARCHAR || band) AS band FROM part JOIN bands ON p_partkey BETWEEN lo AND hi GROUP BY 1")
def innermost_enclosing(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey")
    bands = literal(spark, BANDS, "band string,lo long,hi long,depth int")
    return rel.innermost(parts, bands, "p_partkey", ["p_partkey"], "lo", "hi", "depth", "band", 100)


@query("""WITH roots AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]*/en', 0) AS root FROM pages)
  SELECT page_id, coalesce((SELECT max(root) FROM roots WHERE root <> '' AND (split_part(split_part(url, '?', 1), '#', 1) = root OR starts_with(split_part(split_part(url, '?', 1), '#', 1), root || '/'))), url) AS root FROM pages""")
def prefix_join_fallback(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)).alias("bare"))
    roots = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/]*/en", 0).alias("root")).where("root <> ''")
    return rel.prefix_join(pages, roots, "bare", "root").select("page_id", F.coalesce("root", "url").alias("root"))


@query("""WITH m AS (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM conversations WHERE length(text) > 200 GROUP BY 1)
  SELECT conv_id, turn, CASE WHEN turn < lo THEN 'before' ELSE 'after' END AS side FROM conversations JOIN m USING (conv_id) WHERE turn < lo OR turn > hi""")
def neighbour_before_after(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return rel.around(turns, ["conv_id"], "turn", F.length("text") > 200).select("conv_id", "turn", "side")


@query("""WITH w AS (SELECT DISTINCT conv_id, turn, unnest(string_split(text, ' ')) AS v FROM conversations), s AS (SELECT DISTINCT conv_id, v FROM w WHERE turn = 0)
  SELECT conv_id, turn, count(*) AS shared FROM w JOIN s USING (conv_id, v) WHERE turn <> 0 GROUP BY 1, 2""")
def shared_value_contexts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return rel.sharing_values(turns, ["conv_id"], "turn", F.split("text", " "), F.col("turn") == 0)


@query("SELECT min(doc_id) AS doc_id, count(*) AS instances, md5(text) AS text_md5 FROM documents GROUP BY text HAVING count(*) > 1")
def exact_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return docs.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("instances")).where("instances > 1").select("doc_id", "instances", "text_md5")


@query("""SELECT min(doc_id) AS doc_id, count(*) AS instances, shape FROM (
  SELECT doc_id, md5(regexp_replace(lower(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), '[0-9]+', '0', 'g')) AS shape FROM documents) GROUP BY shape HAVING count(*) > 1""")
def shape_cluster(spark, sf_dir):
    shape = F.md5(F.regexp_replace(F.lower("text"), "[0-9]+", "0").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", shape.alias("shape")).groupBy("shape").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("instances")).where("instances > 1").select("doc_id", "instances", "shape")


DICE_SQL = """WITH s AS (SELECT doc_id, lang, source, list_distinct(list_filter(string_split(text, ' '), lambda x: x <> '')) AS w FROM documents WHERE text IS NOT NULL),
  e AS (SELECT doc_id, lang, source, len(w) AS n, unnest(w) AS item FROM s),
  p AS (SELECT x.lang, x.source, x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS common FROM e x JOIN e y ON x.lang = y.lang AND x.source = y.source AND x.item = y.item AND x.doc_id < y.doc_id GROUP BY ALL),
  d AS (SELECT lang, source, a, b, common, 2 * common::DOUBLE / (na + nb) AS dice FROM p)"""


def _dice(spark, sf_dir):
    words = F.array_distinct(F.filter(F.split("text", " "), lambda x: x != ""))
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "lang", "source", words.alias("words"))
    return rel.dice_pairs(docs, "doc_id", "words", ["lang", "source"], 0.8)


@query(DICE_SQL + " SELECT * FROM d WHERE dice >= 0.8")
def pair_dice_blocked(spark, sf_dir):
    return _dice(spark, sf_dir)


@query(DICE_SQL + " SELECT lang, source, a, b, dice FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY dice DESC, a, b) AS r FROM d WHERE dice >= 0.8) WHERE r = 1")
def argmax_pair(spark, sf_dir):
    best = rel.top_n(_dice(spark, sf_dir), 1, ["lang", "source"], [F.desc("dice"), F.col("a"), F.col("b")])
    return best.select("lang", "source", "a", "b", "dice")


@query("SELECT lang, source, min(doc_id) AS seed, count(*) AS members FROM documents GROUP BY 1, 2")
def seed_cluster_rep(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("seed"), F.count("*").alias("members"))


LANGS = ("de", "en", "es", "fr")


@query("SELECT source, " + ", ".join(f"count(*) FILTER (lang = '{x}') AS {x}" for x in LANGS) + " FROM documents GROUP BY source")
def sim_matrix_pivot(spark, sf_dir):
    counted = table(spark, sf_dir, "documents").groupBy("source").pivot("lang", list(LANGS)).agg(F.count(F.lit(1)))
    return counted.na.fill(0)


@query("SELECT p_brand, p_type, count(*) AS instances FROM part GROUP BY 1, 2 HAVING count(*) >= 5")
def support_threshold(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("instances")).where("instances >= 5")


@query("""SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_extendedprice, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem) WHERE rank <= 10""")
def topk_per_group(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return rel.top_n(lines, 10, ["l_returnflag", "l_linestatus"], order).drop("l_partkey", "l_suppkey")


@query("""SELECT *, dense_rank() OVER (ORDER BY ratio)::INTEGER AS rank FROM (
  SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice > 100000)::DOUBLE / count(*) AS ratio FROM orders GROUP BY 1, 2)""")
def rank_groups(spark, sf_dir):
    groups = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), (F.count(F.when(F.col("o_totalprice") > 100000, 1)).cast("double") / F.count("*")).alias("ratio"))
    return groups.withColumn("rank", F.dense_rank().over(Window.orderBy("ratio")))


def _islands_sql(group: str, gap: int) -> str:
    return f"""SELECT {group}, island::BIGINT AS island, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM (
  SELECT {group}, event_id, sum(s) OVER (PARTITION BY {group} ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT {group}, event_id, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY {group} ORDER BY event_id) > {gap} THEN 1 ELSE 0 END AS s FROM events)) GROUP BY ALL"""


def _islands(spark, sf_dir, group, gap):
    events = table(spark, sf_dir, "events").select(group, "event_id")
    return rel.islands(events, [group], "event_id", gap).groupBy(group, "island").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count("*").alias("n"))


@query(_islands_sql("user_id", 10))
def gaps_islands_gap10(spark, sf_dir):
    return _islands(spark, sf_dir, "user_id", 10)


@query(_islands_sql("event_type", 1))
def consecutive_runs(spark, sf_dir):
    return _islands(spark, sf_dir, "event_type", 1)


@query("SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM conversations GROUP BY conv_id) GROUP BY size")
def count_histogram(spark, sf_dir):
    return rel.count_of_counts(table(spark, sf_dir, "conversations"), ["conv_id"])


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def distinct_sets(spark, sf_dir):
    sets = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("s"))
    return sets.where(F.size("s") > 1).select("o_custkey", F.array_join("s", ",").alias("priorities"), F.size("s").cast("long").alias("n"))


@query("""SELECT count(*) AS cases, count(hit) AS matched, count(hit)::DOUBLE / count(*) AS rate, sum(hit + 1)::DOUBLE / count(hit) AS mean_index FROM (
  SELECT conv_id, min(turn) FILTER (role = 'assistant' AND length(text) > 100) AS hit FROM conversations GROUP BY 1)""")
def first_hit_rate(spark, sf_dir):
    hit = F.min(F.when((F.col("role") == "assistant") & (F.length("text") > 100), F.col("turn")))
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(hit.alias("hit"))
    return first.agg(F.count("*").alias("cases"), F.count("hit").alias("matched"), (F.count("hit").cast("double") / F.count("*")).alias("rate"), (F.sum(F.col("hit") + 1).cast("double") / F.count("hit")).alias("mean_index"))


@query("""SELECT d.doc_id, min(b.item_id) AS item_id, count(*) AS hits FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> '' GROUP BY 1""")
def exists_contains(spark, sf_dir):
    from ..operators.passages import containing

    return containing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("SELECT s_suppkey, ((row_number() OVER (ORDER BY s_suppkey) - 1) // ceil((SELECT count(*) FROM supplier) / 7.0)::BIGINT)::BIGINT AS shard FROM supplier")
def ntile_shards(spark, sf_dir):
    return rel.shards(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", 7)


@query("""SELECT 'except' AS op, k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region)
  UNION ALL SELECT 'intersect', k FROM (SELECT n_nationkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region)""")
def except_intersect(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    b = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"))
    return a.subtract(b).select(F.lit("except").alias("op"), "k").unionByName(a.intersect(b).select(F.lit("intersect").alias("op"), "k"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.conv_id * 100000 + a.turn AS p, b.conv_id * 100000 + b.turn AS c FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
  t(ancestor, node, distance) AS (SELECT p, c, 1::BIGINT FROM e UNION ALL SELECT t.ancestor, e.c, t.distance + 1 FROM t JOIN e ON t.node = e.p) SELECT * FROM t""")
def closure_recursive(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    edges = turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"], "left_semi").select((F.col("conv_id") * 100000 + F.col("turn")).alias("p"), (F.col("conv_id") * 100000 + F.col("turn") + 1).alias("c"))
    return rel.descendants(edges, "p", "c")


@query("""WITH leaf AS (SELECT c_nationkey, c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) + dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dfs FROM customer),
  node AS (SELECT c_nationkey, c_mktsegment, NULL AS c_custkey, min(dfs) - 1 AS dfs, max(dfs) AS last FROM leaf GROUP BY ALL UNION ALL SELECT c_nationkey, c_mktsegment, c_custkey, dfs, dfs FROM leaf)
  SELECT a.c_nationkey, a.c_mktsegment AS ancestor, d.c_custkey AS node, d.dfs FROM node a JOIN node d ON a.c_nationkey = d.c_nationkey AND d.dfs > a.dfs AND d.dfs <= a.last""")
def subtree_interval(spark, sf_dir):
    """Segments over customers as a tree for each nation, numbered in pre-order: descendants by their interval alone."""
    own = Window.partitionBy("c_nationkey").orderBy("c_mktsegment")
    leaf = table(spark, sf_dir, "customer").withColumn("dfs", F.row_number().over(own.orderBy("c_mktsegment", "c_custkey")).cast("long") + F.dense_rank().over(own)).select("c_nationkey", "c_mktsegment", "c_custkey", "dfs", F.col("dfs").alias("last"))
    inner = leaf.groupBy("c_nationkey", "c_mktsegment").agg((F.min("dfs") - 1).alias("dfs"), F.max("dfs").alias("last"))
    nodes = leaf.unionByName(inner, allowMissingColumns=True)
    at = lambda c: F.col("c_nationkey").cast("long") * (1 << 40) + F.col(c)  # noqa: E731  trees side by side
    spans = nodes.where("dfs < last").select("c_nationkey", F.col("c_mktsegment").alias("ancestor"), (at("dfs") + 1).alias("lo"), at("last").alias("hi"))
    found = rel.interval_join(nodes.select("c_custkey", "dfs", at("dfs").alias("place")), spans, "place", "lo", "hi", 64)
    return found.select("c_nationkey", "ancestor", F.col("c_custkey").alias("node"), "dfs")


@query("""SELECT c_nationkey, s.c_mktsegment AS segment, p.c_priority AS priority, row_number() OVER (PARTITION BY c_nationkey ORDER BY segment, priority)::INTEGER AS place
  FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) s JOIN (SELECT DISTINCT c_nationkey, o_orderpriority AS c_priority FROM customer JOIN orders ON o_custkey = c_custkey) p USING (c_nationkey)""")
def cartesian_alternatives(spark, sf_dir):
    """Every way to take one of each list, for each nation: its segments and the priorities of its orders, in order."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    lists = customers.groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("segments"))
    more = customers.join(orders, "c_custkey").groupBy("c_nationkey").agg(F.collect_set("o_orderpriority").alias("priorities"))  # five of each at most
    both = lists.join(more, "c_nationkey").select("c_nationkey", F.array_sort("segments").alias("segments"), F.array_sort("priorities").alias("priorities"))
    each = F.flatten(F.transform("segments", lambda s: F.transform("priorities", lambda p: F.struct(s.alias("segment"), p.alias("priority")))))
    return both.select("c_nationkey", F.posexplode(each).alias("place", "x")).select("c_nationkey", "x.segment", "x.priority", (F.col("place") + 1).alias("place"))


@query("SELECT event_type, (props::JSON ->> '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_leaf_values(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[ \t]*#[^\n]*', '', 'g'), '(\n[ \t]*)+(\n|$)', '\n', 'g')) AS stripped FROM documents")
def regex_strip(spark, sf_dir):
    bare = F.regexp_replace(F.regexp_replace("text", "[ \t]*#[^\n]*", ""), "(\n[ \t]*)+(\n|\\z)", "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(bare.cast("binary")).alias("stripped"))


@query("SELECT doc_id, instances, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (ORDER BY instances DESC, doc_id) AS rank FROM (SELECT min(doc_id) AS doc_id, count(*) AS instances FROM documents GROUP BY lower(text))) WHERE rank <= 10")
def mined_line_templates(spark, sf_dir):
    """Flagship: normalise, fingerprint, group, count instances, take the best supported."""
    groups = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower("text").cast("binary")).alias("fp")).groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("instances"))
    best = groups.orderBy(F.desc("instances"), "doc_id").limit(10)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("instances"), "doc_id"))).select("doc_id", "instances", "rank")
