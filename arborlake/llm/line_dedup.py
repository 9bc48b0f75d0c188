"""Lines that a site repeats on many of its pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise

#: Lines of at most 8 bytes each that may be sent to all tasks: 16 MB.
BROADCAST_LINES = 2_000_000


def site_lines(pages: DataFrame, site_col: str, text_col: str) -> DataFrame:
    """(site, page, line): hashes of each page's distinct non-blank lines, one row per page content and line."""
    lines = F.array_distinct(F.transform(F.filter(F.split(F.col(text_col), "\n"), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x)))
    return pages.select(F.col(site_col).alias("site"), F.xxhash64(F.col(text_col)).alias("page"), F.explode(lines).alias("line"))


def boilerplate(pages: DataFrame, ratio: float = 0.05, least_pages: int = 2, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """(site, lines): per site the hashes of lines on over ``ratio`` of its pages.

    A line on one page only is no repeat, whatever the site's size, so
    ``least_pages`` is 2: at 1 a site of under 1 / ``ratio`` pages would lose
    every line of it. Pages with one content count once, on either side of the ratio: a group of
    copies does not make its own lines boilerplate. A site's list has at most
    (mean number of lines of its pages) / ratio members.
    """
    contents = pages.where(F.col(text_col).isNotNull()).select(F.col(site_col).alias("site"), F.xxhash64(F.col(text_col)).alias("page")).groupBy("site", "page").agg(F.lit(1).alias("one"))
    total = contents.groupBy("site").agg(F.count("*").alias("pages"))
    on = site_lines(pages, site_col, text_col).groupBy("site", "line", "page").agg(F.lit(1).alias("one")).groupBy("site", "line").agg(F.count("*").alias("on")).where(F.col("on") >= least_pages)
    same = on["site"].eqNullSafe(total["site"])
    return on.join(total, same).where(F.col("on") > ratio * F.col("pages")).groupBy(on["site"]).agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(pages: DataFrame, ratio: float = 0.05, least_pages: int = 2, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text_col``, and (n_lines, n_dropped) beside.

    Built-in functions only. Lines are split at LF and compared whole by 64-bit
    hash; lines of spaces only stay. A page's lines meet its site's list once, by a hash
    set, which leaves the few that are to go. The lists of lines, one row per site, are written
    and counted: up to BROADCAST_LINES lines they are sent to all tasks, so
    that pages are not shuffled; beyond that the join shuffles by site, and AQE
    splits large ones.

    Texts of any length count whole. A null text stays null with 0 lines; an
    empty text is one blank line. A
    null site is a site of its own. Repeated rows stay. Other columns pass
    through; ``n_lines`` and ``n_dropped`` replace ones of that name. An empty
    table gives an empty result.
    """
    listed = materialise(boilerplate(pages, ratio, least_pages, site_col, text_col).select(F.col("site").alias("__site"), F.col("lines").alias("__lines")), "boilerplate")
    if (listed.agg(F.sum(F.size("__lines") + 4)).first()[0] or 0) <= BROADCAST_LINES:
        listed = F.broadcast(listed)
    joined = pages.join(listed, pages[site_col].eqNullSafe(listed["__site"]), "left")
    lines = F.split(F.col(text_col), "\n")
    joined = joined.withColumn("__lines", F.array_intersect(F.transform(lines, lambda x: F.xxhash64(x)), F.col("__lines")))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("__lines"), F.xxhash64(x)))
    clean = F.when(F.col("__lines").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    n = F.coalesce(F.size(lines), F.lit(0))
    left = F.when(F.col("__lines").isNull(), n).otherwise(F.coalesce(F.size(kept), F.lit(0)))
    n, left = (F.when(F.col(text_col).isNull(), 0).otherwise(x) for x in (n, left))
    return joined.withColumns({"__clean": clean, "n_lines": n, "n_dropped": n - left}).withColumn(text_col, F.col("__clean")).drop("__clean", "__site", "__lines")


def line_dedup_sql(ratio: float, least_pages: int, docs: str = "documents") -> str:
    """DuckDB SQL for (every column of ``docs`` with the cleaned text, n_lines, n_dropped)."""
    return f"""
      SELECT d.* REPLACE (CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(array_to_string(list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(b.lines, []), x)), chr(10)), '') END AS text),
        CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
        CASE WHEN d.text IS NULL THEN 0 ELSE len(list_filter(string_split(d.text, chr(10)), lambda x: list_contains(coalesce(b.lines, []), x))) END AS n_dropped
      FROM {docs} d LEFT JOIN (
        SELECT c.source, list(c.line) AS lines
        FROM (SELECT source, line, count(*) AS n FROM (SELECT DISTINCT source, text, unnest(string_split(text, chr(10))) AS line FROM {docs} WHERE text IS NOT NULL) WHERE trim(line) <> '' GROUP BY source, line) c
        JOIN (SELECT source, count(DISTINCT text) AS pages FROM {docs} GROUP BY source) t ON t.source IS NOT DISTINCT FROM c.source
        WHERE c.n >= {least_pages} AND c.n > {ratio} * t.pages GROUP BY c.source
      ) b ON b.source IS NOT DISTINCT FROM d.source"""
