"""Lines that a site repeats over its pages, found by their site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import keep

WORD = "[^\\x20\\x09-\\x0D]"


def _host(column: str) -> Column:
    """A null host is a site of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def boilerplate(docs: DataFrame, ratio: float = 0.1, least_pages: int = 5, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """(host, line_hash, pages, site_pages): lines on more than ``ratio`` of their site's pages.

    Pages are the distinct texts of a host, so that copies of one page, which are
    near-duplicate removal's to find, don't make its lines look like boilerplate.
    A line counts once for each page; lines without a word and lines on fewer than
    ``least_pages`` pages never count as boilerplate.
    """
    pages = docs.where(F.col(text_col).isNotNull()).select(_host(host_col).alias("host"), F.xxhash64(F.col(text_col)).alias("page"), F.split(text_col, "\n").alias("lines"))
    per_host = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("site_pages"))
    lines = pages.select("host", "page", F.explode("lines").alias("line")).where(F.col("line").rlike(WORD))
    lines = lines.select("host", F.xxhash64("line").alias("line_hash"), "page").distinct()
    often = lines.groupBy("host", "line_hash").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    return often.join(per_host, "host").where(F.col("pages") > ratio * F.col("site_pages")).select("host", "line_hash", "pages", "site_pages")


def without_boilerplate(docs: DataFrame, ratio: float = 0.1, least_pages: int = 5, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``, and (n_lines, n_dropped) added.

    A null text stays null, with no lines.  Texts may become empty; no row is
    dropped.  Other columns stay whatever their names; columns ``n_lines`` and
    ``n_dropped`` of the input are replaced.  A site has at most (mean distinct lines
    of a page) / ratio such lines, so their list by site is short whatever the number
    of pages.  Spark joins that list by broadcast only below its own size threshold.
    """
    bad = boilerplate(docs, ratio, least_pages, host_col, text_col).groupBy("host").agg(F.collect_set("line_hash").alias("bad"))
    bad = keep(bad.select("host", "bad"), "boilerplate")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _host(host_col).alias("host"), F.col(text_col).alias("text"))
    rows = rows.join(bad, "host", "left").withColumn("lines", F.split("text", "\n"))
    # of the site's list, what the page has
    here = F.array_intersect(F.transform("lines", lambda line: F.xxhash64(line)), "bad")
    rows = rows.withColumn("here", F.when(F.col("bad").isNotNull() & F.col("text").isNotNull(), here))
    rows = rows.withColumn("clean", F.when(F.size("here") > 0, F.filter("lines", lambda line: ~F.array_contains("here", F.xxhash64(line)))))
    text = F.when(F.col("clean").isNull(), F.col("text")).otherwise(F.array_join("clean", "\n"))
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0)).cast("long")
    n_kept = F.when(F.col("clean").isNull(), n_lines).otherwise(F.size("clean").cast("long"))
    kept = [text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*kept, n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped"))


ORACLE = """
WITH d AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents
), site AS (
  SELECT source, count(DISTINCT text) AS site_pages FROM d GROUP BY source
), l AS (
  SELECT DISTINCT source, text, unnest(ls) AS line FROM d
), bad AS (
  SELECT l.source, list(DISTINCT l.line) AS bad FROM (
    SELECT source, line, count(*) AS pages FROM l
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY source, line
  ) l JOIN site ON l.source IS NOT DISTINCT FROM site.source
  WHERE pages >= 5 AND pages > 0.1 * site_pages GROUP BY l.source
), c AS (
  SELECT d.*, list_filter(ls, lambda x: NOT list_contains(coalesce(bad.bad, []), x)) AS clean
  FROM d LEFT JOIN bad ON d.source IS NOT DISTINCT FROM bad.source
)
SELECT doc_id, source, array_to_string(clean, chr(10)) AS text,
  CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(ls) - len(clean), 0) AS BIGINT) AS n_dropped
FROM c
"""
