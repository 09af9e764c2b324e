"""Line dedup by site-relative frequency, in DataFrame operations only.

For each host, the pages that hold a line are divided by all pages of the host; lines above a
ratio are boilerplate there and go from every page of that host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, table, unwrapped, wrapped

#: A line on more than this share of its host's pages is boilerplate. At sf0.1 a standing line is on 8.7 %
#: to 13.2 % of a source's pages and the next on at most 4.6 %: half of what the standing line has on average
#: lies between. In either group of sources looked at (11 and 9 of the 20), from 0.05 to 0.08 no line is dropped
#: in some and kept in others (0.04: 4 and 5 lines, 0.1: 1 and 1).
RATIO = 0.05
#: And on so many pages at least: what two or three pages share may be a quotation or a copy, and on a host of
#: fewer than 20 pages a line of a single page would be above the ratio.
LEAST = 4


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """What is compared: the line without spaces at its ends, by its MD5; null for a blank line."""
    bare = F.trim(line)
    return F.when(bare != "", F.md5(bare))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, distinct: bool = False, least: int = LEAST) -> DataFrame:
    """(_host, _none, _lines): for each host that has any, the keys of its boilerplate lines.

    A line is boilerplate where the pages that hold it, divided by all pages of the host, are above the ratio, if they
    are ``least`` at least: a host with fewer pages than that has none. ``distinct``: pages with the same text count
    once, both for a line and for the host, else a page with many copies makes boilerplate of itself. A host's list is short: lines on a
    share ``ratio`` of its pages are at most the average page's lines divided by ``ratio``.
    """
    bare = pages.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.col(host).isNull().alias("_none"), F.col(text).alias("_text"))
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col("_text")), line_key), lambda k: k.isNotNull()))
    if distinct:
        bare = bare.groupBy("_host", "_none", F.md5("_text").alias("_page")).agg(F.first(keys).alias("_keys"))
    else:
        bare = bare.select("_host", "_none", keys.alias("_keys"))
    total = bare.groupBy("_host", "_none").agg(F.count("*").alias("_pages"))
    held = bare.select("_host", "_none", F.explode("_keys").alias("_key")).groupBy("_host", "_none", "_key").agg(F.count("*").alias("_on"))
    often = held.where(F.col("_on") >= least).join(total, ["_host", "_none"]).where(F.col("_on") > ratio * F.col("_pages"))
    return often.groupBy("_host", "_none").agg(F.collect_set("_key").alias("_lines"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, distinct: bool = False, least: int = LEAST) -> DataFrame:
    """pages without their hosts' boilerplate lines, with ``n_lines`` and ``n_dropped``.

    Other columns stay as they are, whatever their names; those two are replaced if pages has them. A
    null text counts as empty and comes back empty; a null host is a host of its own; blank lines stay;
    repeated rows come back as often, alike, and lines that tie at the ratio stay; very long texts
    count whole; an empty table stays empty. A page of boilerplate alone comes back with an empty
    text. The lists are joined by host: sent to all where Spark finds them small, else dealt by host,
    where AQE splits a large host's pages.
    """
    inner = pages.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    lists = settled(boilerplate(inner, "host", "text", ratio, distinct, least), "boilerplate")
    source = F.col("_in").getField(host)
    keyed = wrapped(pages).withColumns({"_host": F.coalesce(source.cast("string"), F.lit("")), "_none": source.isNull()})
    lines = lines_of(F.col("_in").getField(text))
    kept = F.when(F.col("_lines").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(F.array_contains("_lines", line_key(x)), F.lit(False))))
    out = keyed.join(lists, ["_host", "_none"], "left").withColumn("_kept", kept).withColumn("_n", F.size(lines))
    names = [c for c in pages.columns if c.lower() not in ("n_lines", "n_dropped")]
    back = unwrapped(out, pages.select(*(f"`{c}`" for c in names if c != text)), **{text: F.array_join("_kept", "\n"), "n_lines": F.col("_n"), "n_dropped": F.col("_n") - F.size("_kept")})
    return back.select(*(f"`{c}`" for c in names), "n_lines", "n_dropped")


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


OP2_SQL = f"""
WITH page AS (SELECT coalesce(source, '') AS host, source IS NULL AS none, text FROM documents),
total AS (SELECT host, none, count(*) AS pages FROM page GROUP BY ALL),
held AS (SELECT host, none, line, count(*) AS n FROM (
    SELECT host, none, unnest(list_distinct([trim(x) FOR x IN string_split(coalesce(text, ''), chr(10)) IF trim(x) <> ''])) AS line FROM page) GROUP BY ALL),
lists AS (SELECT host, none, list(line) AS lines FROM held JOIN total USING (host, none)
    WHERE n >= {LEAST} AND n > CAST({RATIO} AS DOUBLE) * pages GROUP BY ALL),
split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, coalesce(lines, []) AS lines
    FROM documents LEFT JOIN lists ON host = coalesce(source, '') AND none = (source IS NULL)),
kept AS (SELECT doc_id, l, [x FOR x IN l IF trim(x) = '' OR NOT list_contains(lines, trim(x))] AS k FROM split)
SELECT doc_id, coalesce(array_to_string(k, chr(10)), '') AS text, CAST(len(l) AS INTEGER) AS n_lines, CAST(len(l) - len(k) AS INTEGER) AS n_dropped FROM kept
"""
