"""Line dedup by site-relative frequency, in DataFrame functions alone.

A line is boilerplate of its site if at least LEAST of the site's pages hold it and they are more than
one in ONE_IN of all its pages. Such lines are dropped from the site's pages; blank lines stay. Lines
are counted by two 64-bit hashes (128 bits), once a page and combined before the shuffle. A site has at
most ONE_IN times as many boilerplate lines as a page has lines on average, so the lists that go back to
the pages are short: up to LISTED of them are counted and broadcast, so that no text is shuffled; more are
joined by site, and Spark splits a large site's pages.

A page's site is the host of its url (site_pages), or any column (site_lines).

Cases: a null text is an empty one (one blank line); pages of a null site form a site, and so do those whose
url has no host; repeated rows are pages of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripfold.llm.common import stored

ONE_IN = 20
LEAST = 3
LISTED = 200_000  # boilerplate lines that are broadcast (16 bytes each and their sites' names), at most


def site_lines(pages: DataFrame, key: str, text: str, site) -> DataFrame:
    """key, text without boilerplate lines, n_lines and n_dropped for each page; site: a column or its name."""
    given = pages.select(
        F.col(key).alias("_key"), (F.col(site) if isinstance(site, str) else site).alias("_site"), F.split(F.coalesce(text, F.lit("")), "\n", -1).alias("_lines")
    )
    mark = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b"))
    held = given.select("_site", F.explode(F.array_distinct(F.transform(F.filter("_lines", lambda x: F.trim(x) != ""), mark))).alias("_line"))
    lines = held.groupBy("_site", "_line").agg(F.count("*").alias("_n")).where(F.col("_n") >= LEAST)
    total = given.groupBy("_site").agg(F.count("*").alias("_pages")).withColumnRenamed("_site", "_of")
    found = stored(lines.join(total, F.col("_site").eqNullSafe(F.col("_of"))).where(F.col("_n") * ONE_IN > F.col("_pages")).select("_site", "_line"))
    boilerplate = found.groupBy(F.col("_site").alias("_at")).agg(F.collect_list("_line").alias("_drop"))
    if found.count() <= LISTED:
        boilerplate = F.broadcast(boilerplate)
    kept = given.join(boilerplate, F.col("_site").eqNullSafe(F.col("_at")), "left").withColumn(
        "_kept", F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda x: ~F.array_contains("_drop", mark(x))))
    )
    return kept.select(
        F.col("_key").alias(key), F.array_join("_kept", "\n").alias("text"), F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
    )


def host_of(url) -> Column:
    """The host of a url in lower case, null if it has none."""
    return F.lower(F.try_parse_url(F.col(url) if isinstance(url, str) else url, F.lit("HOST")))


def site_pages(pages: DataFrame, key: str, url: str, text: str) -> DataFrame:
    """site_lines of pages whose site is their url's host."""
    return site_lines(pages, key, text, host_of(url))


def op7_site_lines(spark, sf_dir: str) -> DataFrame:
    """The source of a document is its site."""
    return site_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source")


SQL = f"""
WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
site AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
held AS (SELECT source, unnest(list_distinct(ls)) AS l FROM d),
n AS (SELECT source, l, count(*) AS n FROM held WHERE trim(l) <> '' GROUP BY source, l HAVING count(*) >= {LEAST}),
bad AS (SELECT n.source, list(l) AS bl FROM n JOIN site ON n.source IS NOT DISTINCT FROM site.source
        WHERE n.n * {ONE_IN} > pages GROUP BY n.source),
k AS (SELECT doc_id, ls, CASE WHEN bl IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(bl, x)) END AS kept
      FROM d LEFT JOIN bad ON d.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, CAST(len(ls) AS BIGINT) AS n_lines,
       CAST(len(ls) - len(kept) AS BIGINT) AS n_dropped FROM k
"""
