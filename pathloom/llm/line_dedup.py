"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import materialize

RATIO = 0.05
MIN_PAGES = 3  # so that a line that two pages happen to share is no boilerplate of a small site


def line_key(line: Column) -> Column:
    """Hash of a line without its outer blanks."""
    return F.xxhash64(F.trim(line))


def _filled(line: Column) -> Column:
    return F.trim(line) != ""


def boilerplate_lines(
    docs: DataFrame, host: str, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, count_copies: bool = False
) -> DataFrame:
    """(host, lines): per host the keys of lines on more than ``ratio`` of its pages.

    Pages with the same set of lines are one page, so copies of a document do
    not turn it into boilerplate; with ``count_copies`` every row is a page. A host's list is bounded by (mean distinct
    lines of a page) / ``ratio``, whatever the number of pages. The counts are
    combined before they are shuffled by (host, line): a host with a third of
    all rows is spread over its lines, a line on every page over the map tasks.
    """
    keys = F.array_sort(F.array_distinct(F.transform(
        F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), _filled), line_key
    )))
    sets = docs.select(F.col(host).alias("_host"), keys.alias("_lines"))
    pages = materialize(sets if count_copies else sets.distinct(), "line_sets")
    totals = pages.groupBy("_host").agg(F.count("*").alias("_pages"))
    counts = pages.select("_host", F.explode("_lines").alias("_line")).groupBy("_host", "_line").agg(F.count("*").alias("_n"))
    frequent = counts.filter(F.col("_n") >= min_pages)
    return (
        frequent.alias("c").join(totals.alias("t"), F.expr("c._host <=> t._host"))
        .filter(F.col("_n") > F.lit(ratio) * F.col("_pages"))
        .groupBy("c._host").agg(F.sort_array(F.collect_list("_line")).alias("_boilerplate"))
    )


def drop_boilerplate(
    docs: DataFrame, host: str, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, count_copies: bool = False
) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``; adds ``n_lines`` and ``n_dropped``.

    A line is dropped if more than ``ratio`` of the distinct pages of its host (of all pages with
    ``count_copies``), and at least ``min_pages``, hold it (compared without outer blanks). Blank
    lines stay. The other lines keep their order and their bytes. Null text stays
    null with 0 lines, empty text has one line, null hosts form one host. Texts are
    joined to the hosts' lists where they lie: the list table is written first,
    so that its measured size decides how the join is done.
    """
    listed = materialize(boilerplate_lines(docs, host, text, ratio, min_pages, count_copies), "boilerplate")
    joined = docs.join(listed.withColumnRenamed("_host", "_at"), F.col(host).eqNullSafe(F.col("_at")), "left")
    lines = F.split(F.col(text), "\n")
    kept = F.when(F.col("_boilerplate").isNull(), lines).otherwise(
        F.filter(lines, lambda x: ~(_filled(x) & F.array_contains(F.col("_boilerplate"), line_key(x))))
    )
    n = F.coalesce(F.size(lines), F.lit(0))
    out = joined.withColumn("_kept", kept).withColumns({
        "_n": F.when(F.col(text).isNull(), F.lit(0)).otherwise(n).cast("bigint"),
        "_d": F.when(F.col(text).isNull(), F.lit(0)).otherwise(n - F.size("_kept")).cast("bigint"),
    })
    same = [F.array_join("_kept", "\n").alias(text) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*same, F.col("_n").alias("n_lines"), F.col("_d").alias("n_dropped"))
