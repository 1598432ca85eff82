"""Line dedup by site-relative frequency.

A line's ratio is the number of a host's pages that contain it, over the host's pages. Lines above the
ratio are boilerplate and are dropped from every page of that host. Only hashes are grouped, and as a
host's ratios sum to its mean lines a page, fewer than mean lines / ratio lines of a host can be
above the limit: they travel as one short array to the texts, which are not shuffled while the hosts are few.

Defined cases: lines are compared without the blanks around them; lines of blanks alone are neither counted
nor dropped; a page has each line once in the count; a null text stays null and counts as a page without
lines; a null source counts as the empty host; a line at the ratio itself stays, one on MIN_PAGES pages may go; repeated rows
count as pages each; a very long text is one array of lines, of any length; an empty table gives no rows; other columns
are handed on whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm._spark import BATCH_BYTES, members, saved, small, whole

#: Production parameters: lines on at least MIN_PAGES pages and more than MAX_RATIO of a host's pages are dropped.
MAX_RATIO, MIN_PAGES = 0.1, 5


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\v\f"))


def boilerplate(docs: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, drop array<bigint>): hashes of the lines above the ratio."""
    pages = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), "text")
    total = pages.groupBy("host").agg(F.count("*").alias("pages"))
    keys = F.array_distinct(F.transform(F.filter(F.transform(F.split("text", "\n"), _trimmed), lambda x: x != ""), lambda x: F.xxhash64(x)))
    counts = pages.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return counts.join(small(saved(total)), "host").where(F.col("n") > max_ratio * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("drop"))


def drop_boilerplate(docs: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(doc, text, n_lines, n_dropped): the row of docs as a struct, its text less boilerplate lines, and counts of lines."""
    drop = small(saved(boilerplate(docs, max_ratio, min_pages)), 10_000)
    rows = docs.select(whole(docs).alias("doc"))
    joined = rows.join(drop, F.coalesce(F.col("doc.source").cast("string"), F.lit("")) == F.col("host"), "left").select("doc", "drop", F.split("doc.text", "\n").alias("lines"))
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    keys = F.when(F.col("drop").isNotNull(), F.transform("lines", lambda x: F.xxhash64(_trimmed(x))))
    joined = joined.select("doc", "lines", keys.alias("keys"), "drop").select("doc", "lines", members(F.col("keys"), F.col("drop")).alias("gone"))
    joined = joined.select("doc", "lines", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.get("gone", i) | (_trimmed(x) == ""))).alias("kept"))
    count = lambda a: F.when(F.col("doc.text").isNull(), 0).otherwise(a).cast("long")
    text = F.when(F.size("lines") == F.size("kept"), F.col("doc.text")).otherwise(F.array_join("kept", "\n"))
    return joined.select("doc", text.alias("text"), count(F.size("lines")).alias("n_lines"), count(F.size("lines") - F.size("kept")).alias("n_dropped"))


def with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the struct doc, with the column text in place of doc.text, and n_chars after it where there is one."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*(new.get(c, F.col("doc")[c]).alias(c) for c in columns))
