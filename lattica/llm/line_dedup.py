"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: The dropped lines' keys are broadcast up to so many bytes; beyond, both sides are shuffled.
BROADCAST = 32 << 20
#: Parts of each host's pages where they are shuffled.
SALTS = 32


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.02, min_pages: int = 5, distinct_texts: bool = False) -> DataFrame:
    """docs with boilerplate lines taken out of the text, plus n_lines and n_dropped.

    A line, as it stands between two line feeds, is boilerplate of a host if it is on more than
    `ratio` of the host's pages and on min_pages of them at least; a page counts once however
    often it repeats the line. Lines without anything but white space are kept and not counted.
    Every row is a page, so repeated rows count each; with distinct_texts a host's pages of equal
    text, or null, are one, so that copies do not make their own lines boilerplate. All rows without a host are one host. A
    null text stays null with no lines; a text may become empty, but no row goes. Columns named
    n_lines and n_dropped are replaced, all others are kept.

    Only the lines' MD5 keys are shuffled (with distinct_texts once more, a list for each text), combined map-side by host and key, so a hot host or
    line is a sum like any other. At most (mean number of lines) / ratio lines of a host can be
    dropped; they are joined to the documents by host.
    """
    keys = F.array_distinct(F.transform(F.filter(F.split(text_col, "\n"), lambda x: F.length(F.trim(F.regexp_replace(x, r"\s+", " "))) > 0), lambda x: F.unhex(F.md5(x))))
    pages = docs.select(F.col(host_col).alias("_lattica_host"), F.col(text_col).alias(text_col))
    pages = pages.select("_lattica_host", F.md5(F.col(text_col).cast("binary")).alias("_lattica_text"), keys.alias("_lattica_keys"))
    if distinct_texts:
        pages = pages.groupBy("_lattica_host", F.unhex("_lattica_text").alias("_lattica_text")).agg(F.first("_lattica_keys").alias("_lattica_keys"))
    total = pages.groupBy("_lattica_host").agg(F.count("*").alias("_lattica_pages"))
    counted = pages.select("_lattica_host", F.explode("_lattica_keys").alias("_lattica_key")).groupBy("_lattica_host", "_lattica_key").agg(F.count("*").alias("_lattica_n")).where(F.col("_lattica_n") >= min_pages)
    total = total.withColumnRenamed("_lattica_host", "_lattica_of")
    often = counted.join(total, F.col("_lattica_host").eqNullSafe(F.col("_lattica_of"))).where(F.col("_lattica_n") > F.col("_lattica_pages") * ratio)
    drops = often.groupBy(F.col("_lattica_host").alias("_lattica_of")).agg(F.collect_set("_lattica_key").alias("_lattica_drops"))
    drops = durable(drops)
    size = drops.agg(F.sum(F.size("_lattica_drops") * 32 + 64)).first()[0] or 0
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows, same = docs.select(*kept_columns), F.col(host_col).eqNullSafe(F.col("_lattica_of"))
    if size <= BROADCAST:
        drops = F.broadcast(drops)  # its size has been checked
    else:  # a hot host's pages are dealt over SALTS tasks
        drops = drops.withColumn("_lattica_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_lattica_at", F.pmod(F.xxhash64(text_col), F.lit(SALTS)).cast("int"))
        same &= F.col("_lattica_at") == F.col("_lattica_salt")
    joined = rows.join(drops, same, "left")
    lines = F.split(text_col, "\n")
    kept = F.when(F.col("_lattica_drops").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("_lattica_drops", F.unhex(F.md5(x)))))
    out = joined.withColumn("_lattica_kept", kept)
    n, m = F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size("_lattica_kept"), F.lit(0))
    texts = {text_col: F.when(F.col(text_col).isNotNull(), F.array_join("_lattica_kept", "\n"))}
    counts = {"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(n), "n_dropped": F.when(F.col(text_col).isNull(), 0).otherwise(n - m)}
    return out.withColumns(counts | texts).select(*kept_columns, "n_lines", "n_dropped")
