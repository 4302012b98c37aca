"""Stored tables: pages, listings, logs and drafts."""

from __future__ import annotations

import re
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the cluster's spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df as it is, or dealt over all cores if it comes from fewer files or row groups than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with running sums along order, for each combination of by; no two rows of one may be equal in order.

    Rows are dealt out in ranges, whose totals are carried to the next ones, so a group isn't one task's work.
    """
    ranged = durable(rows.repartitionByRange(*by, *order).withColumn("range", F.spark_partition_id()))
    totals = ranged.groupBy("range", *by).agg(*(F.sum(x).alias(f"{k}_total") for k, x in sums.items()))
    before = W.partitionBy(*by).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select("range", *by, *(F.coalesce(F.sum(f"{k}_total").over(before), F.lit(0)).alias(f"{k}_before") for k in sums))
    along = W.partitionBy("range", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = ranged.join(F.broadcast(carried), ["range", *by])
    return joined.select(*rows.columns, *((F.sum(x).over(along) + F.col(f"{k}_before")).alias(k) for k, x in sums.items()))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A table of a relational store, read in ranges of a key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def raw_pages(pages: DataFrame) -> DataFrame:
    """Pages that were fetched well. A table without a status holds such pages only."""
    kept = pages.filter("status = 200") if "status" in pages.columns else pages
    return kept.select("page_id", "url", "html")


def log_id(*parts: str) -> Column:
    """The same id for the same row, so that a repeated write can be told."""
    return F.sha2(F.concat_ws("|", *(F.col(p).cast("string") for p in parts)), 256)


def append_log(rows: DataFrame, path: str, *key: str) -> None:
    """Appends the rows whose log_id the log doesn't hold yet, each once: a repeated append adds nothing."""
    new = rows.withColumn("id", log_id(*key)).dropDuplicates(["id"])
    try:
        new = new.join(rows.sparkSession.read.parquet(path).select("id"), "id", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    new.write.mode("append").parquet(path)


def write_drafts(drafts: DataFrame, path: str) -> None:
    """One text line a draft, by structure."""
    drafts.select("structure", F.replace("draft_text", F.lit("\n"), F.lit("\\n")).alias("value")).write.mode("overwrite").partitionBy("structure").text(path)
