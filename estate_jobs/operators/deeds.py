"""Deed filter: encumbrances rule a listing out unless a bank is named."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate_jobs.functions.columns import any_match, first_match
from estate_jobs.functions.params import DEED_BANKS, DEED_FLAGS


def pending(listings: DataFrame) -> DataFrame:
    return listings.filter("lv_status = 'PENDING' AND is_active = 1")


def verdicts(documents: DataFrame, strict: bool = False) -> DataFrame:
    """documents (key columns, raw) with verdict, flag and detail instead of raw. strict: a bank doesn't clear a flag."""
    df = documents.withColumn("low", F.lower("raw"))
    df = df.withColumn("hit", first_match(F.col("low"), DEED_FLAGS)).withColumn("bank", F.lit(False) if strict else any_match(F.col("low"), DEED_BANKS))
    reject = F.col("hit").isNotNull() & ~F.col("bank")
    return df.withColumn("verdict", F.when(reject, "REJECT").otherwise("PASS")).withColumn("flag", F.when(reject, F.col("hit"))).withColumn("detail", F.when(reject, F.concat(F.lit("LV encumbrance detected: '"), F.col("hit"), F.lit("'")))).drop("raw", "low", "hit", "bank")


def judge(listings: DataFrame, documents: DataFrame, key: str, unknown: str = "pass", module: str = "debt_bot") -> DataFrame:
    """id, status, reason, detail, module of the listings. Verdicts, not texts, are shuffled to the listings.

    Without a document a listing passes, or stays pending with unknown="pending".
    """
    joined = listings.join(verdicts(documents), key, "left")
    status = F.when(F.col("verdict") == "REJECT", "REJECTED").when(F.col("verdict").isNull() & F.lit(unknown == "pending"), "PENDING").otherwise("PASS")
    return joined.select("id", status.alias("status"), F.coalesce("flag", F.lit("")).alias("reason"), F.coalesce("detail", F.lit("")).alias("detail"), F.lit(module).alias("module"))


def reverify(ids: DataFrame, listings: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Verdicts of the given ids, whatever their status; ERROR for an id that isn't a listing."""
    found = judge(ids.join(listings, "id"), documents, key, module="debt_bot_reverify")
    missing = ids.join(listings, "id", "left_anti").select("id", F.lit("ERROR").alias("status"), F.lit("").alias("reason"), F.lit("").alias("detail"), F.lit("debt_bot_reverify").alias("module"))
    return found.unionByName(missing)
