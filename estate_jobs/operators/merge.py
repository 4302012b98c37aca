"""Keyed merges of listings, scores and statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate_jobs.sources.tables import durable

FIXED = ("source", "url", "url_hash", "description", "scraped_at", "classification", "lv_status")
TEXTS = ("title", "address_raw", "district", "city", "primary_image_url", "image_urls")
AMOUNTS = ("price_eur", "size_m2")
NULLABLE = ("rooms", "floor", "year_built")
REQUIRED = ("source", "url", "price_eur", "scraped_at", "last_seen_at")


def fold(rows: DataFrame) -> DataFrame:
    """One row for each id, as if its rows were merged one by one in the order of seq.

    Partial aggregates do it: a hot id sends one row from each task.
    """
    first = lambda c: F.min_by(c, "seq")
    last = lambda c, there: F.max_by(c, F.when(there, F.col("seq")))

    def rule(c: str) -> Column:
        x = F.col(c)
        if c in TEXTS:
            return F.coalesce(last(c, x != ""), first(c))
        if c in AMOUNTS:
            return F.coalesce(last(c, x > 0), first(c))
        if c in NULLABLE:
            return last(c, x.isNotNull())
        if c == "energy_class":
            return F.coalesce(last(c, ~x.isin("UNKNOWN", "")), first(c))
        return F.max_by(c, "seq") if c == "last_seen_at" else first(c)

    return rows.groupBy("id").agg(*(rule(c).alias(c) for c in rows.columns if c not in ("id", "seq", "is_active")), _active(rows))


def _active(rows: DataFrame) -> Column:
    """What is seen anew (seq over 0) is active; other rows keep their state."""
    return (F.when(F.max("seq") > 0, 1).otherwise(F.max("is_active")) if "is_active" in rows.columns else F.lit(1)).alias("is_active")


def merge_listings(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """existing (no seq) with the batch (seq, from 1) merged in. Listings that the batch lacks stay as they are."""
    return fold(existing.withColumn("seq", F.lit(0).cast("long")).unionByName(batch, allowMissingColumns=True))


def valid(rows: DataFrame) -> DataFrame:
    return rows.filter(" AND ".join(f"{c} IS NOT NULL" for c in REQUIRED if c in rows.columns))


def invalid(rows: DataFrame) -> DataFrame:
    return rows.filter(" OR ".join(f"{c} IS NULL" for c in REQUIRED if c in rows.columns))


def replace(old: DataFrame, new: DataFrame, key: str = "listing_id") -> DataFrame:
    """Rows of new, and of old those whose key isn't in new."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def write_back(listings: DataFrame, scores: DataFrame) -> DataFrame:
    """listings with the class of the new scores."""
    new = scores.select(F.col("listing_id").alias("id"), F.col("classification").alias("new_class"))
    return listings.join(new, "id", "left").withColumn("classification", F.coalesce("new_class", "classification")).drop("new_class")


def set_deed_status(listings: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """listings with new deed statuses, and the log rows of those rejected. verdicts: id, status, reason, detail, module."""
    new = verdicts.select("id", F.col("status").alias("new_status"))
    updated = listings.join(new, "id", "left").withColumn("lv_status", F.coalesce("new_status", "lv_status")).drop("new_status")
    return updated, verdicts.filter("status = 'REJECTED'").select(F.col("id").alias("listing_id"), "reason", "detail", "module")


def insert_or_ignore(existing: DataFrame, seed: DataFrame, key: str = "id", unique: tuple[str, ...] = ("district", "size_band"), order: str = "id") -> DataFrame:
    """existing and the seed rows that, taken one by one in `order`, share neither key nor unique columns with a row that is there.

    In each round the rows that come first both by key and by unique columns go in, and those that they rule out go;
    it takes as many rounds as the longest chain of rows that rule each other out. Nulls are never equal, as in SQL.
    """
    left = seed.join(existing.select(key), key, "left_anti").join(existing.select(*unique), list(unique), "left_anti")
    row = F.struct(F.col(order), F.xxhash64(*seed.columns))
    left = durable(left.groupBy(key, *unique).agg(F.min_by(F.struct(*seed.columns), row).alias("kept"), F.min(row).alias("seed_row")).select("kept.*", "seed_row"))
    taken = left.filter("false")
    while not left.isEmpty():
        by_key = left.groupBy(key).agg(F.min("seed_row").alias("first_by_key"))
        by_unique = left.groupBy(*unique).agg(F.min("seed_row").alias("first_by_unique"))
        known = left.join(by_key, key, "left").join(by_unique, list(unique), "left")
        first = (F.coalesce("first_by_key", "seed_row") == F.col("seed_row")) & (F.coalesce("first_by_unique", "seed_row") == F.col("seed_row"))
        new = durable(known.filter(first).select(*left.columns).dropDuplicates(["seed_row"]))
        taken = taken.union(new)
        left = durable(left.join(new.select("seed_row"), "seed_row", "left_anti").join(new.select(key), key, "left_anti").join(new.select(*unique), list(unique), "left_anti").select(*left.columns))
    return existing.unionByName(taken.select(*seed.columns))
