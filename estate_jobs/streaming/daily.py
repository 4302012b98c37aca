"""Incremental runs over landed files, by the batch operators."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from estate_jobs.operators import cashflow, deeds, location, merge, serve
from estate_jobs.streaming.store import Store

log = logging.getLogger(__name__)


def merge_into_store(spark: SparkSession, rows: DataFrame, path: str, n: int, buckets: int | None = None) -> None:
    """Version n of a store of listings: rows (with seq) merged into version n - 1.

    Only the buckets that rows touch are read and written. Version n is made from n - 1 alone, so a repeated call changes
    nothing. buckets: of a new store; a store with another number raises.
    """
    store = Store(spark, path)
    old = store.start(str(n - 1) if n else None, buckets)
    touched = store.touched(old, (rows, "id"))
    before = store.read(old, "listings", only=touched)
    merged = merge.fold(rows) if before is None else merge.merge_listings(before, rows)
    store.commit(store.write(old, "listings", merged, "id", touched) if touched else old, str(n))


def read_store(spark: SparkSession, path: str, version: int | str, table: str = "listings") -> DataFrame | None:
    """A table of a version; None if it has no rows."""
    store = Store(spark, path)
    return store.read(store.start(str(version)), table)


def merge_stream(spark: SparkSession, landed: str, store: str, checkpoint: str, files: int = 100, buckets: int | None = None) -> StreamingQuery:
    """Merges landed observations into the listings at `store`, a version for each batch."""
    schema = spark.read.parquet(landed).schema

    def step(batch: DataFrame, n: int) -> None:
        merge_into_store(spark, merge.valid(batch), store, n, buckets)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(landed)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Keeps a stream's state on the executors' disks and in the checkpoint, instead of in their memory.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_seen_stream(links: DataFrame, horizon: str | None = None) -> DataFrame:
    """Links of a stream, each once: for ever, or within a horizon of event time (column seen_at)."""
    return links.dropDuplicates(["link"]) if horizon is None else links.withWatermark("seen_at", horizon).dropDuplicatesWithinWatermark(["link"])


def first_seen_links(spark: SparkSession, landed: str, found: str, checkpoint: str, horizon: str | None = None, files: int = 100) -> StreamingQuery:
    """Appends the links of landed files that weren't seen before to the files at `found`; a stopped run goes on where it was.

    The state, a row for each link within the horizon, lies in RocksDB. Its changes go to the checkpoint with each batch,
    so memory doesn't grow with the links, and with a horizon neither does the checkpoint.
    """
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stream = spark.readStream.schema(spark.read.parquet(landed).schema).option("maxFilesPerTrigger", files).parquet(landed)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:  # a query keeps the provider that is set when it starts
        return first_seen_stream(stream, horizon).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(found, format="parquet")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run_steps(steps: list[tuple[str, Callable[[], None]]]) -> dict[str, str]:
    """Runs the steps of a day in turn; one that fails is logged and the next still runs."""
    out = {}
    for name, step in steps:
        try:
            step()
            out[name] = "ok"
        except Exception as e:  # the run goes on by design
            log.exception("step %s failed", name)
            out[name] = f"failed: {e}"
    return out


def run_day(spark: SparkSession, rows: DataFrame, path: str, day: str, before: str | None, documents: DataFrame, key: str, places: DataFrame, sites: DataFrame, noise: DataFrame, buckets: int | None = None) -> dict[str, str]:
    """New observations, deeds, cash flow, location, statistics: the outcome of each step.

    Version `day` of the store at `path` has the tables listings, scores and locations, in the same buckets by listing.
    It is made from version `before`, so a repeated day changes nothing. Steps write what they find (observations,
    verdicts, new scores, new places); `keep` then rewrites the buckets that any of it touches, joins within these only,
    and commits the version as a whole. Rejections and statistics of a day lie in {path}/{day}. After a step that failed
    the others go on without what it would have found. documents: `key` (a column of listings too) and raw.
    """
    store, found = Store(spark, path), {}
    old = store.start(before, buckets)
    none = spark.createDataFrame([], "listing_id string")
    parts = f"{path}/found/{day}/{uuid.uuid4()}"

    def put(part: str, df: DataFrame) -> None:
        df.write.parquet(f"{parts}/{part}")
        found[part] = spark.read.parquet(f"{parts}/{part}")

    def updated(df: DataFrame | None) -> DataFrame | None:
        """Listings before today, with what was seen and found of them by now."""
        if "observed" in found:
            df = merge.fold(found["observed"]) if df is None else merge.merge_listings(df, found["observed"])
        if df is not None and "verdicts" in found:
            df = merge.set_deed_status(df, found["verdicts"])[0]
        return merge.write_back(df, found["scores"]) if df is not None and "scores" in found else df

    def listings() -> DataFrame:
        """Today's listings. Buckets without new observations aren't grouped anew."""
        seen = store.touched(old, (found["observed"], "id")) if "observed" in found else []
        now, rest = updated(store.read(old, "listings", only=seen)), store.read(old, "listings", but=seen)
        if rest is not None:
            rest = merge.set_deed_status(rest, found["verdicts"])[0] if "verdicts" in found else rest
            rest = merge.write_back(rest, found["scores"]) if "scores" in found else rest
        if now is None and rest is None:
            raise ValueError("no listings yet")
        return rest if now is None else now if rest is None else now.unionByName(rest, allowMissingColumns=True)

    def scored(table: str) -> DataFrame:
        return store.read(old, table) if old.tables.get(table) and old.tables[table].folders else none

    def all_scores(table: str) -> DataFrame:
        return merge.replace(scored(table), found[table]) if table in found else scored(table)

    def observe() -> None:
        new = merge.valid(rows)
        for c in ("lv_status", "classification"):
            new = new if c in new.columns else new.withColumn(c, F.lit("PENDING"))
        put("observed", new)

    def check_deeds() -> None:
        put("verdicts", deeds.judge(deeds.pending(listings()), documents, key))
        rejected = found["verdicts"].filter("status = 'REJECTED'").select(F.col("id").alias("listing_id"), "reason", "detail", "module")
        rejected.withColumn("day", F.lit(day)).write.mode("overwrite").parquet(f"{path}/{day}/rejections")

    def score() -> None:
        put("scores", cashflow.run(listings(), all_scores("scores")))

    def place() -> None:
        put("locations", location.run(listings(), all_scores("locations"), places, sites, noise))

    def keep() -> None:
        new = old
        changed = store.touched(old, *((found[p], k) for p, k in (("observed", "id"), ("verdicts", "id"), ("scores", "listing_id")) if p in found))
        if changed:
            own = found.get("observed")
            base = store.read(old, "listings", only=changed)
            if base is None and own is None:
                raise ValueError("no listings yet")
            new = store.write(new, "listings", updated(base), "id", changed)
        for table in ("scores", "locations"):
            if table in found:
                touched = store.touched(old, (found[table], "listing_id"))
                base = store.read(old, table, only=touched)
                new = store.write(new, table, found[table] if base is None else merge.replace(base, found[table]), "listing_id", touched)
        store.commit(new, day)

    def summarise() -> None:
        serve.stats(read_store(spark, path, day)).write.mode("overwrite").parquet(f"{path}/{day}/stats")

    return run_steps([("observe", observe), ("deeds", check_deeds), ("cashflow", score), ("location", place), ("keep", keep), ("stats", summarise)])


def daily_stream(spark: SparkSession, landed: str, store: str, checkpoint: str, documents: DataFrame, key: str, places: DataFrame, sites: DataFrame, noise: DataFrame, files: int = 100) -> StreamingQuery:
    """run_day over what has landed since the last run, a day v0, v1, … for each batch. A batch whose observations weren't merged or kept fails, and so is run again."""

    def step(batch: DataFrame, n: int) -> None:
        done = run_day(spark, batch, store, f"v{n}", f"v{n - 1}" if n else None, documents, key, places, sites, noise)
        if not done["observe"] == done["keep"] == "ok":
            raise RuntimeError(f"batch {n}: {done}")

    stream = spark.readStream.schema(spark.read.parquet(landed).schema).option("maxFilesPerTrigger", files).parquet(landed)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
