"""Mixing sources to target weights.

Words are summed by source, each source gets a target, and a document is emitted floor(target / size of its source)
times plus once more by a coin whose probability is the fraction. The coin is a hash of the document's id, turned by
one of 32 offsets; of these each source takes the one that brings its words nearest to the target, so a source of few
documents comes near it too.

Edge cases: a null or empty text has size 0 and is emitted like its source's others, taking 0 words; a very long text
is one document like others, so a source of few long ones may miss its target by one of them; null sources are one
source, last in order; a source without words has target 0 and rate 0; repeated rows share a coin; a null doc_id counts
as '' for the coin; of offsets that come equally near the least is taken; other columns of documents, whatever their
names, are kept, but one named like an added column (copy; source_size, target, copies) gives way to it; an empty table
gives no rows. Sources are ranked in one task, which sees a narrow row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from estate_jobs.llm.common import durable, small_enough, table

WEIGHTS, MOST, OFFSETS, SEED = (1, 2, 3), 3, 32, "mix-1"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size): weighted shares of the whole, none above most x size.

    Sources that reach their bound pass the excess to the rest by weight. In the order of bound / weight those are the
    first; level k is what a unit of weight gets if the first k are at their bounds, and the first source whose bound
    isn't below its level sets it for all that follow. There is a row for each source here, not for each document.
    """
    # order by code point is Spark's order of strings
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weighted = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") - 1) % len(WEIGHTS) + 1)).withColumn("bound", most * F.col("source_size"))
    whole, before = W.partitionBy(F.lit(1)), W.orderBy(F.col("bound") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = weighted.withColumn("level", level)
    free = levels.withColumn("level", F.min(F.when(F.col("bound") >= F.col("level") * F.col("weight"), F.struct(F.col("bound") / F.col("weight"), "rank", "level"))).over(whole)["level"])
    return free.select("source", "source_size", F.when((F.col("source_size") == 0) | F.col("level").isNull(), F.lit(0.0)).otherwise(F.least(F.col("bound").cast("double"), F.col("level") * F.col("weight"))).alias("target"))


def coin(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 from a hash of the id: 48 bits of its md5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _turned(k: Column) -> Column:
    turned = F.col("coin") + k / F.lit(float(OFFSETS))
    return turned - F.floor(turned)


def plan(sized: DataFrame, most: int = MOST, seed: str = SEED) -> DataFrame:
    """For each source: source_size, target, whole and part (of the rate) and k, its coin's offset.

    sized (doc_id, source, size) is read twice; pass a durable table.
    """
    tossed = sized.withColumn("coin", coin(F.col("doc_id"), seed))
    rates = durable(targets(tossed.groupBy("source").agg(F.sum("size").alias("source_size")), most))
    rates = rates.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    hits = _by_source(tossed, rates).groupBy("source").agg(*(F.sum(F.when(_turned(F.lit(k)) < F.col("part"), F.col("size")).otherwise(0)).alias(f"t{k}") for k in range(OFFSETS)))
    both = hits.withColumnRenamed("source", "key").join(rates, F.col("key").eqNullSafe(F.col("source")))
    far = [F.struct(F.abs(F.col(f"t{k}") - (F.col("target") - F.col("whole") * F.col("source_size"))).alias("off"), F.lit(k).alias("k")) for k in range(OFFSETS)]
    return durable(both.select("source", "source_size", "target", "whole", "part", F.least(*far)["k"].alias("k")))


def copies(documents: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """documents with source_size, target and copies."""
    added = ("source_size", "target", "copies")
    return _rated(documents, plan, seed).select(*_own(documents, added), *added)


def _rated(documents: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """row (the columns of documents), source_size, target and copies."""
    keyed = documents.select(F.col("source").cast("string"), coin(F.col("doc_id"), seed).alias("coin"), F.struct("*").alias("row"))
    hit = F.when(_turned(F.col("k")) < F.col("part"), 1).otherwise(0)
    return _by_source(keyed, plan).select("row", "source_size", "target", (F.col("whole").cast("int") + hit).alias("copies"))


def _own(documents: DataFrame, added: tuple[str, ...]) -> list[Column]:
    """The columns of documents within row, less those that added ones replace."""
    return [F.col("row")[c].alias(c) for c in documents.columns if c.lower() not in added]


def _by_source(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Joined by source. Beyond the size at which the plan may be broadcast, a skewed join is split by AQE."""
    right = small_enough(plan.withColumnRenamed("source", "plan_source"))
    return docs.join(right, docs["source"].eqNullSafe(right["plan_source"]), "left").drop("plan_source")


def sizes(documents: DataFrame) -> DataFrame:
    """doc_id, source, size of every document, kept: texts are read for it once."""
    return durable(documents.select("doc_id", F.col("source").cast("string"), n_words(F.col("text")).alias("size")))


def mix(documents: DataFrame, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: the columns of documents and `copy` (from 1), a row for each time that a document is taken."""
    taken = _rated(documents, plan(sizes(documents), most, seed), seed).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*_own(documents, ("copy",)), "copy")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = sizes(table(spark, sf_dir, "documents"))
    return copies(sized, plan(sized)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP5_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE AS coin
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sources),
weighted AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS bound FROM ranked),
ordered AS (SELECT *, CAST(bound AS DOUBLE) / CAST(weight AS DOUBLE) AS b FROM weighted),
levels AS (SELECT *,
  CAST(sum(source_size) OVER () - coalesce(sum(bound) OVER (ORDER BY b, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY b, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level FROM ordered),
free AS (SELECT level AS top FROM levels WHERE bound >= level * weight ORDER BY b, rank LIMIT 1),
plan AS (SELECT source, source_size, CASE WHEN source_size = 0 OR top IS NULL THEN 0.0::DOUBLE ELSE least(CAST(bound AS DOUBLE), top * weight) END AS target FROM levels LEFT JOIN free ON true),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM plan),
parts AS (SELECT *, CAST(floor(rate) AS BIGINT) AS whole, rate - floor(rate) AS part FROM rated),
docs AS (SELECT s.doc_id, s.size, s.coin, p.* FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source),
tries AS (SELECT source, k, abs(sum(CASE WHEN (coin + k / {OFFSETS}.0::DOUBLE) - floor(coin + k / {OFFSETS}.0::DOUBLE) < part THEN size ELSE 0 END) - (any_value(target) - any_value(whole) * any_value(source_size))) AS off
  FROM docs, (SELECT CAST(unnest(range({OFFSETS})) AS INT) AS k) GROUP BY source, k),
best AS (SELECT source, k FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off, k) AS n FROM tries) WHERE n = 1)
SELECT d.doc_id, d.size, d.source_size, d.target,
  CAST(d.size * (d.whole + CASE WHEN (d.coin + b.k / {OFFSETS}.0::DOUBLE) - floor(d.coin + b.k / {OFFSETS}.0::DOUBLE) < d.part THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM docs d JOIN best b ON d.source IS NOT DISTINCT FROM b.source
"""
