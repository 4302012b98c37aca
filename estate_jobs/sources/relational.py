"""Writes to a relational store by JDBC: partitioned upserts through a staging table.

Tasks append to a staging table that is made like the target, each in a transaction of its own. A retried task may leave
its rows twice, so the merge reads distinct rows, from a second table (a MERGE may ask for one). One MERGE in the target's own transaction then applies the rule of each
column and the staging table goes: readers see all of a batch or nothing, and a batch written again changes nothing.
The store must know MERGE and CREATE TABLE ... WITH NO DATA (Derby, PostgreSQL 15, Db2, Oracle with small changes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from estate_jobs.operators import merge

#: Connections that write at once.
PARTS = 8


def execute(spark: SparkSession, url: str, *statements: str) -> None:
    """Runs statements in one transaction, from the driver. Spark's own reader has no way to run one that returns no rows."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for s in statements:
            statement.execute(s)
        connection.commit()
    finally:
        connection.rollback()
        connection.close()


def _exists(spark: SparkSession, url: str, name: str) -> bool:
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        found = connection.getMetaData().getTables(None, None, None, None)
        while found.next():
            if found.getString("TABLE_NAME").lower() == name.lower() and found.getString("TABLE_TYPE") == "TABLE":
                return True
        return False
    finally:
        connection.close()


def _clear(spark: SparkSession, url: str, staging: str) -> None:
    for name in (f"{staging}_rows", staging):
        if _exists(spark, url, name):
            execute(spark, url, f"DROP TABLE {name}")


def listing_rule(column: str) -> str | None:
    """What a listing's column (t) becomes when it is seen again (s), as merge.fold has it; None: it stays."""
    if column in merge.TEXTS:
        return f"CASE WHEN s.{column} <> '' THEN s.{column} ELSE t.{column} END"
    if column in merge.AMOUNTS:
        return f"CASE WHEN s.{column} > 0 THEN s.{column} ELSE t.{column} END"
    if column in merge.NULLABLE:
        return f"COALESCE(s.{column}, t.{column})"
    if column == "energy_class":
        return f"CASE WHEN s.{column} NOT IN ('UNKNOWN', '') THEN s.{column} ELSE t.{column} END"
    if column == "is_active":
        return "1"
    return f"s.{column}" if column == "last_seen_at" else None


def replace_rule(column: str) -> str:
    return f"s.{column}"


def upsert(rows: DataFrame, url: str, table: str, key: str, rule=replace_rule, parts: int = PARTS) -> None:
    """Merges rows, one for each key, into a table: known keys by the rule of each column, new ones as they are.

    Columns that the table has and rows don't stay, or are null in new rows; rows have no others. Rows that are equal
    count once; different ones of one key make the merge, and so the batch, fail.
    """
    spark, staging = rows.sparkSession, f"{table}_staging"
    known = {c.lower(): c for c in spark.read.jdbc(url, table).columns}
    columns = [known[c.lower()] for c in rows.columns]
    _clear(spark, url, staging)  # what a killed batch left
    execute(spark, url, f"CREATE TABLE {staging} AS SELECT {', '.join(columns)} FROM {table} WITH NO DATA")
    rows.toDF(*columns).repartition(parts).write.mode("append").jdbc(url, staging)
    changes = [f"{c} = {r}" for c in columns if c.lower() != key.lower() and (r := rule(c.lower()))]
    own, update = f"{staging}_rows", f" WHEN MATCHED THEN UPDATE SET {', '.join(changes)}" if changes else ""
    execute(
        spark, url,
        f"CREATE TABLE {own} AS SELECT {', '.join(columns)} FROM {table} WITH NO DATA",
        f"INSERT INTO {own} SELECT DISTINCT {', '.join(columns)} FROM {staging}",
        f"MERGE INTO {table} t USING {own} s ON t.{key} = s.{key}{update} WHEN NOT MATCHED THEN INSERT ({', '.join(columns)}) VALUES ({', '.join(f's.{c}' for c in columns)})",
    )
    _clear(spark, url, staging)


def upsert_listings(rows: DataFrame, url: str, table: str = "listings", parts: int = PARTS) -> None:
    """Observations (with seq, from 1) merged into a table of listings, as merge.merge_listings would."""
    upsert(merge.fold(rows), url, table, "id", listing_rule, parts)


def upsert_scores(scores: DataFrame, url: str, table: str = "cashflow_scores", listings: str = "listings", parts: int = PARTS) -> None:
    """New scores in place of old ones, and their classes in the listings."""
    upsert(scores, url, table, "listing_id", replace_rule, parts)
    upsert_known(scores.selectExpr("listing_id AS id", "classification"), url, listings, parts)


def upsert_known(rows: DataFrame, url: str, table: str, parts: int = PARTS) -> None:
    """Sets columns of ids that a table has; others are left out, as an UPDATE by id leaves them out."""
    ids = rows.sparkSession.read.jdbc(url, table).selectExpr("id")
    upsert(rows.join(ids, "id", "left_semi"), url, table, "id", replace_rule, parts)
