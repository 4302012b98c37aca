"""What the operators of this subpackage share: table access, durable tables, the held-out fold."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estate_jobs.sources.tables import durable, shared_folder

__all__ = ["BROADCAST_ROWS", "durable", "free_name", "held_out", "kept", "shared_folder", "small_enough", "table"]

#: A table of at most this many rows (of a few narrow columns) may be broadcast; it is counted first.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder as Parquet, which is smaller than a checkpoint, and read again."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Fold of a document: true if crc32 of its id as text leaves 2 modulo 4. A null id counts as ''."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `rows` rows, else df as it is (a shuffle join follows)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(name: str, df: DataFrame) -> str:
    """name, with as many underscores after it as make it none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
