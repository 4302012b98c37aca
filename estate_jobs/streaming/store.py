"""A versioned store of tables that are cut into buckets by a hash of their key.

A version is a manifest: for each table and bucket the folder of its rows. It is written last, as one file, so a version
is there whole or not at all. Data goes to folders of its own for each attempt; what a killed attempt leaves is in no
manifest. A new version names the folders of the buckets that it rewrote and, for all others, those of the version
before. The manifest also keeps each table's schema and the number of buckets, which a store has for good: another number
is refused, and `rebucket` makes a version with one.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new store. A batch rewrites those that it touches; take some thousands where there are billions of rows.
BUCKETS = 64
_MANIFEST = "table string, key string, bucket int, folder string, buckets int, schema string"


class Part(NamedTuple):
    """One table of a version: its key, schema, and the folder of each bucket that has rows."""

    key: str
    schema: T.StructType
    folders: dict[int, str]


class Version(NamedTuple):
    buckets: int
    tables: dict[str, Part]


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def version(self, name: str) -> Version | None:
        """What is committed under that name, by its latest attempt; a row for each bucket, not for each id."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/manifests/{name}").collect()
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        last = max(r.attempt for r in rows)
        tables: dict[str, Part] = {}
        for r in (r for r in rows if r.attempt == last and r.table is not None):
            tables.setdefault(r.table, Part(r.key, T.StructType.fromJson(json.loads(r.schema)), {})).folders[r.bucket] = r.folder
        return Version(rows[0].buckets, tables)

    def start(self, before: str | None, buckets: int | None = None) -> Version:
        """The version that a new one is made from: an empty one, or `before`, which must be there and have so many buckets."""
        if before is None:
            return Version(buckets or BUCKETS, {})
        old = self.version(before)
        if old is None:
            raise ValueError(f"{self.path} has no version {before}")
        if buckets is not None and buckets != old.buckets:
            raise ValueError(f"{self.path} has {old.buckets} buckets, not {buckets}; rebucket makes a version with another number")
        return old

    def read(self, version: Version, table: str, only: list[int] | None = None, but: list[int] | None = None) -> DataFrame | None:
        """Rows of a table, of all buckets, of `only` some or of all `but` some; None if these hold none."""
        part = version.tables.get(table)
        folders = [f for b, f in sorted(part.folders.items()) if (only is None or b in only) and (but is None or b not in but)] if part else []
        return self.spark.read.schema(part.schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else None

    @staticmethod
    def bucket(key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def touched(self, version: Version, *rows: tuple[DataFrame, str]) -> list[int]:
        """Buckets of the given rows, each with its key column."""
        return sorted({r[0] for df, key in rows for r in df.select(self.bucket(key, version.buckets)).distinct().collect()})

    def write(self, version: Version, table: str, df: DataFrame, key: str, touched: list[int]) -> Version:
        """version with these rows in place of the touched buckets. df has rows of touched buckets only. Nothing is committed yet."""
        old = version.tables.get(table)
        folders = {b: f for b, f in (old.folders if old else {}).items() if b not in touched}
        schema = df.schema
        if touched:
            folder = f"{table}/{uuid.uuid4()}"
            df.withColumn("_bucket", self.bucket(key, version.buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            held = {r[0] for r in self.spark.read.parquet(f"{self.path}/{folder}").select("_bucket").distinct().collect()} if not df.isEmpty() else set()
            folders |= {b: f"{folder}/_bucket={b}" for b in touched if b in held}
        # columns that only older buckets have stay readable
        if old:
            schema = T.StructType(list(schema) + [f for f in old.schema if f.name not in schema.names])
        return version._replace(tables=version.tables | {table: Part(key, schema, folders)})

    def commit(self, version: Version, name: str) -> None:
        """Makes the version readable under that name, in place of what an earlier attempt committed."""
        rows = [(t, p.key, b, f, version.buckets, p.schema.json()) for t, p in version.tables.items() for b, f in p.folders.items()] or [(None, None, None, None, version.buckets, None)]
        try:
            attempt = self.spark.read.parquet(f"{self.path}/manifests/{name}").agg(F.max("attempt")).first()[0] + 1
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            attempt = 0
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{name}/attempt={attempt}")

    def rebucket(self, before: str, name: str, buckets: int) -> None:
        """Version `name`: the rows of `before` in another number of buckets."""
        old = self.start(before)
        new = Version(buckets, {})
        for table, part in old.tables.items():
            df = self.read(old, table)
            if df is not None:
                new = self.write(new, table, df, part.key, list(range(buckets)))
        self.commit(new, name)
