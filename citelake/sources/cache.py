"""Lookup cache as a table: latest value per key, expiry, and a stored form without markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.sources.keyed import BUCKETS, KeyedTable

TTL_DAYS = 30


def upsert_latest(current: DataFrame, updates: DataFrame | None = None) -> DataFrame:
    """Latest row per key of the stored rows and the updates ``(cache_key, value, ts, event_id)``.

    The reduction is an aggregate, so copies of a hot key are combined before the shuffle.
    """
    rows = current if updates is None else current.unionByName(updates)
    latest = rows.groupBy("cache_key").agg(F.max(F.struct("ts", "event_id", "value")).alias("__last"))
    return latest.select("cache_key", "__last.ts", "__last.event_id", "__last.value")


def within_ttl(rows: DataFrame, as_of: Column, days: int = TTL_DAYS) -> DataFrame:
    """Rows not older than ``days`` at ``as_of``."""
    return rows.where(F.col("ts") >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def write_cache(rows: DataFrame, path: str) -> None:
    """Store a cache version; the markup column is not stored."""
    rows.drop("html").write.mode("overwrite").parquet(path)


def stored_cache(spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS) -> KeyedTable:
    """The cache as a stored table: ``merge`` takes new lookups, the latest of each key stays."""
    return KeyedTable(spark, path, schema, ["cache_key"], ["ts", "event_id", "value"], buckets)


def upsert_stream(lookups: DataFrame, table: KeyedTable, state: str) -> None:
    """Merge a stream of lookups into the stored cache, batch by batch; a batch that runs twice changes nothing."""
    query = lookups.writeStream.foreachBatch(lambda batch, _: table.merge(batch)).option("checkpointLocation", state)
    query.trigger(availableNow=True).start().awaitTermination()
