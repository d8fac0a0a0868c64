"""A result cache as a table: (cache_key, payload, byte_size, created_at, last_access, schema_version)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantabile.operators.ordered import sum_before


def lookup(cache: DataFrame, keys: DataFrame, version: int) -> DataFrame:
    """keys with the payload of the current version, null where there is none."""
    return keys.join(cache.where(F.col("schema_version") == version).select("cache_key", "payload"), "cache_key", "left")


def misses(cache: DataFrame, keys: DataFrame, version: int) -> DataFrame:
    """The keys to compute."""
    return keys.join(cache.where(F.col("schema_version") == version).select("cache_key"), "cache_key", "left_anti")


def upsert(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """cache with rows put in; of a key the latest access counts, but the time it was made stays."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    kept = F.max_by(F.struct("payload", "byte_size", "last_access", "schema_version"), F.struct("_new", "last_access"))
    return both.groupBy("cache_key").agg(kept.alias("_k"), F.min("created_at").alias("created_at")).select("cache_key", "_k.payload", "_k.byte_size", "created_at", "_k.last_access", "_k.schema_version")


def touch(cache: DataFrame, used: DataFrame, now: Column) -> DataFrame:
    """cache with the time of access of the keys in `used` set."""
    hit = used.select("cache_key").distinct().withColumn("_hit", F.lit(True))
    return cache.join(hit, "cache_key", "left").withColumn("last_access", F.when(F.col("_hit"), now).otherwise(F.col("last_access"))).drop("_hit")


def without_stale(cache: DataFrame, version: int) -> DataFrame:
    return cache.where(F.col("schema_version") == version)


def stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("total_bytes"))


def clear(cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cache without rows, and how many it had (removed)."""
    return cache.where("false"), cache.agg(F.count("*").alias("removed"))


def through(cache: DataFrame, asked: DataFrame, version: int, compute: Callable[[DataFrame], DataFrame], now: Column) -> tuple[DataFrame, DataFrame]:
    """Runs a job only for keys that the cache has not: (cache_key, payload, hit) of all asked rows, and the cache with what was made and touched.

    asked: cache_key and whatever compute needs; compute gives (cache_key, payload) of the rows it gets. Write the returned cache before it
    is read again, else its rows are computed twice.
    """
    keys = asked.select("cache_key").distinct()
    todo = asked.join(misses(cache, keys, version), "cache_key", "left_semi")
    made = compute(todo).select("cache_key", "payload")
    held = lookup(cache, keys, version).where("payload is not null")
    rows = made.select("cache_key", "payload", F.octet_length("payload").cast("bigint").alias("byte_size"), now.alias("created_at"), now.alias("last_access"), F.lit(version).cast(cache.schema["schema_version"].dataType).alias("schema_version"))
    return held.withColumn("hit", F.lit(True)).unionByName(made.withColumn("hit", F.lit(False))), upsert(touch(cache, held, now), rows)


def evict(cache: DataFrame, limit: int, target: float = 0.85) -> DataFrame:
    """cache without its least recently used rows, once it is over the limit: so many go that `target` of the limit is kept.

    All that go come before all that stay in order of (last_access, cache_key), so one cut tells them apart. It is found on keys and
    sizes alone, by carried totals; payloads are neither shuffled nor sorted. Rows equal in both go together; a null access time is the oldest.
    """
    sizes = sum_before(cache.select("last_access", "cache_key", "byte_size"), ["last_access", "cache_key"], "byte_size", "_before")
    place = F.struct("last_access", "cache_key")
    total = cache.agg(F.coalesce(F.sum("byte_size"), F.lit(0)).alias("_total"))
    gone = (F.col("_total") > limit) & (F.col("_total") - F.col("_before") > target * limit)
    cut = sizes.join(F.broadcast(total)).where(gone).agg(F.max(place).alias("_cut"))
    return cache.join(F.broadcast(cut)).where(F.col("_cut").isNull() | (place > F.col("_cut"))).select(*cache.columns)


def fingerprint(lines: DataFrame) -> DataFrame:
    """(track_id, fingerprint): SHA-256 of a track's lines and anchors, in order."""
    row = F.struct("line_idx", F.concat_ws("|", F.col("anchor_ms").cast("string"), "text").alias("l"))
    return lines.groupBy("track_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["l"]), "\n"), 256).alias("fingerprint"))
