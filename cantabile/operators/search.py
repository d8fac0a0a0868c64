"""Ranking of what lyric providers returned."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantabile.functions.text import similarity

# How far a provider is trusted; others count 0.
PROVIDER_RANK = {"LRCLIB": 4, "NetEase": 3, "Musixmatch": 2, "BetterLyrics": 1}


def richness(n_words: Column, n_lines: Column) -> Column:
    """3 for word times, 2 for line times, 1 for plain text."""
    return F.when(n_words > 0, 3).when(n_lines > 0, 2).otherwise(1)


def provider_rank(name: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for kv in PROVIDER_RANK.items() for v in kv])[name], F.lit(0))


def best_provider(found: DataFrame, keys: list[str]) -> DataFrame:
    """Of each query the richest result, then the most trusted, then the first; needs richness, provider, raw, position."""
    rank = F.struct("richness", provider_rank(F.col("provider")).alias("rank"), -F.col("position"))
    return found.groupBy(*keys).agg(F.max_by(F.struct("provider", "richness", "raw"), rank).alias("_b")).select(*keys, "_b.*")


def search_all(asked: DataFrame, providers: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """What every provider (name, function) finds for the asked rows, with its name and place in the list; functions give any columns, missing ones are null."""
    found = [f(asked).withColumns({"provider": F.lit(name), "position": F.lit(i)}) for i, (name, f) in enumerate(providers)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def first_hit(found: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """Of each query the value at the lowest position that has one."""
    return found.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys).agg(F.min_by(value, position).alias(value), F.min(position).alias(position))


def match_score(title: Column, artist: Column, album: Column, synced: Column) -> Column:
    """Weighted similarity of a search hit; what wasn't asked for counts .75."""
    return 0.58 * title + 0.30 * F.coalesce(artist, F.lit(0.75)) + 0.12 * F.coalesce(album, F.lit(0.75)) + F.when(synced, 0.10).otherwise(0.0)


def best_match(hits: DataFrame, keys: list[str], least: float = 0.52, k: int = 1) -> DataFrame:
    """The k hits of each query with the highest score, if that is at least `least`; of equal scores the first.

    Needs asked_title, title, position. asked_artist with artist, asked_album with album and synced count where hits has them; an empty or
    null asked one wasn't asked for, and a hit that lacks what was asked for is unlike it.
    """
    def part(asked: str, found: str) -> Column:
        if asked not in hits.columns:
            return F.lit(None).cast("double")
        return F.when(F.coalesce(asked, F.lit("")) != "", similarity(F.coalesce(asked, F.lit("")), F.coalesce(found, F.lit(""))))

    synced = F.coalesce("synced", F.lit(False)) if "synced" in hits.columns else F.lit(False)
    scored = hits.withColumn("score", match_score(similarity(F.col("asked_title"), F.col("title")), part("asked_artist", "artist"), part("asked_album", "album"), synced))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "position"))
    return scored.where(F.col("score") >= least).withColumn("place", place).where(F.col("place") <= k)
