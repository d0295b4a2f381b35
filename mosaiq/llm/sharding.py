"""Rendezvous hashing of stable record keys over weighted shards.

Each shard scores each key by a hash; the highest score wins. A key's shard depends on the key and the shards
alone, so one more shard takes rows only into itself, and changed weights move few rows.

Defined cases: a null key is a key of its own (the empty string's); equal keys go to one shard; null text has
no bytes; rows of one key are numbered in the order of their texts, equal rows in any order; an empty table
gives an empty one; extra columns are passed on, and results replace columns of the same names and no others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import unwrapped, wrapped

#: Numbering is by shard and bucket of the key, so that no task numbers a whole shard.
BUCKETS = 1024


def hash60(*parts: Column) -> Column:
    """A 60-bit number from md5, the same on any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def _score(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight, u uniform in (0, 1) from the hash, and the shard."""
    u = (hash60(key, F.lit(str(shard))) + F.lit(0.5)) / F.lit(float(1 << 60))
    return F.struct((-F.log(u) / F.lit(float(weight))).alias("x"), F.lit(shard).alias("s"))


def _least(scores: list[Column]) -> Column:
    return F.least(*scores) if len(scores) > 1 else scores[0]


def _key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def assign(rows: DataFrame, key: str, weights: Sequence[float], into: str = "shard", more: Sequence[float] = (), grown: str = "grown_shard") -> DataFrame:
    """rows with the shard of each, the one of the least score; ties go to the lower number; no shuffle. With weights of
    more shards also the shard with these, which costs their scores alone."""
    scores = [_score(_key(key), s, w) for s, w in enumerate(weights) if w > 0]
    if not more:
        return rows.withColumn(into, _least(scores)["s"].cast("int"))
    late = [_score(_key(key), len(weights) + s, w) for s, w in enumerate(more) if w > 0]
    both = F.get(F.transform(F.array(_least(scores)), lambda best: F.struct(best["s"].cast("int").alias("old"), _least([best, *late])["s"].cast("int").alias("new"))), F.lit(0))
    found = wrapped(rows, key).withColumn("shards", both)
    return unwrapped(found, rows.columns, {into: F.col("shards.old"), grown: F.col("shards.new")})


def number(rows: DataFrame, keys: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """rows (with shard) and a slot, gapless from 0 in each shard.

    keys: key and shard alone of the same rows, a narrow scan that is counted by shard and bucket; the counts
    (at most shards x BUCKETS rows, whatever the input) give each bucket its first slot."""
    bucket = (hash60(_key(key), F.lit("bucket")) % F.lit(BUCKETS)).cast("int").alias("bucket")
    counts = keys.select("shard", bucket).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot"))
    within = Window.partitionBy("row.shard", "bucket").orderBy(*[F.col("row")[c] for c in order])
    numbered = wrapped(rows, key).select("row", bucket).withColumn("within", F.row_number().over(within) - 1)
    first = first.withColumnRenamed("bucket", "first_bucket")
    placed = numbered.join(F.broadcast(first), (F.col("row.shard") == first.shard) & (F.col("bucket") == F.col("first_bucket")))
    return unwrapped(placed, rows.columns, {"slot": (F.col("first_slot") + F.col("within")).cast("long")})
