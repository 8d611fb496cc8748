"""Merging replicas and shards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import log

VERSION = ["collection", "id", "lamport", "actor_id"]
#: Fixed: FNV-1a with 64 bits; the prime is 2**40 + 435.
FNV_OFFSET = 14695981039346656037
HALF = 0xFFFFFFFF


def unseen(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming versions that are not stored yet, each once."""
    return log.dedup(incoming).join(stored.select(*VERSION), VERSION, "left_anti")


def crdt_merge(*logs: DataFrame) -> DataFrame:
    """The union of logs; of versions with one key the first by ``ingest_seq``. In any order, any number of times."""
    return log.dedup(reduce(DataFrame.unionByName, logs))


def merge_shards(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of search hits of several shards, told apart by the column ``member``.

    Of each member the best ``k`` count; of one id's hits the one with the greatest score, then version.
    ``k`` <= 0 gives nothing.
    """
    rank = F.row_number().over(Window.partitionBy("member").orderBy(F.desc("score"), "id"))
    best = hits.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank", "member")
    merged = best.groupBy("id").agg(F.max_by(F.struct(*best.columns), F.struct("score", "version")).alias("v")).select("v.*")
    return merged.orderBy(F.desc("score"), "id").limit(max(0, k))


def fnv1a(codes: Column, offset: int = FNV_OFFSET) -> tuple[Column, Column]:
    """FNV-1a of an array of codes as (high, low) halves of 32 bits, so that nothing overflows."""
    start = F.struct(F.lit(offset >> 32).cast("bigint").alias("high"), F.lit(offset & HALF).cast("bigint").alias("low"))

    def step(h: Column, code: Column) -> Column:
        low = h["low"].bitwiseXOR(code.cast("bigint"))
        product = low * 435
        high = h["high"] * 435 + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(HALF).alias("high"), product.bitwiseAND(HALF).alias("low"))

    found = F.aggregate(codes, start, step)
    return found["high"], found["low"]


def byte_codes(text: Column) -> Column:
    """The UTF-8 bytes of a text that isn't empty, as numbers."""
    digits = F.hex(F.encode(text, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("bigint"))


def owner_of(collection: Column, id: Column, members: list[str]) -> Column:
    """The member that owns an id: the hash of collection, a zero byte and id, modulo the sorted members."""
    names = sorted({m for m in members if m})
    high, low = fnv1a(byte_codes(F.concat(collection, F.lit("\0"), id)))
    place = ((high % len(names)) * (2**32 % len(names)) + low) % len(names)
    return F.get(F.array(*map(F.lit, names)), place.cast("int"))
