"""Sharding by rendezvous hashing over weighted shards.

Every record goes to the shard of the least -ln(u) / weight, with u a hash of its key and the shard. A further shard
can only win records for itself, so no record moves between old shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aquila.llm.tables import load, written

#: Parts of a shard that are numbered on their own, as a power of two.
PART_BITS = 12


def _score(key: Column, shard: int, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.ln(u) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """struct(score, shard) of the winning shard; ties go to the smaller shard."""
    return F.array_min(F.array(*[F.struct(_score(key, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]))


def shard_records(docs: DataFrame, n_shards: int = 16, weights: Sequence[float] | None = None, grown_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size (UTF-8 bytes plus one), text_crc32, law (always 'key'), shard, slot and
    grown_shard (where the record would be with one more shard of ``grown_weight``).

    slot numbers each shard's records from 0 without gaps, in the order of a hash of the id, then id, size and crc.
    Each shard is numbered in 2**PART_BITS parts of that order; only the parts' counts are summed over a whole shard.
    A null text has size 1 and the crc of an empty text. A null id is a key like any other. Rows that repeat an id
    share its shard and have slots of their own, and are told apart by their position in the order, so equal rows may
    swap slots. An empty table gives an empty table. Other columns are ignored.
    """
    weights = list(weights or [1.0] * n_shards)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    best = rendezvous(F.col("doc_id"), weights)
    slim = slim.withColumn("best", best).select(
        "doc_id", "size", "text_crc32", F.col("best.shard").alias("shard"),
        F.when(_score(F.col("doc_id"), len(weights), grown_weight) < F.col("best.score"), F.lit(len(weights))).otherwise(F.col("best.shard")).alias("grown_shard"),
        F.xxhash64("doc_id", "size", "text_crc32").alias("place"),
    )
    slim = written(slim, "shards")
    # The sign bit is flipped, so that the parts follow the signed order of place.
    part = (F.shiftright("place", 64 - PART_BITS) + F.lit(1 << (PART_BITS - 1))).cast("int")
    parts = slim.groupBy("shard", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("shard", "part", before.alias("start"))
    numbered = slim.withColumn("part", part).withColumn("nth", F.row_number().over(Window.partitionBy("shard", "part").orderBy("place", "doc_id", "size", "text_crc32")))
    return numbered.join(starts, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(load(spark, sf_dir, "documents"))
