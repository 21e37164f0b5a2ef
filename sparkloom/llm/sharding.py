"""Operator 7: stable shards by jump consistent hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._shared import numbered

N_SHARDS = 16
_STEP = np.uint64(2862933555777941757)
#: Keys that are null share this one, so that they too stay where they are.
NULL_KEY = 0x9E3779B97F4A7C15


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard in [0, n_shards) of each unsigned 64-bit key, by the published jump recurrence, over whole arrays."""
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    state = keys.astype(np.uint64).copy()
    at, ahead = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = ahead[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * _STEP + np.uint64(1)
        span = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[live] = ((at[live] + 1) * (2147483648.0 / span)).astype(np.int64)
        live = live[ahead[live] < n_shards]
    return at.astype(np.int32)


def with_shards(df: DataFrame, key: str, n_shards: int = N_SHARDS, out: str = "shard") -> DataFrame:
    """df with `out`, the jump-hash shard of the integer column `key`.

    The key and n_shards alone decide. Going from n to n+1 shards moves rows into the new shard
    only, about 1 in n+1 of them. Null keys count as one fixed key. Equal keys share a shard,
    so repeated rows stay together. Other columns, whatever their names, pass through; a column
    named `out` is replaced. An empty table gives an empty table.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("int")
    def shard(keys):
        import pandas as pd

        signed = keys.fillna(0).to_numpy(dtype="int64")
        raw = np.where(keys.isna().to_numpy(), np.uint64(NULL_KEY), signed.view(np.uint64))
        return pd.Series(jump_hash(raw, n_shards))

    # nulls would turn the column into floats on the way, so they travel as a flag
    safe = F.coalesce(F.col(key).cast("long"), F.lit(0))
    return df.withColumn(out, F.when(F.col(key).isNull(), F.lit(int(jump_hash(np.array([NULL_KEY], np.uint64), n_shards)[0]))).otherwise(shard(safe)))


def shard_files(df: DataFrame, key: str, path: str, n_shards: int = N_SHARDS, files_per_shard: int = 4) -> None:
    """Write df as Parquet folders shard=0 .. shard=n-1; each shard's rows go to several tasks, so none writes a whole shard."""
    dealt = with_shards(df, key, n_shards)
    salt = F.pmod(F.xxhash64(F.lit(1), F.col(key)), F.lit(files_per_shard))
    dealt.repartition(n_shards * files_per_shard, F.col("shard"), salt).write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over 16 shards by doc_id (law `key`): sizes, checksum, shard, gapless slot within it, and the shard with one more.

    A null text has size 1 and checksum 0; rows with equal or null doc_id share a shard and get different slots.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    dealt = with_shards(with_shards(sized, "doc_id"), "doc_id", N_SHARDS + 1, "grown_shard")
    return numbered(dealt, "shard", ["doc_id"], None, "slot").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
