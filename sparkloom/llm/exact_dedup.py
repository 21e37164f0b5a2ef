"""Operator 3: exact dedup by deterministic block naming. Built-in expressions only.

Every text is cut into blocks of a fixed number of bytes. Equal blocks get one integer name; then
adjacent names are paired and the pairs named, level by level, until one name is left per text.
Two texts end with the same (level, name) if and only if they are equal byte for byte: at level 0
names stand for contents that were compared in full, above it for pairs of integers.

What moves: the distinct blocks once, for naming. The rows that look their names up carry a 128-bit
key instead of the block, and the naming step has proved that key to be injective on this table's
blocks - it groups by key and content together, and tries another key where two contents share one.
A hot block or hot text is pre-aggregated before its shuffle; where rows must meet its name, both
sides of the join are plain exchanges, so that AQE can split them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._shared import rows_named, written

BLOCK_BYTES = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as empty."""
    body = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(body) == F.length(body), F.lower(body)).otherwise(F.translate(body, UPPER, LOWER))


def _blocks(size: int) -> Column:
    """The column raw in blocks; an empty text is one empty block."""
    last = F.greatest(F.ceil(F.octet_length("raw") / size), F.lit(1)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("raw"), i * size + 1, F.lit(size)))


def _key(block: Column, salt: int, bits: int) -> list[Column]:
    """Two 64-bit halves; fewer bits only to provoke clashes in tests."""
    halves = [F.xxhash64(F.lit(2 * salt + k), block) for k in (0, 1)]
    return halves if bits == 64 else [F.pmod(h, F.lit(2**bits)) for h in halves]


def _names(distinct: DataFrame, label: str) -> DataFrame:
    """distinct with a column `name`: ascending in sorted order within each task, unique over the table; written, since only one evaluation may count."""
    return written(distinct.sortWithinPartitions(*distinct.columns).withColumn("name", F.monotonically_increasing_id()), label)


def _level0(df: DataFrame, size: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows (uid, doc_id, text_sha256, keys) and names (h1, h2, name), with a salt under which no two different blocks share a key."""
    for salt in range(1, 64):
        pieces = df.select(F.explode(_blocks(size)).alias("block")).withColumns(dict(zip(("h1", "h2"), _key(F.col("block"), salt, bits), strict=True)))
        names = _names_of_blocks(pieces.groupBy("h1", "h2", "block").agg(F.lit(1)))
        if names.groupBy("h1", "h2").count().where("count > 1").isEmpty():
            keys = F.transform(_blocks(size), lambda b: F.struct(*[k.alias(f"h{i}") for i, k in enumerate(_key(b, salt, bits), 1)]))
            rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id"), F.sha2("raw", 256).alias("text_sha256"), keys.alias("keys"))
            return written(rows, "rows"), names
        bits = 64
    raise RuntimeError("no key without clashes found")


def _names_of_blocks(distinct: DataFrame) -> DataFrame:
    """The block itself takes part in the sort and is then left out of the written table."""
    ordered = distinct.sortWithinPartitions("h1", "h2", "block")
    return written(ordered.select("h1", "h2", F.monotonically_increasing_id().alias("name")), "names0")


def identities(df: DataFrame, text: str = "text", size: int = BLOCK_BYTES, bits: int = 64) -> DataFrame:
    """One row per row of df: uid, doc_id, text_sha256, level, name. Rows agree in (level, name) exactly if their texts do."""
    # a column of its own, so that it is computed once a row and not once a block
    lowered = df.select("doc_id", ascii_lower(F.col(text)).alias("body")).withColumn("raw", F.encode("body", "UTF-8"))
    rows, names = _level0(lowered, size, bits)
    exploded = rows.select("uid", F.size("keys").alias("n"), F.posexplode("keys").alias("at", "k")).select("uid", "n", "at", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
    now = written(exploded.join(names, ["h1", "h2"]).select("uid", "n", "at", "name"), "level0")
    longest = rows.agg(F.max(F.size("keys")).alias("n")).first()["n"] or 1
    level, done = 0, [now.where("n = 1").select("uid", F.lit(0).alias("level"), "name")]
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        even = F.col("at") % 2 == 0
        pairs = now.where("n > 1").groupBy("uid", F.floor(F.col("at") / 2).alias("at")).agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"), F.max(F.ceil(F.col("n") / 2)).alias("n"))
        pairs = written(pairs, f"pairs{level}")
        found = _names(pairs.groupBy("a", "b").agg(F.lit(1)).select("a", "b"), f"names{level}")
        now = written(pairs.join(found, ["a", "b"]).select("uid", F.col("n").cast("int").alias("n"), F.col("at"), "name"), f"level{level}")
        done.append(now.where("n = 1").select("uid", F.lit(level).alias("level"), "name"))
    ends = reduce(DataFrame.unionByName, done)
    return rows.select("uid", "doc_id", "text_sha256").join(ends, "uid")


def exact_classes(df: DataFrame, text: str = "text", size: int = BLOCK_BYTES, bits: int = 64) -> DataFrame:
    """One row per row of df (columns doc_id and `text` are read): doc_id, keep_id, group_size, kept, text_sha256.

    Null texts equal empty ones. The largest doc_id of equal texts stays, null being the smallest;
    of repeated rows with that doc_id one stays. Other columns of df are never read, whatever their names.
    """
    plain = df.select(F.col("doc_id").alias("doc_id"), F.col(text).alias("text"))
    members = written(identities(plain, "text", size, bits), "members")
    classes = written(members.groupBy("level", "name").agg(F.max(F.struct("doc_id", "uid")).alias("best"), F.count(F.lit(1)).alias("group_size")), "classes")
    joined = members.join(classes, ["level", "name"])
    return joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "text_sha256")


def drop_copies(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df that exact_classes keeps, with df's columns."""
    found = written(exact_classes(df, text), "exact")
    per = found.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("_n"), F.max("kept").alias("_kept"))
    stays = written(per.where("_kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "_n"), "stays")
    return rows_named(df, stays, F.sha2(ascii_lower(F.col(text)), 256))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the doc_id that stays for it, by exact_classes over whole texts."""
    return exact_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
