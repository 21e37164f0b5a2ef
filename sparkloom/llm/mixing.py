"""Operator 6: mixing sources to target weights by drawn blocks.

Each source's words, its documents laid end to end in doc_id order, are packed into blocks of a fixed
number of words. A source has as many slots as its target asks for, and every slot falls to one of the
equally likely output shards: given its size, a shard's counts by source are multinomial with the
sources' shares as odds, while the sums over shards meet the targets exactly. The counts of shards
are drawn by halving: a seeded binomial says how many of the slots of a stretch of shards lie in its
first half, so any task finds the counts of any shard by itself. A source's slots count through a
pseudorandom permutation of its blocks (a keyed Feistel network), then through the next one, so no
block is taken again before all were taken. Slots and blocks meet in a join on (source, block); no key
of it has more rows than a block has words.

Nothing but the number of shards passes the driver. One task sees one row per source, to share the
words out.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm._shared import MOST_TASKS, WORD, numbered, written

BLOCK_WORDS, SHARD_SLOTS, MOST_EPOCHS, SEED = 32, 8192, 3, 20
WEIGHTS = (1.0, 2.0, 3.0)
#: Slots that a task lays at a time.
SLOTS_STEP = 100_000


def with_targets(sources: DataFrame, weights: tuple[float, ...], most: float = MOST_EPOCHS) -> DataFrame:
    """Rows (source, n) with rank (by code point, null last) and target: shares of all words by weight, none above `most` times its n, the excess reshared by weight among the others.

    The sources that stop are those with the least n for their weight. In that order, a source stops
    if the rate that is left when all before it have stopped would give it too much; the first that
    does not sets the rate of all after it.
    """
    from pyspark.sql import Window

    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    given = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.withColumn("w", F.get(given, F.col("rank") % len(weights)))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("n") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    total, weight = F.sum("n").over(whole), F.sum("w").over(whole)
    rate = (total - most * F.coalesce(F.sum("n").over(before), F.lit(0))) / (weight - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rated = weighed.withColumn("rate", rate).withColumn("stops", F.col("rate") * F.col("w") > most * F.col("n"))
    settled = rated.withColumn("final", F.min_by(F.when(~F.col("stops"), F.col("rate")), F.when(~F.col("stops"), F.struct(F.col("n") / F.col("w"), F.col("rank")))).over(whole))
    goal = F.when(F.col("stops"), most * F.col("n")).otherwise(F.col("final") * F.col("w")).cast("double")
    return settled.select("rank", "source", "n", goal.alias("target"))


def shard_ranges(total: int, shards: int, key: int, seed: int, low: int, high: int) -> list[tuple[int, int, int]]:
    """(shard, first, end) of the stretches that meet slots low .. high - 1 of a source with `total` slots; each stretch holds the slots that fall to a shard.

    Binomial halving: every node's draw has a seed of its own, so all tasks agree.
    """
    out: list[tuple[int, int, int]] = []
    todo = [(0, shards, 0, total)]
    while todo:
        a, b, first, n = todo.pop()
        if first >= high or first + n <= low or not n:
            continue
        if b - a == 1:
            out.append((a, first, first + n))
            continue
        middle = (a + b) // 2
        left = int(np.random.default_rng([seed, key, a, b]).binomial(n, (middle - a) / (b - a)))
        todo += [(middle, b, first + left, n - left), (a, middle, first, left)]
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where each index in [0, size) goes under the permutation that `key` picks; equal keys need equal sizes."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask, at = (np.uint64(1) << half) - np.uint64(1), index.astype(np.uint64).copy()
    todo = np.arange(len(at))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        a, b = at[todo] >> h, at[todo] & m
        for turn in range(4):
            with np.errstate(over="ignore"):
                mixed = _mix(b + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn) * np.uint64(0xD1B54A32D192ED03))
            a, b = b, a ^ (mixed & m)
        at[todo] = (a << h) | b
        todo = todo[at[todo] >= size[todo].astype(np.uint64)]
    return at.astype(np.int64)


def _laid(df: DataFrame, text: str, rows: bool) -> DataFrame:
    """Columns _row (df's row, if asked for), source, doc_id, size, _h, start (words of its source before it), source_size."""
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    body = F.coalesce(F.col(f"_row.{text}"), F.lit(""))
    sized = row.select("_row", F.col("_row.source").alias("source"), F.col("_row.doc_id").alias("doc_id"), F.size(F.regexp_extract_all(body, F.lit(WORD), F.lit(0))).cast("long").alias("size"), F.xxhash64(body).alias("_h"))
    sized = sized if rows else sized.drop("_row")
    return written(numbered(sized, "source", ["doc_id", "size", "_h"], "size", "start", "source_size"), "laid")


def _plan(laid: DataFrame, weights: tuple[float, ...], block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Sources (rank, source, target, n_blocks, slots), a written table, and slots (shard, rank, slot, block)."""
    found = with_targets(laid.groupBy("source").agg(F.max("source_size").alias("n")), weights)
    n_blocks = F.ceil(F.col("n") / block)
    wanted = F.least(MOST_EPOCHS * n_blocks, F.round(F.try_divide(F.col("target") * n_blocks, F.col("n"))).cast("long"))
    sources = written(found.select("rank", "source", "target", n_blocks.alias("n_blocks"), F.when(F.col("n") > 0, wanted).otherwise(0).cast("long").alias("slots")), "sources")
    total = sources.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-total // SHARD_SLOTS))
    step = F.lit(SLOTS_STEP).cast("long")
    pieces = sources.where("slots > 0").select("rank", "n_blocks", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, step)).alias("low"))
    spread = pieces.repartition(int(min(max(1, total // SLOTS_STEP), MOST_TASKS)))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            for d in batch.to_pylist():
                low, high = d["low"], min(d["slots"], d["low"] + SLOTS_STEP)
                t = np.arange(low, high, dtype=np.int64)
                shard = np.zeros(len(t), np.int64)
                for j, first, end in shard_ranges(d["slots"], shards, d["rank"], seed, low, high):
                    shard[max(first, low) - low : min(end, high) - low] = j
                size = np.full(len(t), d["n_blocks"], np.int64)
                key = _mix(np.uint64(seed) * np.uint64(1_000_003) + np.uint64(d["rank"]) * np.uint64(64) + (t // size).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.full(len(t), d["rank"], np.int32)), pa.array(t), pa.array(permuted(t % size, size, key))], names=["shard", "rank", "slot", "block"])

    return sources, spread.mapInArrow(place, "shard long, rank int, slot long, block long")


def _taken(laid: DataFrame, sources: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """Rows (rank, start, taken, drawn): per document with words, the words that the mix takes and [(block, times)]."""
    ranked = laid.where("size > 0").join(sources.select("rank", F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s")))
    pieces = ranked.select("rank", "start", F.col("size"), F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    # the planner takes slots for as small as the sources that they are made from; they grow with the corpus and are never broadcast
    times = slots.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times")).hint("merge")
    met = pieces.select("rank", "start", "block", words.alias("words")).join(times, ["rank", "block"])
    return met.groupBy("rank", "start").agg(F.sum(F.col("words") * F.col("times")).cast("long").alias("taken"), F.collect_list(F.struct("block", "times")).alias("drawn"))


def mix_report(df: DataFrame, text: str = "text", weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """Per row of df: doc_id, size, source_size, target, taken (words the mix takes of it, repeats counted).

    Null texts have no words; a null source is a source of its own, the last. Equal rows take
    places of their own. Rows that agree in source, doc_id, size and text may swap their takings.
    An empty table gives an empty one; texts of any length are counted whole; other columns are not read.
    """
    laid = _laid(df, text, False)
    sources, slots = _plan(laid, weights, block, seed)
    taken = written(_taken(laid, sources, slots, block).select("rank", "start", "taken"), "taken")
    ranked = laid.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "rank", "start", "size", "source_size", "target")
    met = ranked.join(taken.withColumnRenamed("start", "_start").withColumnRenamed("rank", "_rank"), (F.col("rank") == F.col("_rank")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), "left")
    return met.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(df: DataFrame, text: str = "text", weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix as documents, with df's columns.

    A document leaves as often as its most drawn block was drawn. Its p-th copy holds the words of
    its blocks drawn p times or more: the whole text where that is all of them, else each run of
    words as it stands in the text, one run a line; n_chars, where df has it, follows. Documents of
    which nothing is drawn, and those without words, stay out.
    """
    laid = _laid(df, text, True)
    sources, slots = _plan(laid, weights, block, seed)
    taken = written(_taken(laid, sources, slots, block), "taken")
    ranked = laid.where("size > 0").join(sources.select("rank", F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s")))
    met = ranked.join(taken.select(F.col("rank").alias("_r"), F.col("start").alias("_st"), "drawn"), (F.col("rank") == F.col("_r")) & (F.col("start") == F.col("_st")))
    columns, where = df.columns, df.columns.index(text)

    def cut(batches):
        import pyarrow as pa

        word = re.compile(WORD)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                row, start, size, drawn = (part.column(i) for i in range(4))
                texts, index, out = row.field(where).to_pylist(), [], []
                for i, (body, first, n, got) in enumerate(zip(texts, start.to_pylist(), size.to_pylist(), drawn.to_pylist(), strict=True)):
                    spans, times = None, {x["block"]: x["times"] for x in got}
                    for p in range(1, max(times.values()) + 1):
                        blocks = sorted(b for b, k in times.items() if k >= p)
                        runs: list[list[int]] = []
                        for b in blocks:
                            a, z = max(first, b * block) - first, min(first + n, (b + 1) * block) - first
                            if runs and runs[-1][1] == a:
                                runs[-1][1] = z
                            else:
                                runs.append([a, z])
                        index.append(i)
                        if runs == [[0, n]]:
                            out.append(body)
                        else:
                            spans = spans or [m.span() for m in word.finditer(body)]
                            out.append("\n".join(body[spans[a][0] : spans[z - 1][1]] for a, z in runs))
                cols = [row.field(k).take(pa.array(index, pa.int64())) for k in range(row.type.num_fields)]
                cols[where] = pa.array(out, pa.string())
                if "n_chars" in columns:
                    k = columns.index("n_chars")
                    cols[k] = pa.array([len(x) for x in out], cols[k].type)
                yield pa.RecordBatch.from_arrays(cols, names=columns)

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    return met.select("_row", "start", "size", "drawn").mapInArrow(cut, schema)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, with sizes and targets."""
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
