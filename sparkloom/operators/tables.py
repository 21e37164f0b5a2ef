"""Operators from tables to tables: modes, top rows, runs, sessions, windows, unpivoting, sampling, item sets, graphs, range joins.

Groups are never gathered in one place unless a docstring says so: windows sort within a key, top
rows are cut by a ranking that Spark applies before the shuffle too, and everything else aggregates.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import col


def modeop(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """All commonest values of each group, with how often: text in lower case, numbers rounded. A group without repeats, or without values, gives ('None', 'None')."""
    numeric = dict(df.dtypes)[x] not in ("string",)
    value = F.round(F.col(x)).cast("long").cast("string") if numeric else F.lower(F.col(x))
    counted = df.groupBy(*by, value.alias("_v")).agg(F.count(F.col(x)).alias("_n"))
    top = counted.withColumn("_top", F.max("_n").over(Window.partitionBy(*by)))
    dull = F.col("_top") <= 1
    kept = top.where(dull | (F.col("_n") == F.col("_top")))
    return kept.select(*by, F.when(dull, "None").otherwise(F.col("_v")).alias("ModeOpElements"), F.when(dull, "None").otherwise(F.col("_n").cast("string")).alias("ModeOpValue")).distinct()


def ontop(df: DataFrame, by: list[str], n: int, order: list[Column], keep: list[str]) -> DataFrame:
    """The n rows of each group that come first in `order`; without groups a plain limit, which needs no single task."""
    if not by:
        return df.orderBy(*order).limit(n).select(*keep)
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_r") <= n).select(*by, *keep)


def ranked(df: DataFrame, by: list[str], i: int, x: str) -> DataFrame:
    """The i-th largest x of each group, repeats counted, for groups of any size; groups with fewer rows give NULL."""
    r = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(x).desc_nulls_last())))
    return r.where(F.col("_r") <= i).groupBy(*by).agg(F.max(F.when(F.col("_r") == i, F.col(x))).alias(x))


def groupdiff(df: DataFrame, by: list[str], key: str, order: list[str], keep: list[str]) -> DataFrame:
    """Runs of equal `key` in `order`: the first row of each and how many rows it has (`repetition`)."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = (~F.col(key).eqNullSafe(F.lag(key).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.struct(*[F.col(c).alias(c) for c in (key, *keep)]).alias("row")))
    out = runs.groupBy(*by, "_run").agg(first.alias("f"), F.count(F.lit(1)).alias("repetition"))
    return out.select(*by, F.col(f"f.row.{key}").alias("compid"), *[F.col(f"f.row.{c}").alias(c) for c in keep], "repetition")


def condbreak(df: DataFrame, group: str, condition: Column, order: list[str]) -> DataFrame:
    """df with bgroupid: the group's id and a counter that a true condition raises."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counter = F.sum(F.coalesce(condition, F.lit(False)).cast("int")).over(w)
    return df.withColumn("bgroupid", F.concat(F.col(group).cast("string"), counter.cast("string")))


def _gap_seconds(ts: str, other: Column) -> Column:
    return (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(other.cast("timestamp"))) / 1_000_000


def _sessions(df: DataFrame, by: list[str], ts: str, seconds: float, order: list[str], out: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(ts, *order)
    broken = F.coalesce(_gap_seconds(ts, F.lag(ts).over(w)) > seconds, F.lit(False)).cast("int")
    return df.withColumn("_b", broken).withColumn(out, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def datediffbreak(df: DataFrame, group: str, ts: str, maxdiff_ms: float, order: list[str] = []) -> DataFrame:  # noqa: B006
    """df with bgroupid: the group's id and the number of gaps of more than maxdiff_ms before the row."""
    made = _sessions(df, [group], ts, maxdiff_ms / 1000, order, "_s")
    return made.withColumn("bgroupid", F.concat(F.col(group).cast("string"), F.col("_s").cast("string"))).drop("_s")


def datediffnewsesid(df: DataFrame, group: str, ts: str, maxdiff_s: float, order: list[str] = []) -> DataFrame:  # noqa: B006
    """As datediffbreak with seconds, rows after the first gap only: they need a new session id."""
    made = _sessions(df, [group], ts, maxdiff_s, order, "_s").where("_s > 0")
    return made.withColumn("bgroupid", F.concat(F.col(group).cast("string"), F.col("_s").cast("string"))).drop("_s")


def datedifffilter(df: DataFrame, by: list[str], ts: str, maxdiff_s: float, order: list[str] = []) -> DataFrame:  # noqa: B006
    """The last row of each stretch without a gap of more than maxdiff_s."""
    w = Window.partitionBy(*by).orderBy(ts, *order)
    to_next = -_gap_seconds(ts, F.lead(ts).over(w))
    return df.withColumn("_g", to_next).where(F.col("_g").isNull() | (F.col("_g") > maxdiff_s)).drop("_g")


def datediffgroup(df: DataFrame, by: list[str], ts: str, maxdiff_s: float, order: list[str] = [], single_rows: bool = False) -> DataFrame:  # noqa: B006
    """df with groupid, text from '1', raised by gaps of more than maxdiff_s; groups of one row are left out unless `single_rows`."""
    made = _sessions(df, by, ts, maxdiff_s, order, "_s").withColumn("groupid", (F.col("_s") + 1).cast("string")).drop("_s")
    if single_rows:
        return made
    return made.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where("_n > 1").drop("_n")


def mindtdiff(df: DataFrame, by: list[str], ts: str) -> DataFrame:
    """Smallest gap of neighbouring times in milliseconds; NULL below two rows."""
    w = Window.partitionBy(*by).orderBy(ts)
    return df.withColumn("_g", _gap_seconds(ts, F.lag(ts).over(w)) * 1000).groupBy(*by).agg(F.min("_g").alias("mindtdiff"))


def groupsum(df: DataFrame, by: list[str], columns: list[str], how: str = "sum") -> DataFrame:
    """Sum (or max) of numeric columns; other columns give their sorted set as a pack for sum."""
    kinds = dict(df.dtypes)

    def made(c: str) -> Column:
        if how == "max":
            return F.max(c)
        return F.to_json(F.array_sort(F.collect_set(c))) if kinds[c] == "string" else F.sum(c)

    return df.groupBy(*by).agg(*[made(c).alias(c) for c in columns])


def groupmax(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return groupsum(df, by, columns, "max")


def jgroupuniquelimit(df: DataFrame, by: list[str], pack: str, k: str, limit: int) -> DataFrame:
    """The smallest k at which the distinct elements of all packs up to it reach `limit`; NULL if they never do."""
    first = df.select(*by, k, F.explode(pack).alias("_e")).groupBy(*by, "_e").agg(F.min(k).alias(k))
    running = first.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(k)))
    return running.groupBy(*by).agg(F.min(F.when(F.col("_n") == limit, F.col(k))).alias("k"))


def jdictgroupunion(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, key, size): per key of the dictionaries the largest number of elements, a scalar having one."""
    pairs = df.select(*by, F.explode(F.from_json(F.col(text), "map<string,string>")).alias("key", "val"))
    size = F.when(F.col("val").startswith("["), F.json_array_length("val")).otherwise(1)
    return pairs.groupBy(*by, "key").agg(F.max(size).cast("long").alias("size"))


def jdictgroup(df: DataFrame, by: list[str], key: str, value: str, order: str, name: str = "dict") -> DataFrame:
    """(by, name): a map of each group, the later of equal keys wins, keys in the order of their last rows. A task holds a group's distinct keys, not its rows; a NULL key is left out."""
    at = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    last = df.groupBy(*by, F.col(key).alias("_k")).agg(F.max(at).alias("_at"))
    entry = F.when(F.col("_k").isNotNull(), F.struct("_at", "_k"))
    entries = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["_k"], e["_at"]["v"]))
    return last.groupBy(*by).agg(F.map_from_entries(entries).alias(name))


def samplegroup(df: DataFrame, by: list[str], n: int, seed: int = 0) -> DataFrame:
    """n random rows a group."""
    return ontop(df.withColumn("_u", F.rand(seed)), by, n, [F.col("_u")], [c for c in df.columns if c not in by]).select(*df.columns)


def sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n random rows."""
    return df.orderBy(F.rand(seed)).limit(n)


def partialsort(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(*df.columns[:n])


def ordered(df: DataFrame, by: list[str]) -> DataFrame:
    """Groups laid together and sorted in their tasks, so that what follows needs no shuffle."""
    return df.repartition(*by).sortWithinPartitions(*by)


def hidden(df: DataFrame) -> DataFrame:
    """Runs the query and returns its schema without rows."""
    df.write.format("noop").mode("overwrite").save()
    return df.limit(0)


def _laid(df: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """df's rows in ranges of `order` with _pid (range) and _at (place in it), written once so that every later reader sees the same ranges, and (_pid, _off, _total): the rows before each range, and all."""
    marked = df.repartitionByRange(*order, F.rand(1)).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = marked.select(*[F.col(f"`{c}`") for c in df.columns], F.shiftright("_m", 33).cast("int").alias("_pid"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    laid = _written(placed)
    # one row per range: as many as tasks wrote
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    steps = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    return laid, steps


def _written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the folder that all machines share; it goes when the session's JVM ends."""
    import uuid

    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{_shared_folder(spark)}/laid-{uuid.uuid4().hex}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    names = [f"c{i}" for i in range(len(df.columns))]
    df.toDF(*names).write.parquet(f"{path.toString()}/data")
    return spark.read.parquet(f"{path.toString()}/data").toDF(*df.columns)


def rowidvt(df: DataFrame, order: list[str]) -> DataFrame:
    """df with rowid, 1-based in `order`; equal rows of `order` get theirs in any order.

    Ranges are sorted in parallel and written once; each row adds its range's offset. No single task
    sees all rows, and a value that very many rows share is dealt to many ranges.
    """
    laid, steps = _laid(df, order)
    return laid.join(steps, "_pid").select((F.col("_at") + F.col("_off") + 1).alias("rowid"), *[F.col(f"`{c}`") for c in df.columns])


def slidingwindow(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Rows of window k (wid) are the last n up to row k, both from 0."""
    laid, steps = _laid(df, order)
    at = F.col("_at") + F.col("_off")
    return laid.join(steps, "_pid").select(F.explode(F.sequence(at, F.least(at + n - 1, F.col("_total") - 1))).alias("wid"), *[F.col(f"`{c}`") for c in df.columns])


def _in_groups(df: DataFrame, by: list[str], order: list[Column], run, out: T.StructType) -> DataFrame:
    """What run(rows, starts) yields over whole groups, many at a time: an Arrow table, each group's rows in `order`, and where its groups begin. A task holds a batch of rows, or the one group that is larger."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1

    def each(batches):
        import numpy as np
        import pyarrow as pa

        def begins(x):
            return np.flatnonzero(np.asarray(x.column("_first").to_pylist(), dtype=bool))

        def over(held):
            rows = pa.Table.from_batches(held).combine_chunks()
            for made in run(rows, begins(rows)):
                yield from made.select(out.names).combine_chunks().to_batches()

        held: list = []
        for batch in batches:
            starts = begins(batch)
            if not len(starts) or (last := int(starts[-1])) == 0 and not held:
                held.append(batch)
                continue
            yield from over([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        if held:
            yield from over(held)

    return df.withColumn("_first", first).mapInArrow(each, out)


def timeslidingwindow(df: DataFrame, by: list[str], ts: str, seconds: float) -> DataFrame:
    """Windows of rows at most `seconds` apart, a new one (wid) whenever a row falls past the end of the last; rows after the last such row's window are dropped unless it is window 0. A group is worked on by one task."""
    out = T.StructType([T.StructField("wid", T.LongType()), *df.schema.fields])
    span = int(seconds * 1_000_000 // 1)

    def run(rows, starts):
        import numpy as np
        import pyarrow as pa

        times = rows.column("_t").combine_chunks()
        known, micros = np.asarray(times.is_valid()), np.asarray(times.fill_null(0))
        low, high, number = [], [], []
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows], strict=True):
            t = micros[a : a + int(known[a:z].sum())]  # NULL times come last and fall past no end
            # by row: the first row past the end of a window that it begins, and the first row of the window that it ends
            past, head = np.searchsorted(t, t + span, "right").tolist(), np.searchsorted(t, t - span).tolist()
            at, wid = past[0] if past else 0, 0
            low.append(a)
            high.append(a + at if at < len(t) else z)
            number.append(0)
            while at < len(t):
                wid += 1
                low.append(a + head[at])
                high.append(a + at + 1)
                number.append(wid)
                at = past[head[at]]
        low, number = np.array(low), np.array(number)
        size = np.array(high) - low
        end = np.cumsum(size)
        for a in range(0, int(end[-1]), 100_000):
            place = np.arange(a, min(a + 100_000, int(end[-1])))
            w = np.searchsorted(end, place, "right")
            yield rows.take(pa.array(low[w] + place - end[w] + size[w])).append_column("wid", pa.array(number[w], pa.int64()))

    timed = df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    return _in_groups(timed, by, [F.col("_t").asc_nulls_last()], run, out)


def toeav(df: DataFrame, entity: str) -> DataFrame:
    """(rid, colname, val) of every cell but the entity's; NULL cells stay."""
    rest = [c for c in df.columns if c != entity]
    return df.select(F.col(entity).alias("rid"), *[F.col(c).cast("string").alias(c) for c in rest]).unpivot(["rid"], rest, "colname", "val")


def fromeav(df: DataFrame, attributes: list[str]) -> DataFrame:
    """One row an entity of (rid, colname, val), a column for each attribute; one pass, no pivot job."""
    return df.groupBy("rid").agg(*[F.max(F.when(F.col("colname") == a, F.col("val"))).alias(a) for a in attributes])


def setschema(df: DataFrame, schema: str) -> DataFrame:
    """Columns renamed, cast and padded with NULL by place; `schema` as in DDL."""
    fields = T.StructType.fromDDL(schema).fields
    have = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*[(have[i].try_cast(f.dataType) if i < len(have) else F.lit(None).cast(f.dataType)).alias(f.name) for i, f in enumerate(fields)])


def coltypes(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.dtypes, "column string, type string")


def queryplan(df: DataFrame) -> DataFrame:
    """The physical plan, a row a line."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return df.sparkSession.createDataFrame([(i, line.strip()) for i, line in enumerate(plan.split("\n")) if line.strip()], "step int, operation string")


def range_(spark: SparkSession, start: int, stop: int | None = None, step: int = 1) -> DataFrame:
    """C1 from start up to, without, stop; with one argument 1 to it."""
    return spark.range(1, start + 1) .toDF("C1") if stop is None else spark.range(start, stop, step).toDF("C1")


def whilevt(spark: SparkSession, body, start: int = 0, most: int | None = None) -> DataFrame:
    """(C1): the counter for as long as body(counter), a DataFrame, has 1 in its first cell; with `most` for so many turns at most."""
    out = []
    for i in count(start) if most is None else range(start, start + most):
        row = body(i).first()
        if row is None or row[0] != 1:
            break
        out.append((i,))
    return spark.createDataFrame(out, "C1 long")


def expand(df: DataFrame, multisets: list[str]) -> DataFrame:
    """Rows multiplied by the arrays of structs in `multisets`, left to right; a row with an empty one goes."""
    for m in multisets:
        rest = [F.col(f"`{c}`") for c in df.columns if c != m]
        df = df.select(*rest, F.inline(m))
    return df


def range_join(points: DataFrame, point: str, intervals: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point <= high. Each interval is listed under the buckets of `width` that it covers and meets the points of its buckets by an equi-join; a point has one bucket, so no pair comes twice.

    A width near the common interval length keeps the copies few. NULL and empty intervals match nothing.
    """
    bucket = lambda c: F.floor(c / F.lit(float(width)))
    ok = intervals.where(F.col(low) <= F.col(high))
    spread = ok.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    met = points.withColumn("_bucket", bucket(F.col(point))).join(spread, "_bucket")
    return met.where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("_bucket")


#: Rows that a shuffle gives to one task, about: what a task sorts or counts stays below some 100 MB.
TASK_ROWS = 150_000


@contextmanager
def _partitions(spark: SparkSession, rows: int):
    """How many partitions `rows` need; shuffles run inside have so many at least, then the session's own setting holds again."""
    key = "spark.sql.shuffle.partitions"
    before, n = spark.conf.get(key), rows // TASK_ROWS + 1
    try:
        spark.conf.set(key, max(int(before), n))
        yield n
    finally:
        spark.conf.set(key, before)


def freqitemsets(df: DataFrame, row: str, item: str, threshold: int, maxlen: int | None = None) -> DataFrame:
    """(items, itemset_length, itemset_frequency): sets of items that share at least `threshold` rows, level by level up to `maxlen`, without one to the longest.

    Level l extends the frequent sets of level l - 1 by a larger frequent item of the same row and
    counts those whose last pair is frequent too; each level is written to storage by checkpoint().
    Each level is shuffled into partitions by its number of rows, known before, so that tasks don't grow.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        _checkpoint_dir(spark)
    given = df.select(F.col(row).alias("row"), F.col(item).cast("string").alias("item")).where("item <> ''")
    with _partitions(spark, given.count()) as n:
        rows = given.repartition(n, "row").distinct()
        single = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold).checkpoint()
        # after: the larger items of the row, which the next level extends a set by
        after = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("item"))) - 1
        rows = rows.join(single.select("item"), "item").repartition(n, "row").withColumn("after", after).checkpoint()
    level = rows.select("row", F.array("item").alias("items"), F.col("item").alias("last"), "after")
    out = [single.select(F.array("item").alias("items"), F.lit(1).alias("itemset_length"), F.col("n").alias("itemset_frequency"))]
    for size in count(2) if maxlen is None else range(2, maxlen + 1):
        with _partitions(spark, level.agg(F.coalesce(F.sum("after"), F.lit(0))).first()[0]) as n:
            begun = level.select("row", "items", "last").where("after > 0").repartition(n, "row")
            longer = begun.join(rows.repartition(n, "row"), "row").where(F.col("item") > F.col("last")).select("row", F.concat("items", F.array("item")).alias("items"), F.col("item").alias("last"), "after")
            counted = longer.groupBy("items").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold).checkpoint()
            if counted.isEmpty():
                break
            out.append(counted.select("items", F.lit(size).alias("itemset_length"), F.col("n").alias("itemset_frequency")))
            if size != maxlen:
                level = longer.join(counted.select("items"), "items").checkpoint()
    return reduce(DataFrame.unionByName, out)


def _shared_folder(spark: SparkSession) -> str:
    """The session's own setting, else - in a local session - a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if not named:
        import tempfile

        named = f"file://{tempfile.gettempdir()}/sparkloom-{spark.sparkContext.applicationId}"
    return named.rstrip("/")


def _checkpoint_dir(spark: SparkSession) -> None:
    spark.sparkContext.setCheckpointDir(_shared_folder(spark))


#: Edges that a task of graphcliques holds to look others up in, about.
BLOCK_EDGES = 4_000_000


def _triangles(e: DataFrame) -> DataFrame:
    """(x, pq): for nodes x of the edges e (u < v, numbers below 2^31) the edges p, q, p, q ... between its neighbours, save those between two smaller ones; several rows a node.

    A node lists its neighbours of higher degree, about sqrt(edges) of them at most, so a hub has no wedges
    of all its neighbours. Edges are dealt to blocks of nodes; a list goes once to every block that has
    a node of it, and only pairs that are edges leave the block: wedges are never shuffled.
    """
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = both.groupBy("u").agg(F.count(F.lit(1)).cast("int").alias("d"))
    from_, to = degree.select("u", F.struct("d", "u").alias("ku")), degree.select(F.col("u").alias("v"), F.struct("d", "u").alias("kv"))
    up = e.join(from_, "u").join(to, "v").select(F.expr("IF(ku < kv, struct(u, kv AS k), struct(v AS u, ku AS k))").alias("e")).select("e.u", "e.k")
    near = _written(up.groupBy("u").agg(F.transform(F.array_sort(F.collect_list("k")), lambda k: k["u"]).alias("near")))
    blocks = e.count() // BLOCK_EDGES + 1
    listed = near.select("u", F.explode("near"))
    bounds = [] if blocks == 1 else sorted(set(listed.select(F.expr(f"percentile_approx(u, array({', '.join(str(i / blocks) for i in range(1, blocks))}), 10000)")).first()[0]))

    def dealt(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            u, lists = batch.column("u").to_numpy(), batch.column("near")
            at, v = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(u)), np.diff(at))
            # the last of a list begins no pair
            first = np.ones(len(v), dtype=bool)
            first[at[1:] - 1] = False
            pairs = np.unique(row[first] * np.int64(len(bounds) + 1) + np.searchsorted(bounds, v[first]))
            for kind, rows, block in ((0, np.arange(len(u)), np.searchsorted(bounds, u)), (1, *np.divmod(pairs, len(bounds) + 1))):
                made = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(np.full(len(rows), kind), pa.int32()), *made.columns], ["block", "kind", "u", "near"])

    def closed(batches):
        import numpy as np
        import pyarrow as pa

        held, own, keys = [], [], None
        for batch in batches:
            kinds, lists = batch.column("kind").to_numpy(), batch.column("near")
            at, w = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py(), lists.flatten().to_numpy().astype(np.int64)
            u, row = batch.column("u").to_numpy().astype(np.int64), np.repeat(np.arange(len(kinds)), np.diff(at))
            mine = kinds[row] == 0
            if mine.any():
                held.append((u[row[mine]] << 32) | w[mine])
            if not kinds.any():
                continue
            if keys is None:
                keys = np.sort(np.concatenate(held)) if held else np.empty(0, np.int64)
                own = np.unique(keys >> 32)
                held = []
            place = np.flatnonzero(~mine & np.isin(w, own))
            left = at[1:][row[place]] - place - 1
            place, left = place[left > 0], left[left > 0]
            total = np.cumsum(left)
            for a in range(0, int(total[-1]) if len(total) else 0, 2_000_000):
                i, z = np.searchsorted(total, [a, a + 2_000_000], "right")
                p, n = place[i:z], left[i:z]
                first = np.repeat(p, n)
                second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
                key = (w[first] << 32) | w[second]
                hit = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key if len(keys) else np.zeros(len(key), dtype=bool)
                three = np.sort(np.stack([u[row[first[hit]]], w[first[hit]], w[second[hit]]]), axis=0).astype(np.int32)
                x = np.concatenate([three[0], three[1]])
                order = np.argsort(x, kind="stable")
                pq = np.stack([np.concatenate([three[1], three[0]]), np.concatenate([three[2], three[2]])], axis=1)[order].reshape(-1)
                names, begin = np.unique(x[order], return_index=True)
                ends = np.append(begin * 2, len(pq)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.ListArray.from_arrays(pa.array(ends), pa.array(pq))], ["x", "pq"])

    laid = near.mapInArrow(dealt, "block int, kind int, u int, near array<int>").repartitionById(len(bounds) + 1, F.col("block"))
    return laid.sortWithinPartitions("kind").mapInArrow(closed, "x int, pq array<int>")


def graphcliques(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(cliqueid, nodeid) of all maximal cliques of more than two nodes, numbered in the order of their sorted members.

    A clique belongs to its smallest node: each node's larger neighbours and the edges among them go
    to one task, so a task holds a neighbourhood and a block of edges, never the graph. Maximality is
    checked against smaller neighbours too. Within, nodes are numbers: their own, or places among the names.
    """
    kinds = dict(edges.dtypes)
    whole, names = {kinds[a], kinds[b]} <= {"tinyint", "smallint", "int", "bigint"}, None
    kind = "long" if whole else "string"
    e = edges.select(F.least(F.col(a).cast(kind), F.col(b).cast(kind)).alias("u"), F.greatest(F.col(a).cast(kind), F.col(b).cast(kind)).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct()
    e = _written(e)
    ends = e.agg(F.min("u"), F.max("v")).first() if whole else None
    if not whole or ends[0] is not None and (ends[0] < 0 or ends[1] >= 1 << 31):
        names = _written(rowidvt(e.select(F.col("u").cast("string").alias("name")).union(e.select(F.col("v").cast("string"))).distinct(), ["name"]))
        for c in ("u", "v"):
            e = e.withColumn("name", F.col(c).cast("string")).drop(c).join(names, "name").drop("name").withColumnRenamed("rowid", c)
        e = _written(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    inner = _triangles(e.select(F.col("u").cast("int"), F.col("v").cast("int")))

    def cliques(x: int, p: list[int], q: list[int]) -> list[list[int]]:
        nodes = sorted({*p, *q})
        # sets of neighbours as bits of an integer
        place, near = {n: i for i, n in enumerate(nodes)}, [0] * len(nodes)
        for i, j in zip(p, q, strict=True):
            i, j = place[i], place[j]
            near[i] |= 1 << j
            near[j] |= 1 << i

        def bits(s: int):
            while s:
                low = s & -s
                yield low.bit_length() - 1
                s ^= low

        found: list[list[int]] = []
        smaller = sum(1 << i for i, n in enumerate(nodes) if n < x)
        stack = [(0, ((1 << len(nodes)) - 1) ^ smaller, smaller)]
        while stack:
            chosen, able, done = stack.pop()
            if not able:
                if not done and chosen.bit_count() > 1:
                    found.append([x, *[nodes[i] for i in bits(chosen)]])
                continue
            pivot = max(bits(able | done), key=lambda n: (near[n] & able).bit_count())
            for n in bits(able & ~near[pivot]):
                one = 1 << n
                stack.append((chosen | one, able & near[n], done & near[n]))
                able, done = able ^ one, done | one
        return found

    def run(rows, starts):
        import pyarrow as pa

        xs, pq = rows.column("x").to_pylist(), rows.column("pq").combine_chunks()
        at, flat = pq.offsets.to_numpy() - pq.offsets[0].as_py(), pq.flatten().to_numpy()
        found: list[list[int]] = []
        for i, z in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows], strict=True):
            own = flat[at[i] : at[z]]
            found += cliques(xs[i], own[::2].tolist(), own[1::2].tolist())
            if len(found) > 50_000:
                yield pa.table({"members": pa.array(found, pa.list_(pa.int32()))})
                found = []
        yield pa.table({"members": pa.array(found, pa.list_(pa.int32()))})

    made = _written(_in_groups(inner, ["x"], [F.col("x")], run, T.StructType([T.StructField("members", T.ArrayType(T.IntegerType()))])))
    if names is None:
        text = F.array_sort(F.transform("members", lambda m: m.cast("string")))
        named = rowidvt(made.select(text.alias("members")).withColumn("_k", F.array_join("members", "\x00")), ["_k"])
        return named.select((F.col("rowid") - 1).alias("cliqueid"), F.explode("members").alias("nodeid"))
    # places of names sort as the names do
    named = rowidvt(made.withColumn("_k", F.array_join(F.transform("members", lambda m: F.lpad(m.cast("string"), 10, "0")), "")), ["_k"])
    rows = named.select((F.col("rowid") - 1).alias("cliqueid"), F.explode("members").alias("_n"))
    return rows.join(names, F.col("_n") == F.col("rowid")).select("cliqueid", F.col("name").alias("nodeid"))


def _rounds(degrees: list[int]) -> int:
    """Half the least of four bounds of a graph's diameter by its degrees (order and maximum, inverse degree, degree sequence); none for a single node."""
    import math

    n, kinds = len(degrees), len(set(degrees))
    if n < 2:
        return 0
    inverse = (3 * sum(1 / d for d in degrees) + 3) * math.log(n) / math.log(math.log(n)) if n > 16 else n
    least = int(min(n - max(2, max(degrees)) + 2, inverse, 1 + 3 * (n - kinds + 1) / (min(degrees) + 1), n - kinds + 2)) // 2
    return least if least >= 0 else n // -least


def graphpowerhash(edges: DataFrame, by: list[str], a: str, b: str, steps: int | None = None, directed: bool = True) -> DataFrame:
    """(by, hash): a JSON list of sorted node hashes, equal for isomorphic graphs of `by`. A graph is worked on by one task: for many small graphs."""
    out = T.StructType([*[edges.schema[c] for c in by], T.StructField("hash", T.StringType())])

    def hashed(form: tuple) -> str:
        import base64
        import hashlib
        import json

        near: dict = {}
        for u, v in zip(form[::2], form[1::2], strict=True):
            near.setdefault(u, []).append((v, b"\x1d1"))
            near.setdefault(v, []).append((u, b"\x1d0" if directed else b"\x1d1"))
        digest = lambda s: hashlib.md5(s).digest()
        begin = {n: f"{len(x)}\x1f\x1e".encode() for n, x in near.items()}
        state = {n: digest(x) for n, x in begin.items()}
        for _ in range(_rounds([len(x) for x in near.values()]) if steps is None else steps if len(near) > 1 else 0):
            state = {n: digest(begin[n] + b"\x1e".join(sorted(state[m] + t for m, t in x))) for n, x in near.items()}
        return json.dumps([base64.b64encode(h).decode().rstrip("=") for h in sorted(state.values())], separators=(",", ":"))

    # the hash depends on the form alone, nodes numbered as they come: small graphs often have the same
    known: dict = {}

    def run(rows, starts):
        import pyarrow as pa

        names = [x for pair in zip(rows.column(a).to_pylist(), rows.column(b).to_pylist(), strict=True) for x in pair]
        made = []
        for i, z in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows], strict=True):
            number: dict = {}
            form = tuple([number.setdefault(x, len(number)) for x in names[2 * i : 2 * z]])
            if (h := known.get(form)) is None:
                h = hashed(form)
                if len(form) <= 64 and len(known) < 50_000:
                    known[form] = h
            made.append(h)
        yield rows.take(pa.array(starts)).select(by).append_column("hash", pa.array(made, pa.string()))

    return _in_groups(edges.select(*dict.fromkeys([*by, a, b])), by, [F.col(a), F.col(b)], run, out)


def unindexed(df: DataFrame) -> DataFrame:
    """A barrier: the optimiser does not look through it."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=False)


def cached(df: DataFrame) -> DataFrame:
    return df.persist()


__all__ = [n for n in list(globals()) if not n.startswith("_")] + ["col"]
