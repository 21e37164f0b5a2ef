"""What the operators of this subpackage have in common: the shared folder, written tables, ordered numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where the session names none, a local session (tests) gets a temporary folder of its own;
    a cluster session is refused, since a machine-local folder would be invisible to the executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    made = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def workplace(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. What is written there is an intermediate: it goes when the session's JVM ends, where forget() has not removed it before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return f"{path.toString()}/data"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and fixes values that a second evaluation could change."""
    spark = df.sparkSession
    path = workplace(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that written() made and that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Ranges of files that are read as one task each; beyond it tasks take several.
MOST_TASKS = 100_000


def ranges_of(manifest: DataFrame, count: str, step: int, keep: list[str]) -> DataFrame:
    """Rows (*keep, first, n) that cover 0 .. `count` - 1 of every manifest row in steps, spread evenly over tasks; none of them passes the driver."""
    total = manifest.agg(F.sum(F.ceil(F.col(count) / step))).first()[0] or 1
    spread = manifest.where(F.col(count) > 0).select(*keep, F.col(count).alias("_c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(step).cast("long"))).alias("first"))
    return spread.select(*keep, "first", F.least(F.lit(step).cast("long"), F.col("_c") - F.col("first")).alias("n")).repartition(min(int(total), MOST_TASKS))


def numbered(df: DataFrame, group: str, order: list[str], weight: str | None, out: str, total: str | None = None) -> DataFrame:
    """Add `out`, the running sum of `weight` (None: 1) over the rows before this one in its `group`, in `order`.

    No task holds a whole group: rows are dealt by range over (group, order), each task sums its own
    rows, the sums of the (task, group) pairs - at most tasks + groups of them - become offsets, and
    those come back by a join on both keys. With `total`, the group's sum is added too.
    Equal rows of `order` get their numbers in any order and are dealt to many tasks, so a value that
    a third of all rows share fills no task. The result is read from a written table.
    """
    schema = df.schema
    for extra in ("_pid", "_own"):
        if extra in schema.names:
            raise ValueError(f"column {extra} is reserved")

    def local(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        pid, last, acc = TaskContext.get().partitionId(), (), 0
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(group)).to_pylist()
            sizes = pc.fill_null(batch.column(batch.schema.get_field_index(weight)), 0).to_pylist() if weight else [1] * len(keys)
            own = []
            for k, n in zip(keys, sizes, strict=True):
                if (k,) != last:
                    last, acc = (k,), 0
                own.append(acc)
                acc += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pid] * len(keys), pa.int32()), pa.array(own, pa.int64())], names=[*batch.schema.names, "_pid", "_own"])

    by = [F.col(group), *[F.col(c) for c in order]]
    from pyspark.sql import types as T

    shaped = T.StructType([*schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_own", T.LongType())])
    dealt = written(df.repartitionByRange(*by, F.rand(1)).sortWithinPartitions(*by).mapInArrow(local, shaped), "numbered")
    step = F.coalesce(F.col(weight), F.lit(0)).cast("long") if weight else F.lit(1).cast("long")
    sums = dealt.groupBy(group, "_pid").agg(F.sum(step).alias("_n"))
    from pyspark.sql import Window

    # one row per (task, group): as many rows as tasks and groups together, whatever the table's size
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(group).alias("_g"), F.col("_pid").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("_total"))
    joined = dealt.join(offsets, dealt[group].eqNullSafe(F.col("_g")) & (F.col("_pid") == F.col("_p")), "left")
    made = [F.col(c) for c in schema.names] + [(F.col("_own") + F.col("_before")).alias(out)]
    return joined.select(*made, *([F.col("_total").alias(total)] if total else []))


def rows_named(df: DataFrame, stays: DataFrame, sha) -> DataFrame:
    """The rows of df whose (doc_id, `sha`) is among the rows (_id, _sha) of `stays`, one row of each such pair, with df's columns.

    `stays` must be a written table without repeats that says in _n how many rows of df share the
    pair, so that rows without a twin - as a rule all - pass by a join alone.
    """
    named = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col("doc_id").alias("_d"), sha.alias("_s"))
    met = named.join(stays, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_s") == F.col("_sha")))
    once = met.where("_n = 1").select("_row")
    if not stays.where("_n > 1").isEmpty():
        # repeated rows: equal id and equal text; any one of them
        once = once.unionByName(met.where("_n > 1").groupBy("_d", "_s").agg(F.first("_row").alias("_row")).select("_row"))
    return once.select("_row.*")
