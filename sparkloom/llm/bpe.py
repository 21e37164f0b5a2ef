"""Operator 2: BPE encoding and decoding, with tree concatenation of long texts.

A text longer than a leaf is cut; its leaves become rows that any task encodes. Then neighbours are
joined pairwise, level by level. Cuts lie between pretokens where the text has such a place: there both
sides agree as they are. Inside a run that nothing splits, a window around the join is encoded again and
grows until both sides agree (Encoder.join). A round of Spark takes FAN leaves of a text to a task,
which joins them over four levels of the tree; the next round takes FAN of the results, so the joins of
one text run in parallel too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm._shared import written
from sparkloom.llm.encoder import Node, default_path, encoder, joined

#: Characters of a leaf, and nodes that a task joins in one round.
LEAF, FAN = 16_384, 16
#: Texts that a worker encodes at a time.
_STEP = 128


def encode(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """The columns `keep` of df and `ids`, the text's token ids as little-endian unsigned 32-bit integers; one row per row.

    A null text counts as empty and has no ids. Repeated rows stay repeated; an empty table gives an
    empty one. Texts of any length are encoded whole. Columns outside `keep` are not read; those in
    it may have any name but `ids`.
    """
    path = path or default_path()
    if "ids" in keep:
        raise ValueError("`ids` names the result")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    plain = df.select(F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("row"), body.alias("text"))
    row = T.StructType([T.StructField(f.name, f.dataType, True) for f in plain.schema["row"].dataType])
    schema = T.StructType([T.StructField("row", row), T.StructField("ids", T.BinaryType())])

    def direct(batches):
        import pyarrow as pa

        own = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.encode(part.column(1).to_pylist()), pa.binary())], names=["row", "ids"])
        own.forget()

    short = plain.where(F.length("text") <= leaf).mapInArrow(direct, schema)
    every = short.unionByName(_tree(plain.where(F.length("text") > leaf), row, path, leaf, fan))
    return every.select(*[F.col(f"row.`{c}`") for c in keep], "ids")


def _tree(df: DataFrame, row: T.StructType, path: str, leaf: int, fan: int) -> DataFrame:
    """(row, ids) of long texts. Rows on the way: uid, at (place among the text's n nodes), row (with the first alone), and a leaf's text or a node."""
    from pyspark.sql.pandas.types import to_arrow_schema

    place = [T.StructField("uid", T.StringType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType()), T.StructField("row", row)]
    cuts = T.StructType([*place, T.StructField("text", T.StringType()), T.StructField("starts", T.BooleanType()), T.StructField("ends", T.BooleanType())])
    nodes = T.StructType([*place, T.StructField("ids", T.BinaryType()), T.StructField("head", T.LongType()), T.StructField("tail", T.LongType())])
    cut_schema, node_schema = to_arrow_schema(cuts), to_arrow_schema(nodes)

    def cut(batches):
        import hashlib

        import pyarrow as pa
        from pyspark import TaskContext

        own, seen = encoder(path), 0
        for batch in batches:
            for k in range(batch.num_rows):
                body = batch.column(1)[k].as_py()
                uid = f"{TaskContext.get().partitionId()}-{seen}-{hashlib.sha256(body.encode()).hexdigest()}"
                seen += 1
                parts = own.leaves(body, leaf)
                n, opens = len(parts), [x for _, x in parts]
                rows = pa.concat_arrays([batch.column(0).slice(k, 1).cast(cut_schema.field("row").type), pa.nulls(n - 1, cut_schema.field("row").type)])
                cols = [pa.array([uid] * n), pa.array(range(n), pa.int64()), pa.array([n] * n, pa.int64()), rows, pa.array([x for x, _ in parts]), pa.array([False, *opens[:-1]]), pa.array(opens)]
                yield pa.RecordBatch.from_arrays(cols, schema=cut_schema)

    def leaves(batches):
        import pyarrow as pa

        own = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                ids = own.encode(part.column(4).to_pylist())
                head = [len(x) // 4 if on else 0 for x, on in zip(ids, part.column(5).to_pylist(), strict=True)]
                tail = [len(x) // 4 if on else 0 for x, on in zip(ids, part.column(6).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(ids, pa.binary()), pa.array(head, pa.int64()), pa.array(tail, pa.int64())], schema=node_schema)
        own.forget()

    def level(table):
        import pyarrow as pa

        own, table = encoder(path), table.sort_by("at")
        made = [Node(np.frombuffer(i, "<u4").tolist(), h, t) for i, h, t in zip(*[table.column(c).to_pylist() for c in ("ids", "head", "tail")], strict=True)]
        one = joined(made, own)
        first = table.slice(0, 1).combine_chunks()
        at, n = first.column("at")[0].as_py() // fan, -(-first.column("n")[0].as_py() // fan)
        cols = [first.column("uid"), pa.array([at], pa.int64()), pa.array([n], pa.int64()), first.column("row"), pa.array([np.array(one.ids, "<u4").tobytes()], pa.binary()), pa.array([one.head], pa.int64()), pa.array([one.tail], pa.int64())]
        return pa.Table.from_arrays(cols, names=node_schema.names)

    # dealt by leaf, so that the leaves of one text are encoded in many tasks; written, since it is read once per round
    now = written(df.mapInArrow(cut, cuts).repartition("uid", "at").mapInArrow(leaves, nodes), "leaves")
    most = now.agg(F.max("n").alias("n")).first()["n"] or 1
    done = [now.where("n = 1")]
    while most > 1:
        open_ = now.where("n > 1")
        now = open_.groupBy("uid", F.floor(F.col("at") / fan).alias("to")).applyInArrow(level, nodes)
        most = -(-most // fan)
        if most > 1:
            now = written(now, "level")
        done.append(now.where("n = 1"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("row", "ids")


def decode(df: DataFrame, keep: list[str], ids: str = "ids", path: str | None = None) -> DataFrame:
    """The columns `keep` of df with n_tokens, ids_sha256 (of the decimal ids joined by commas) and `decoded`, the library's decoding of `ids` (null: none)."""
    path = path or default_path()
    plain = df.select(F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(ids), F.lit(b"")).alias("ids"))
    schema = T.StructType([plain.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded", T.StringType())])

    def run(batches):
        import hashlib

        import pyarrow as pa

        own = encoder(path)
        digits = [str(i) for i in range(max(own.token_bytes) + 1)]
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                lists = [np.frombuffer(x, "<u4").tolist() for x in part.column(1).to_pylist()]
                shas = [hashlib.sha256(",".join([digits[i] for i in x]).encode()).hexdigest() for x in lists]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in lists], pa.int64()), pa.array(shas, pa.string()), pa.array(own.decode(lists), pa.string())], names=schema.names)

    return plain.mapInArrow(run, schema).select(*[F.col(f"row.`{c}`") for c in keep], "n_tokens", "ids_sha256", "decoded")


def round_trip(df: DataFrame) -> DataFrame:
    """Per row of df: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    back = decode(encode(df, ["doc_id"]), ["doc_id"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
