"""Operator 1: token ids as length-delimited binary records with masked checksums and a separate offset index.

A record is: length (8 bytes), masked CRC-32C of those (4), payload, masked CRC-32C of the payload (4),
all little-endian - the framing of public record files for training. The payload is doc_id (8, signed),
flags (1: doc_id is null, 2: ids take 4 bytes instead of 2), then the ids. Beside each file lies an
index: per record its offset and the ids before it in the file (8 bytes each), and one closing entry,
so that any record is read by two seeks.

A task writes its own pair of files, named after its attempt, into the shared folder and returns one
manifest row; only rows that Spark committed count, so lost or repeated attempts leave no trace.
"""

from __future__ import annotations

import struct
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._shared import ranges_of, workplace, written
from sparkloom.llm.encoder import default_path, encoder

END = 0
END_BYTES = struct.pack("<I", END)
_CHUNK = 512
_HEAD = struct.Struct("<QI")
#: Segments that a writing worker remembers: about 200 MB at most.
SEGMENTS = 400_000
#: Documents that a reading task takes from a file at a time.
READ_DOCS = 4096


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """CRC-32C of one byte at each distance from a chunk's end, where each distance begins in that table, and the four-table operator that moves a state past a chunk."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(0x82F63B78), first >> 1)
    at = np.zeros((_CHUNK, 256), np.uint32)
    at[0] = first
    for d in range(1, _CHUNK):
        at[d] = first[at[d - 1] & 0xFF] ^ (at[d - 1] >> 8)
    moved = np.zeros((4, 256), np.uint32)
    for k in range(4):
        state = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(_CHUNK):
            state = first[state & 0xFF] ^ (state >> 8)
        moved[k] = state
    return at[::-1].ravel().copy(), np.arange(0, _CHUNK * 256, 256), moved.tolist()


@cache
def _byte_table() -> list[int]:
    return _tables()[0][-256:].tolist()


def crc32c(data: bytes) -> int:
    """CRC-32C (Castagnoli)."""
    table, offsets, moved = _tables()
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    if n < 32:
        state = 0xFFFFFFFF
        one = _byte_table()
        for b in data:
            state = one[(state ^ b) & 0xFF] ^ (state >> 8)
        return state ^ 0xFFFFFFFF
    rows = -(-n // _CHUNK)
    padded = np.zeros(rows * _CHUNK, np.uint8)
    start = len(padded) - n
    padded[start:] = raw
    padded[start : start + 4] ^= 0xFF  # the initial state
    parts = np.bitwise_xor.reduce(table.take(padded.reshape(rows, _CHUNK) + offsets), axis=1).tolist()
    state, (a, b, c, d) = 0, moved
    for x in parts:
        state = a[state & 255] ^ b[state >> 8 & 255] ^ c[state >> 16 & 255] ^ d[state >> 24] ^ x
    return state ^ 0xFFFFFFFF


def masked(data: bytes) -> int:
    crc = crc32c(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the record at `at`, and where the next begins; raises on any damage."""
    size, check = _HEAD.unpack_from(data, at)
    if masked(data[at : at + 8]) != check:
        raise ValueError(f"damaged length at {at}")
    payload = data[at + 12 : at + 12 + size]
    if len(payload) != size or masked(payload) != struct.unpack_from("<I", data, at + 12 + size)[0]:
        raise ValueError(f"damaged record at {at}")
    return payload, at + 16 + size


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return struct.pack("<qB", doc_id or 0, (doc_id is None) + 2 * wide) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = struct.unpack_from("<qB", payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9).astype("<u4")


def write_records(df: DataFrame, out: str, text: str = "text", path: str | None = None) -> DataFrame:
    """Encode df's texts, close each with id 0, and write them as record files under `out` in ascending doc_id order.

    Returns the manifest, a written table: part, file, n_docs, n_tokens. Null texts count as empty
    and give a record of the closing id alone; null doc_ids come first; equal doc_ids are ordered by
    a hash of their texts, then by these, and are dealt to many tasks. Texts of any length are encoded
    whole. An empty table gives no file. Other columns, whatever their names, are not read.
    """
    path = path or default_path()
    plain = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        own, task = encoder(path), TaskContext.get()
        own.segments = SEGMENTS
        store, folder = fs.FileSystem.from_uri(out)
        name, data, index = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.rec", None, None
        at = n_docs = n_tokens = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                if data is None and part.num_rows:
                    store.create_dir(folder, recursive=True)
                    data, index = store.open_output_stream(f"{folder}/{name}"), store.open_output_stream(f"{folder}/{name}.idx")
                records, entries = [], []
                for doc_id, raw in zip(part.column(0).to_pylist(), own.encode(part.column(1).to_pylist()), strict=True):
                    records.append(frame(pack(doc_id, np.frombuffer(raw + END_BYTES, "<u4"))))
                    entries.append(struct.pack("<QQ", at, n_tokens))
                    at, n_docs, n_tokens = at + len(records[-1]), n_docs + 1, n_tokens + len(raw) // 4 + 1
                if records:
                    data.write(b"".join(records))
                    index.write(b"".join(entries))
        if data is not None:
            index.write(struct.pack("<QQ", at, n_tokens))
            data.close()
            index.close()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([f"{out}/{name}"]), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], names=["part", "file", "n_docs", "n_tokens"])

    # rows that agree in all of the order are equal records, so chance may deal them out
    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = plain.repartitionByRange(*order, F.rand(1)).sortWithinPartitions(*order, "text")
    return written(dealt.mapInArrow(write, "part int, file string, n_docs long, n_tokens long"), "manifest")


def read_records(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every record of the manifest's files, checked: doc_id, start (ids of all records before it), n_tokens, ids_crc32 and, if asked for, ids."""
    from pyspark.sql import Window

    # one row a file, as many as writing tasks: a running sum over them is one task's work
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    ranges = ranges_of(based, "n_docs", READ_DOCS, ["file", "base"])

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                store, name = fs.FileSystem.from_uri(row["file"])
                with store.open_input_file(f"{name}.idx") as f:
                    entries = np.frombuffer(f.read_at(16 * (row["n"] + 1), 16 * row["first"]), "<u8").reshape(-1, 2)
                with store.open_input_file(name) as f:
                    k = 0
                    while k < row["n"]:
                        # as many whole records as fit 8 MB, one at least
                        to = max(k + 1, int(np.searchsorted(entries[:, 0], entries[k, 0] + np.uint64(8 << 20), side="right")) - 1)
                        to = min(to, row["n"])
                        data, at = f.read_at(int(entries[to, 0] - entries[k, 0]), int(entries[k, 0])), 0
                        made = []
                        for j in range(k, to):
                            payload, at = unframe(data, at)
                            doc_id, ids = unpack(payload)
                            made.append((doc_id, row["base"] + int(entries[j, 1]), len(ids), zlib.crc32(ids.tobytes()), ids.tolist() if with_ids else None))
                        a, b, c, d, e = zip(*made, strict=True)
                        cols = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64())]
                        yield pa.RecordBatch.from_arrays(cols + [pa.array(e, pa.list_(pa.int64()))] * with_ids, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
                        k = to

    return ranges.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as records in doc_id order and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_records(write_records(docs, workplace(spark, "records")))
