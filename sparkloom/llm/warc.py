"""Operator 4: WARC archives, and the normaliser for those that are one gzip stream.

A monolithic archive, compressed as a whole, can only be read from its beginning. normalise()
inflates each such file once, as a stream, rewrites every record as a gzip member of its own and
writes a sidecar index of the members' offsets, after which any record is read by one seek.

Tasks name their files after their attempt and return one manifest row each; files of lost or
repeated attempts are in no manifest. Memory is bounded by one record.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm._shared import MOST_TASKS, ranges_of, workplace, written

#: Shorter payloads are never revisits.
LEAST_BYTES = 100
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_RECORDS = 2048


def record(page: dict) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit with the HTTP head alone."""
    body = b"" if page["refers"] else page["payload"]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page['payload_bytes']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if page['refers'] else 'response'}", f"WARC-Record-ID: <{page['id']}>", f"WARC-Date: {DATE}"]
    if page["url"]:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", page["url"]))
    lines.append(f"WARC-Payload-Digest: sha256:{page['digest']}")
    if page["refers"]:
        lines += [f"WARC-Refers-To: <{page['refers']}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(head) + len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + head + body + b"\r\n\r\n"


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of an inflated stream that arrives in pieces; raises on a broken one."""
    held = bytearray()
    need = None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                size = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", held[:end])
                if not held.startswith(b"WARC/") or not size:
                    raise ValueError("not a WARC record")
                need = end + 4 + int(size[1]) + 4
            if len(held) < need:
                break
            if held[need - 4 : need] != b"\r\n\r\n":
                raise ValueError("record without an end")
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("truncated archive")


def inflate(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one member or several, in pieces."""
    engine = zlib.decompressobj(31)
    open_ = False
    for block in blocks:
        while block:
            if engine.eof:
                engine = zlib.decompressobj(31)
            plain = engine.decompress(block, 1 << 20)
            open_ = not engine.eof
            if plain:
                yield plain
            block = engine.unused_data if engine.eof else engine.unconsumed_tail
    if open_:
        if plain := engine.flush():
            yield plain
        if not engine.eof:
            raise ValueError("truncated gzip stream")


def parse(raw: bytes) -> dict:
    """Headers of a record, of its HTTP head, and the payload."""
    head, _, block = raw[:-4].partition(b"\r\n\r\n")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = lambda b: {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in b.decode().split("\r\n")[1:])}
    return {"warc": fields(head), "http": fields(http), "payload": payload}


def with_types(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Rows page_id, url, html (null: empty), payload_bytes, digest, copy, first, revisit.

    Of equal payloads of `least` bytes or more the smallest page_id is the response, null being the
    largest; of repeated rows with that id the first. The payloads' keys are grouped without the
    payloads; these are shuffled once, by (page_id, digest), so that no key gathers all copies.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), body.alias("html"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("digest"))
    keys = written(rows.groupBy("page_id", "digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n")), "keys")
    firsts = written(keys.groupBy("digest").agg(F.min("page_id").alias("first")), "firsts")
    typed = written(keys.join(firsts, "digest").select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "n", "first", ((F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit")), "typed")
    met = rows.join(typed, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")))
    if typed.where("n > 1").isEmpty():
        numbered = met.withColumn("copy", F.lit(1))
    else:
        from pyspark.sql import Window

        again = met.where("n > 1").withColumn("copy", F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url")))
        numbered = met.where("n = 1").withColumn("copy", F.lit(1)).unionByName(again)
    return numbered.select("page_id", "url", "html", "payload_bytes", "digest", "copy", "first", (F.col("revisit") | (F.col("copy") > 1) & (F.col("payload_bytes") >= least)).alias("revisit"))


_MANIFEST = T.StructType([T.StructField("file", T.StringType()), T.StructField("n", T.LongType())])


def write_archives(typed: DataFrame, out: str) -> DataFrame:
    """One monolithic .warc.gz per task under `out`; returns the manifest (file, n), a written table."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        task, stream, n = TaskContext.get(), None, 0
        store, folder = fs.FileSystem.from_uri(out)
        name, engine = f"whole-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", zlib.compressobj(6, zlib.DEFLATED, 31)
        urn = lambda page, digest, copy: f"urn:page:{'null' if page is None else page}:{digest[:32]}:{copy}"
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for p in batch.slice(at, 64).to_pylist():
                    if stream is None:
                        store.create_dir(folder, recursive=True)
                        stream = store.open_output_stream(f"{folder}/{name}", compression=None)
                    page = {"payload": p["html"].encode(), "id": urn(p["page_id"], p["digest"], p["copy"]), "refers": urn(p["first"], p["digest"], 1) if p["revisit"] else None}
                    stream.write(engine.compress(record(p | page)))
                    n += 1
        if stream is not None:
            stream.write(engine.flush())
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{out}/{name}"]), pa.array([n], pa.int64())], names=["file", "n"])

    return written(typed.mapInArrow(run, _MANIFEST), "archives")


def normalise(archives: DataFrame, out: str) -> DataFrame:
    """Every archive of the manifest rewritten with one gzip member a record, and its index beside it: the members' offsets and the end, 8 bytes each."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for row in batch.to_pylist():
                source, path = fs.FileSystem.from_uri(row["file"])
                store, folder = fs.FileSystem.from_uri(out)
                store.create_dir(folder, recursive=True)
                name, at, n = f"{path.rpartition('/')[2].removesuffix('.warc.gz')}-{attempt}.warc.gz", 0, 0
                with source.open_input_stream(path, compression=None) as f, store.open_output_stream(f"{folder}/{name}", compression=None) as data, store.open_output_stream(f"{folder}/{name}.idx") as index:
                    for raw in split_records(inflate(iter(lambda: f.read(1 << 20), b""))):
                        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = engine.compress(raw) + engine.flush()
                        index.write(struct.pack("<Q", at))
                        data.write(member)
                        at, n = at + len(member), n + 1
                    index.write(struct.pack("<Q", at))
                yield pa.RecordBatch.from_arrays([pa.array([f"{out}/{name}"]), pa.array([n], pa.int64())], names=["file", "n"])

    # one archive a task: a whole-file stream can only be inflated from its start
    return written(archives.repartition(max(1, min(archives.count(), MOST_TASKS))).mapInArrow(run, _MANIFEST), "normalised")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """All records of normalised archives: page_id, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload; a response's digest is checked."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        page_of = lambda urn: None if urn.split(":")[2] == "null" else int(urn.split(":")[2])
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["file"])
                with store.open_input_file(f"{path}.idx") as f:
                    at = np.frombuffer(f.read_at(8 * (row["n"] + 1), 8 * row["first"]), "<u8").tolist()
                with store.open_input_file(path) as f:
                    for k in range(0, row["n"], 64):
                        out = []
                        for j in range(k, min(k + 64, row["n"])):
                            engine = zlib.decompressobj(31)
                            got = parse(engine.decompress(f.read_at(at[j + 1] - at[j], at[j])) + engine.flush())
                            warc = got["warc"]
                            kind, digest, refers = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha256:"), warc.get("warc-refers-to")
                            size = int(got["http"]["content-length"])
                            if kind == "response" and (len(got["payload"]) != size or hashlib.sha256(got["payload"]).hexdigest() != digest):
                                raise ValueError(f"damaged payload in {row['file']}")
                            out.append((page_of(warc["warc-record-id"].strip("<>")), size, digest, kind, page_of(refers.strip("<>")) if refers else None, got["payload"] if with_payload else None))
                        a, b, c, d, e, p = zip(*out, strict=True)
                        cols = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c), pa.array(d), pa.array(e, pa.int64())]
                        yield pa.RecordBatch.from_arrays(cols + [pa.array(p, pa.binary())] * with_payload, names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return ranges_of(manifest.withColumnRenamed("n", "records"), "records", READ_RECORDS, ["file"]).mapInArrow(run, schema)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as monolithic archives, normalised, and read back by the index. Null html has an empty payload; an empty table gives no archive."""
    typed = with_types(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(normalise(write_archives(typed, workplace(spark, "whole")), workplace(spark, "members")))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= {LEAST_BYTES} AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST_BYTES} AND page_id <> m THEN m END AS refers_to
FROM q
"""
