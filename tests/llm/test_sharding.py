import zlib
from collections import Counter, defaultdict

import numpy as np

from sparkloom.llm.sharding import jump_hash, op7_sharding, shard_files, with_shards

SF = "/root/testdata/sf0.01"


def slow(key, n):
    """The published recurrence, one key at a time."""
    b, j, key = -1, 0, key & (2**64 - 1)
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_equals_the_recurrence():
    keys = [0, 1, 2, 255, 2**63, 2**64 - 1, *range(1000, 3000, 7)]
    for n in (1, 2, 16, 17, 1000):
        assert jump_hash(np.array(keys, np.uint64), n).tolist() == [slow(k, n) for k in keys]


def test_growth_moves_rows_into_the_new_shard_only():
    keys = np.arange(100_000, dtype=np.uint64)
    a, b = jump_hash(keys, 16), jump_hash(keys, 17)
    moved = a != b
    assert set(b[moved].tolist()) == {16} and abs(moved.mean() - 1 / 17) < 0.005
    counts = np.bincount(a, minlength=16)
    assert counts.min() > 0.95 * counts.mean()


def test_query_keeps_the_contract(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op7_sharding(spark, SF).collect()
    assert len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["shard"] == slow(r["doc_id"], 16) and r["grown_shard"] in (r["shard"], 16) and r["grown_shard"] == slow(r["doc_id"], 17)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(16))


def test_nulls_negatives_repeats_and_empty(spark, tmp_path):
    rows = [(None, "a", 1), (None, "b", 2), (-5, "c", 3), (-5, "c", 3), (2**62 + 1, "d", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard_of int")
    got = with_shards(df, "doc_id").collect()
    by = Counter((r["doc_id"], r["shard"]) for r in got)
    assert len(by) == 3 and by[(-5, slow(-5, 16))] == 2 and by[(2**62 + 1, slow(2**62 + 1, 16))] == 1
    assert with_shards(df.limit(0), "doc_id").count() == 0
    shard_files(df, "doc_id", str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((str(r["doc_id"]), r["shard"]) for r in back.collect()) == sorted((str(r["doc_id"]), r["shard"]) for r in got)
