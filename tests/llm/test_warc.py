import gzip
import hashlib
import zlib

import pytest

from sparkloom.llm._shared import workplace
from sparkloom.llm.warc import inflate, normalise, read_archives, split_records, with_types, write_archives

LONG = "<p>é世" + "x" * 120


def run(spark, df):
    made = write_archives(with_types(df), workplace(spark, "w"))
    return normalise(made, workplace(spark, "n"))


def test_round_trip(spark):
    rows = [(5, "http://a/ b", LONG), (3, None, LONG), (9, "u", "short"), (8, "u", "short"), (None, "u", LONG), (1, "u", None), (2, "u", ""), (7, "u", LONG + "\r\n\r\nWARC/1.1"), (3, "z", LONG), (None, "n", "n" * 100), (None, "n", "n" * 100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = read_archives(run(spark, df), with_payload=True).collect()
    assert sorted((str(r["page_id"]), r["payload_digest"]) for r in got) == sorted((str(i), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
    groups: dict = {}
    for r in got:
        groups.setdefault(r["payload_digest"], []).append(r)
    for g in groups.values():
        ids = [r["page_id"] for r in g if r["page_id"] is not None]
        first = min(ids, default=None)
        responses = [r for r in g if r["record_type"] == "response"]
        if g[0]["payload_bytes"] < 100:
            assert len(responses) == len(g)
        else:
            assert [r["page_id"] for r in responses] == [first]
            assert all(r["refers_to"] == first for r in g if r["record_type"] == "revisit")
        assert all(hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"] and r["refers_to"] is None for r in responses)
    assert read_archives(run(spark, df.limit(0))).count() == 0


def test_members_are_standard_gzip(spark):
    files = run(spark, spark.createDataFrame([(1, "u", "a"), (2, "u", LONG)], "page_id long, url string, html string").coalesce(1)).collect()
    data = open(files[0]["file"].removeprefix("file://"), "rb").read()
    assert len(list(split_records(iter([gzip.decompress(data)])))) == 2


def test_damage_is_an_error():
    whole = gzip.compress(b"x" * 1000)
    with pytest.raises(ValueError):
        list(inflate(iter([whole[:-9]])))
    with pytest.raises((ValueError, zlib.error)):
        list(split_records(inflate(iter([gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")]))))
    assert b"".join(inflate(iter([whole[:50], whole[50:] + whole]))) == b"x" * 2000
