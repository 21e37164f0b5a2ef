import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkloom.llm._shared import workplace
from sparkloom.llm.encoder import _RUN, Encoder, _runs, default_path
from sparkloom.llm.records import crc32c, frame, masked, read_records, unframe, write_records


def slow(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksum():
    assert crc32c(b"123456789") == 0xE3069283
    rng = np.random.default_rng(1)
    for n in [*range(12), 511, 512, 513, 1024, 3001]:
        data = rng.integers(0, 256, n, np.uint8).tobytes()
        assert crc32c(data) == slow(data)
    assert masked(b"") == 0xA282EAD8


def test_frame_finds_damage():
    data = frame(b"abc") + frame(b"")
    first, at = unframe(data)
    assert (first, unframe(data, at)) == (b"abc", (b"", len(data)))
    for i in range(at):
        with pytest.raises(ValueError):
            unframe(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])


def test_records_equal_brute_force(spark):
    texts = ["b c", None, "", "The the and", "word é " * 180_000 + "x" * 20_000, "The the and", "é世 <|endoftext|>"]
    rows = [(5 - i if i != 3 else None, t, i) for i, t in enumerate(texts)] + [(5, "b c", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    tok = Tokenizer.from_file(default_path())
    want, start = [], 0
    for doc_id, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    got = read_records(write_records(df, workplace(spark, "t")), with_ids=True).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert read_records(write_records(df.limit(0), workplace(spark, "t"))).count() == 0


def test_equal_ids_fill_no_single_file(spark):
    df = spark.range(20_000).selectExpr("CAST(IF(id % 3 = 0, NULL, IF(id % 3 = 1, 7, id)) AS LONG) AS doc_id", "concat('t ', id % 50) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = write_records(df.repartition(4), workplace(spark, "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["n_docs"] for r in manifest.collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 10_000
    got = read_records(manifest).orderBy("start").collect()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids) and [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(0, 200)] + [r["start"] for r in got[200:]]


def test_letters_with_signs_or_line_ends_take_no_whole_call():
    """New segments of letters, signs after them or a line end before them go to the model directly; signs alone are encoded once."""
    own = Encoder(default_path())
    asked, whole = [], own.plain
    own.plain = lambda text: asked.append(text) or whole(text)
    texts = ["Ein Wort### zwei$$$ drei, vier... \u00e9t\u00e9) f\u00fcnf,", "sechs\nsieben\nacht### neun% zehn,"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [whole(t) for t in texts]
    assert sorted(asked) == sorted(["###", "$$$", ",", "...", ")", "%", "\n"])


def test_encoding_of_odd_texts_is_the_library_s():
    rng = np.random.default_rng(5)
    parts = [*"a\u00e9\u00df\u4e16\u0418 \n\t\r\x85\x1c\u00a0\u2009\u3000'\u2019_-~`1\u01c5\u00aa\u00b5\u0301", " ", " ", "Word", "word", "###", "...", ",", "'s", "<|endoftext|>", "<|", "|>"]
    own = Encoder(default_path())
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(20_000)]
    assert [x.tolist() for x in map(lambda b: np.frombuffer(b, "<u4"), own.encode(texts))] == [own.plain(t) for t in texts]
    assert all(_runs(t) == bool(_RUN.search(t)) for t in texts)
