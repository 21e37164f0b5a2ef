import hashlib
import random
import time

import numpy as np
from tokenizers import Tokenizer

from sparkloom.llm.bpe import decode, encode, round_trip
from sparkloom.llm.encoder import Encoder, Node, default_path, joined


def plain():
    return Tokenizer.from_file(default_path())


def test_pieces_encode_as_the_whole():
    tok, own, rng = plain(), Encoder(default_path()), random.Random(1)
    chars = "ab'sTre1  \t\n\r\x0b\x1c\x1f\x85\xa0 　é世😀.,<|endoftext|>"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [" <|endoftext|>  x", "a  <|endoftext|> b", "", " ", "\n\n a"]
    texts += [f"a{chr(c)}{chr(c)}b {chr(c)}!{chr(c)} 1" for c in range(1, 0x3100)]
    texts += [" ".join(rng.choice(["word,", "é.", "don't", "Straße!", "ñ", "x;y", "a.b.", "ﬁ,", "世界。", "naïve", "'s", "ll.", "<|endoftext|>.", "\nline", "\n\n", "\n", "", "ǅ:", "ʰ!"]) for _ in range(12)) for _ in range(3000)]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want


def nodes(own, leaves):
    made, inside = [], False
    for text, opens in leaves:
        ids = own.plain(text)
        made.append(Node(ids, len(ids) * inside, len(ids) * opens))
        inside = opens
    return made


def test_joins_equal_the_whole():
    own, rng = Encoder(default_path()), random.Random(2)
    hard = 0
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "theandingtion", "0123456789", "=-_*#'", "éèà世界", " \n", "aé世ñü", "ab'sll 12 \n\t", "<|endoftext|>", "a\u2003\x1c\x85 b", "aB3+/", "don't we'll  \n"):
        for k in range(80):
            n = rng.randrange(2, 400)
            text = "".join(rng.choice(letters) for _ in range(n))
            if k % 5 == 0:
                text = text[: n // 2] + "<|endoftext|>" + text[n // 2 :] + "  \n x"
            leaves = own.leaves(text, rng.choice([1, 3, 16, 64]))
            assert "".join(t for t, _ in leaves) == text
            hard += sum(x for _, x in leaves)
            assert joined(nodes(own, leaves), own).ids == own.plain(text)
    assert hard > 1000


def long_texts():
    rng = random.Random(3)
    run = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = [run("abcdefghij", rng.randrange(1, 9)) for _ in range(5000)]
    return [" ".join(rng.choice(words) for _ in range(250_000)), run(base64, 200_000), "z" + " " * 100_000 + "z", "\n".join(run(base64, 76) for _ in range(3000)), " ".join(run("abcdef", 8000) for _ in range(10)), run("étéà", 60_000)]


def test_long_texts_in_spark(spark):
    texts = long_texts()
    assert len(texts[0]) > 1_000_000
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tok = plain()
    want = {i: tok.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    got = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in encode(df, ["doc_id"]).collect()}
    assert got == want


def test_long_tokens_take_no_time():
    own, text = Encoder(default_path()), long_texts()[4]
    own.plain("warm")
    began = time.perf_counter()
    own.encode([text])
    joined(nodes(own, own.leaves(text, 16_384)), own)
    assert time.perf_counter() - began < 5


def test_tree_in_spark(spark):
    rng = random.Random(3)
    run = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    texts = [None, "", "plain words only", "x " + run("abc", 500) + " y", run("the", 333) + "<|endoftext|>" + run("01", 250) + "'s", " " * 300 + "z", run("aB3+/é", 900), run("=", 700)]
    texts += [texts[3]]
    df = spark.createDataFrame([(i, t, i, None if i % 2 else "k") for i, t in enumerate(texts)], "doc_id long, text string, ids int, `row` string")
    tok = plain()
    want = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    for fan in (2, 16):
        made = encode(df, ["doc_id", "row"], leaf=32, fan=fan).collect()
        assert {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in made} == want
        assert all(r["row"] == (None if r["doc_id"] % 2 else "k") for r in made)
    back = {r["doc_id"]: r["decoded"] for r in decode(encode(df, ["doc_id"], leaf=32), ["doc_id"]).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_digests_and_empty_table(spark):
    df = spark.createDataFrame([(7, "a b"), (7, "a b"), (None, None)], "doc_id long, text string")
    ids = plain().encode("a b", add_special_tokens=False).ids
    rows = sorted(round_trip(df).collect(), key=lambda r: r["n_tokens"])
    assert [r["n_tokens"] for r in rows] == [0, len(ids), len(ids)]
    assert rows[1]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert rows[0]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert round_trip(df.limit(0)).count() == 0
