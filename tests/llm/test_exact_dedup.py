import hashlib

import pytest

from sparkloom.llm.exact_dedup import drop_copies, exact_classes


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


TEXTS = ["Ab", "aB", "ab ", None, "", "É", "é", "x" * 40, "x" * 39 + "X", "x" * 41, "y" * 16 + "z" * 16, "z" * 16 + "y" * 16, "y" * 16 + "z" * 17, "ab"]


@pytest.mark.parametrize("bits", [64, 2])
def test_equals_brute_force(spark, bits):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, ""), (None, "ab"), (13, "AB"), (None, "zz"), (None, "zz")]
    got = exact_classes(spark.createDataFrame(rows, "doc_id long, text string"), size=8, bits=bits).collect()
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    want = []
    for i, t in rows:
        ids = groups[lowered(t)]
        best = max([x for x in ids if x is not None], default=None)
        want.append((i, best, len(ids), hashlib.sha256(lowered(t).encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=key) == sorted(want, key=key)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_rows_that_stay(spark):
    rows = [(1, "a", "k"), (2, "A", "l"), (2, "A", "m"), (None, "b", None), (None, "b", None), (4, "c", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid string")
    got = drop_copies(df)
    assert got.columns == df.columns
    assert sorted((r["text"].lower(), r["doc_id"]) for r in got.collect()) == [("a", 2), ("b", None), ("c", 4)]
    assert exact_classes(df.limit(0)).count() == 0 and drop_copies(df.limit(0)).count() == 0
