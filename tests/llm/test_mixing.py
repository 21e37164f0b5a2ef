import random
import re
from collections import Counter, defaultdict

import numpy as np

from sparkloom.llm.mixing import _mix, mix_report, mixed, op6_mixing, permuted, shard_ranges, with_targets

SF = "/root/testdata/sf0.01"


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes, weights, most=3):
    """The contract's words as a loop: shares by weight; who exceeds three times its size stops, and the rest is shared again."""
    left, out, open_ = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        rate = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if rate * weights[i] > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = rate * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in full]
    return out


def test_targets_equal_the_loop(spark):
    rng = random.Random(4)
    cases = [[100, 100, 100], [300, 300, 10], [0, 0], [5, 0, 7], [1], *[[int(10 ** rng.uniform(0, 6)) for _ in range(rng.randrange(1, 40))] for _ in range(8)]]
    for sizes in cases:
        df = spark.createDataFrame([(f"s{i:03d}" if i < len(sizes) - 1 else None, n) for i, n in enumerate(sizes)], "source string, n long")
        got = [r["target"] for r in with_targets(df, (1.0, 2.0, 3.0)).orderBy("rank").collect()]
        assert np.allclose(got, targets(sizes, [1.0 + i % 3 for i in range(len(sizes))]), rtol=1e-9), sizes
    assert with_targets(df.limit(0), (1.0, 2.0, 3.0)).count() == 0


def test_shards_share_out_the_slots():
    whole = shard_ranges(100_000, 37, 5, 1, 0, 100_000)
    assert [x[0] for x in whole] == sorted(x[0] for x in whole) and whole[0][1] == 0 and whole[-1][2] == 100_000
    assert all(a[2] == b[1] for a, b in zip(whole, whole[1:]))
    sizes = [e - f for _, f, e in whole]
    assert len(whole) == 37 and abs(np.std(sizes) - np.sqrt(100_000 / 37)) < 0.5 * np.sqrt(100_000 / 37)
    # a stretch of slots gives the same shards as the whole
    assert shard_ranges(100_000, 37, 5, 1, 5_000, 6_000) == [x for x in whole if x[1] < 6_000 and x[2] > 5_000]
    assert shard_ranges(0, 3, 1, 1, 0, 10) == [] and shard_ranges(10, 1, 1, 1, 0, 10) == [(0, 0, 10)]


def test_report_equals_pack_permute_join_by_hand(spark):
    """Documents laid end to end, slots counted through each epoch's permutation, block by block."""
    rng, block, seed = random.Random(6), 8, 20
    rows = [(i, "w " * rng.choice([0, 1, 3, 20, 90]), rng.choice(["a", "b", None, "c"])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((i, n_words(t)))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, n in by[s]) for s in names]
    goal, want = targets(sizes, [1.0 + i % 3 for i in range(len(names))]), {}
    for rank, (s, n, g) in enumerate(zip(names, sizes, goal, strict=True)):
        blocks = -(-n // block)
        times = Counter()
        for t in range(min(3 * blocks, int(g * blocks / n + 0.5)) if n else 0):
            key = _mix(np.uint64((seed * 1_000_003 + rank * 64 + t // blocks) % 2**64))
            times[int(permuted(np.array([t % blocks]), np.array([blocks]), np.array([key]))[0])] += 1
        at = 0
        for i, size in sorted(by[s]):
            want[i] = (size, n, sum(times[w // block] for w in range(at, at + size)))
            at += size
    got = {r["doc_id"]: (r["size"], r["source_size"], r["taken"]) for r in mix_report(docs, block=block, seed=seed).collect()}
    assert got == want


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "some words of a text " * 60_000, "a"), (2, "b c", "b")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mix_report(df).collect()}
    assert got[1]["size"] == 300_000 and 0 < got[1]["taken"] <= 300_000
    assert sum(n_words(r["text"]) for r in mixed(df).collect()) == sum(r["taken"] for r in got.values())


def test_permutations():
    for size in (1, 2, 3, 5, 64, 1000):
        for key in (1, 99):
            out = permuted(np.arange(size), np.full(size, size), np.full(size, key, np.uint64))
            assert sorted(out.tolist()) == list(range(size))
    assert (permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 1, np.uint64)) != np.arange(1000)).sum() > 900


def test_query_keeps_the_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = op6_mixing(spark, SF).collect()
    size, source, of = {r["doc_id"]: n_words(r["text"]) for r in docs}, {r["doc_id"]: r["source"] for r in docs}, defaultdict(int)
    for i, s in source.items():
        of[s] += size[i]
    names = sorted(of, key=lambda s: (s is None, s))
    goal = dict(zip(names, targets([of[s] for s in names], [1.0 + i % 3 for i in range(len(names))]), strict=True))
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs) and set(got) == set(size)
    taken = defaultdict(int)
    for i, r in got.items():
        assert r["size"] == size[i] and r["source_size"] == of[source[i]] and np.isclose(r["target"], goal[source[i]])
        assert 0 <= r["taken"] <= 3 * size[i]
        taken[source[i]] += r["taken"]
    for s in names:
        assert abs(taken[s] - goal[s]) <= 0.01 * goal[s] + 64
    assert {r["doc_id"]: r["taken"] for r in op6_mixing(spark, SF).collect()} == {i: r["taken"] for i, r in got.items()}


def test_mix_holds_what_the_report_says(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    report = {r["doc_id"]: r["taken"] for r in mix_report(docs).collect()}
    out, words = mixed(docs), defaultdict(int)
    assert out.columns == docs.columns
    whole = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in docs.collect()}
    for r in out.collect():
        own = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        words[r["doc_id"]] += len(own)
        assert r["n_chars"] == len(r["text"]) and own and set(own) <= set(whole[r["doc_id"]])
    assert all(words[i] == n for i, n in report.items())


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "a b c " * 40, "s", 1), (1, "a b c " * 40, "s", 1), (2, None, None, 2), (None, "x y " * 90, None, 3), (4, "", "t", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, start int")
    got = mix_report(df).collect()
    assert len(got) == 5 and sum(r["size"] for r in got) == 420
    assert {r["source_size"] for r in got} == {240, 180, 0} and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert mixed(df).columns == df.columns and mixed(df).count() >= 1
    assert mix_report(df.limit(0)).count() == 0 and mixed(df.limit(0)).count() == 0
