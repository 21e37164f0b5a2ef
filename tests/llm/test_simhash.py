import random

import numpy as np
import pytest
import xxhash

from sparkloom.llm.simhash import _dealt, _join_labels, components, drop_near, fingerprint, fingerprints, links, meet, near_classes, op9_simhash

SF = "/root/testdata/sf0.001"


def slow(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, radius):
    """Smallest index reachable over steps of at most `radius` bits."""
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_equal_brute_force():
    rng = random.Random(1)
    for t in ["", " \t\n", "A", "a b c", "a b c d", "É é a\x1cb\x85c", "x y " * 5000, " ".join(f"word{i % 977}" for i in range(150_000)), *[" ".join(rng.choice("abcDEé") for _ in range(rng.randrange(40))) for _ in range(200)]]:
        assert fingerprint(t.encode()) == slow(t), t


def near_set(rng, n):
    """Fingerprints with pairs at every distance from 0 to 7, and chains."""
    out = [0, 0xFFFFFFFFFFFFFFFF]
    while len(out) < n:
        x = rng.choice(out) if rng.random() < 0.7 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randrange(8)):
            x ^= 1 << b
        out.append(x)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("piece", [2_000_000, 300])
def test_meeting_equals_all_pairs(piece):
    rng = random.Random(piece)
    for _ in range(3):
        fps = near_set(rng, 50)
        u, v = meet(np.array(fps, np.uint64), np.full(len(fps), 2), 64, 4, piece)
        assert all(bin(fps[a] ^ fps[b]).count("1") <= 4 for a, b in zip(u, v, strict=True))
        by = classes(fps, 4)
        assert len(u) == len(fps) - len(set(by))
        assert [int(x) for x in _join_labels(np.arange(len(fps)), u, v)] == by


@pytest.mark.parametrize(("piece", "most"), [(2_000_000, 200_000), (5_000, 200_000), (2_000_000, 60)])
def test_links_and_components_equal_all_pairs(spark, piece, most):
    fps = near_set(random.Random(7), 250)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    pairs = links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, piece, most)
    assert pairs.where("bit_count(u ^ v) > 4").isEmpty()
    got = dict(components(pairs).collect())
    by = classes(fps, 4)
    roots: dict = {}
    for x, c in zip(signed, by, strict=True):
        roots.setdefault(c, []).append(x)
    want = {x: min(g) for g in roots.values() for x in g if x != min(g)}
    assert got == want


def test_hot_prefixes_are_split_again_and_again(spark):
    """Fingerprints that share their first 40 bits: no group keeps more than the bound before all bits are used."""
    rng = random.Random(8)
    fps = {0xABCDEF0123 << 24 | rng.getrandbits(24) for _ in range(3000)}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    sizes = _dealt(df, len(fps), 2, 2_000_000, 500).groupBy("depth", "prefix").count().collect()
    assert max(r["count"] for r in sizes) <= 500 and max(r["depth"] for r in sizes) > 40


def test_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 300)}


def test_query_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids, fps = [r["doc_id"] for r in docs], [slow(r["text"]) for r in docs]
    by, least = classes(fps, 4), {}
    for i, c in zip(ids, by, strict=True):
        least[c] = min(i, least.get(c, i))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op9_simhash(spark, SF).collect()}
    assert got == {i: (f"{f:016x}", least[c]) for i, f, c in zip(ids, fps, by, strict=True)}


def test_nulls_repeats_and_empty(spark):
    rows = [(3, None, 1), (2, "", 1), (None, " ", 1), (7, "one two three four five", 2), (7, "one two three four five", 2), (None, "other words are here now then", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root int")
    got = near_classes(df).collect()
    assert len(got) == 6
    assert {r["component_id"] for r in got if r["fp"] == 0} == {2} and {r["component_id"] for r in got} == {2, 7, None}
    kept = drop_near(df)
    assert kept.columns == df.columns
    assert sorted(str((r["doc_id"], r["root"])) for r in kept.collect()) == sorted(["(2, 1)", "(7, 2)", "(None, 3)"])
    assert near_classes(df.limit(0)).count() == 0 and drop_near(df.limit(0)).count() == 0 and fingerprints(df.limit(0)).count() == 0
