import hashlib

from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm.encoder import default_path
from tests.llm.test_exact_dedup import lowered
from tests.llm.test_quality_rules import measured
from tests.llm.test_simhash import classes, slow

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stage = docs.columns, dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash", "mixing", "bpe"]

    def run(name, rows):
        stage[name](spark, rows, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert name == "bpe" or out.columns == columns
        return out

    good = run("quality_rules", docs)
    for r in good.collect():
        n, _, _, _, repeats = measured(r["text"])
        assert n >= 50 and 100 * repeats <= 50 * n
    unique = run("exact_dedup", good)
    best: dict = {}
    for r in good.collect():
        best[lowered(r["text"])] = max(r["doc_id"], best.get(lowered(r["text"]), -1))
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(best.values())
    near = run("simhash", unique)
    rows = sorted(unique.collect(), key=lambda r: r["doc_id"])
    by = classes([slow(r["text"]) for r in rows], 4)
    assert sorted(r["doc_id"] for r in near.collect()) == [rows[i]["doc_id"] for i in sorted(set(by))]
    mix = run("mixing", near)
    assert mix.count()
    tok = Tokenizer.from_file(default_path())
    want = sorted((r["doc_id"], hashlib.sha256(",".join(map(str, tok.encode(r["text"], add_special_tokens=False).ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()) for r in mix.collect())
    assert sorted((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in run("bpe", mix).collect()) == want


def test_whole_run_is_repeatable(spark):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert a and a == b


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
