import zlib

import numpy as np

from sparkloom.llm.ranking import CUT, N_FEATURES, features, fit, rank

SF = "/root/testdata/sf0.01"


def test_fit_recovers_an_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, N_FEATURES))
    y = (x[:, 0] - 2 * x[:, 1] > 0).astype(int)
    model = fit(x, y)
    assert np.mean((model.score(x) >= CUT) == (y == 1)) > 0.97
    assert np.array_equal(model.weights, fit(x, y).weights)
    assert (fit(x, np.ones(600)).score(x) >= CUT).all()
    assert (fit(x[:0], y[:0]).score(x) >= CUT).all()


def test_features_are_finite_and_of_whole_texts():
    for t in ("", " \n", "a", "x " * 50_000, "é世", "A!! B!!\n" * 9):
        assert np.isfinite(features(t)).all() and len(features(t)) == N_FEATURES
    assert features("word " * 3000) != features("word " * 3000 + "#$ " * 100)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored, _ = rank(docs, labels)
    rows = {r["doc_id"]: r for r in scored.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= CUT) for i, r in rows.items())
    tested = [(rows[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in tested]) > 0.95


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2)], "doc_id long, text string, features int")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = rank(docs, labels)[0].collect()
    assert len(got) == 3 and all(0 <= r["score"] <= 1 and r["predicted"] == 1 for r in got)
    assert rank(docs.limit(0), labels.limit(0))[0].count() == 0


def test_scores_equal_brute_force(spark):
    """Features, pair loss and threshold by plain loops over every document, from the labels that may be seen."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored, model = rank(docs, labels)
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    seen = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    x = {i: np.float32(features(t)).astype(float) for i, t in text.items()}
    z = {i: np.clip((v - model.mean) / model.scale, -8, 8) for i, v in x.items()}
    every = np.array([x[i] for i in seen])
    assert np.allclose(model.mean, every.mean(axis=0)) and np.allclose(model.scale, every.std(axis=0) + 1e-6)
    # the loss over all pairs, not the drawn ones: near its minimum in every direction, far below that of no weights
    good, bad = np.array([z[i] for i, q in seen.items() if q == 1]), np.array([z[i] for i, q in seen.items() if q == 0])
    loss = lambda w: np.mean(np.log1p(np.exp(-np.clip((good @ w)[:, None] - (bad @ w)[None, :], -30, 30)))) + 5e-4 * w @ w
    least = loss(model.weights)
    assert least < 0.2 * loss(0 * model.weights)
    assert all(loss(model.weights + d * np.eye(N_FEATURES)[k]) > least - 2e-3 for k in range(N_FEATURES) for d in (-0.05, 0.05))
    ratings = [float(sum(a * b for a, b in zip(z[i], model.weights))) for i in seen]
    assert np.isclose(model.threshold, np.quantile(ratings, model.quantile))
    for r in scored.collect():
        rating = float(sum(a * b for a, b in zip(z[r["doc_id"]], model.weights)))
        assert np.isclose(r["score"], 1 / (1 + np.exp(-(rating - model.threshold + np.log(CUT / (1 - CUT))))), atol=1e-9)


def test_threshold_is_the_quantile_asked_for(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored, model = rank(docs, labels, quantile=0.75)
    seen = {r["doc_id"] for r in labels.where("quality IN (0, 1)").collect()}
    share = np.mean([r["predicted"] for r in scored.collect() if r["doc_id"] in seen and not r["held_out"]])
    assert model.quantile == 0.75 and abs(share - 0.25) < 0.02


def test_repeated_ids_do_not_pass_the_bound(spark):
    docs = spark.range(2000).selectExpr("1 AS doc_id", "concat('text ', id) AS text").unionAll(spark.createDataFrame([(2, "x")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    scored, model = rank(docs, labels, labelled=10)
    assert scored.count() == 2001


def test_fit_is_least_over_all_pairs():
    """The slope of the loss over every pair, by plain loops, is nothing at the fitted weights."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, N_FEATURES))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=900) > 0.5).astype(int)
    model = fit(x, y)
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    good, bad = z[y == 1], z[y == 0]
    pull = 1 / (1 + np.exp((good @ model.weights)[None, :] - (bad @ model.weights)[:, None]))
    slope = sum(p @ (b - good) for p, b in zip(pull, bad)) / pull.size + 1e-3 * model.weights
    assert np.abs(slope).max() < 1e-6


def test_fit_sees_every_labelled_row(spark):
    """More labelled rows than any sample was allowed, ids and labels repeated: the same as the fit of arrays that hold each row once per label."""
    docs = spark.range(30_000).selectExpr("id - id % 7 % 2 AS doc_id", "concat(repeat(concat('word', id % 13, IF(id % 3 = 0, '. ', ' # ')), CAST(1 + id % 11 AS INT)), IF(id < 300, 'A B! C', 'x')) AS text")
    labels = spark.range(30_100).selectExpr("id AS doc_id", "CAST(id % 3 = 0 OR id % 17 = 1 AS INT) AS quality")
    labels = labels.unionAll(labels.where("doc_id % 50 = 0")).unionAll(spark.createDataFrame([(4, 1), (4, 0), (4, None), (None, 1)], "doc_id long, quality int"))
    scored, model = rank(docs, labels)
    text: dict = {}
    for r in docs.collect():
        text.setdefault(r["doc_id"], []).append(np.float32(features(r["text"])).astype(float))
    seen = [(v, r["quality"]) for r in labels.collect() if r["quality"] in (0, 1) and r["doc_id"] in text and zlib.crc32(str(r["doc_id"]).encode()) % 5 for v in text[r["doc_id"]]]
    x, y = np.array([v for v, _ in seen]), np.array([q for _, q in seen])
    assert len(x) > 20_000
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0) + 1e-6)
    want = fit(x, y)
    assert np.allclose(model.weights, want.weights, atol=1e-5) and model.quantile == want.quantile
    assert np.isclose(model.threshold, np.quantile(model.rating(x), model.quantile), atol=1e-9)
    assert scored.count() == 30_000
