"""Operator 5: quality scores by Bradley-Terry pairwise ranking.

P(document i is better than j) = sigmoid(w . (x_i - x_j)): the weights are fitted by logistic loss on
the differences of features within preference pairs, one side labelled 1, the other 0. Every pair of
labelled documents counts, and no pair is formed: what all the documents of the other label do to one
is a smooth function of its rating, so the sums over pairs follow from moments of the ratings by bins,
a Taylor series of eight terms. A pass over the labelled rows gives the moments, a second one the
gradient and a Newton matrix; neither rows nor all ratings come to the driver.

A document's rating is w . x; the threshold is a quantile of the ratings of all labelled rows: a given
one, or the one of a thousand that parts the labels best.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._shared import numbered, written

#: Width of a bin of ratings, and terms of the series by which pairs of bins are summed.
WIDTH, TERMS = 0.125, 8
#: Weight of the penalty, and the fall of the loss below which no further step is worth a pass.
L2, GAIN = 1e-3, 1e-13
#: The score at the threshold, and the quantiles among which that is sought.
CUT, QUANTILES = 0.3, 1000

_UPPER, _LOWER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True


def features(text: str) -> list[float]:
    """Shape of a text, whole: shares of kinds of characters, lengths, and what repeats. No feature depends on what language the words are of."""
    raw = text.encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, n_words, n_lines = max(1, len(raw)), max(1, len(words)), max(1, len(lines))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    symbols = int(counts[[ord(c) for c in "#*$%&|<>{}[]=_^~\\@"]].sum())
    letters = int(counts[_UPPER].sum() + counts[_LOWER].sum() + counts[128:].sum())
    triples = Counter(zip(words, words[1:], words[2:]))
    twice = sum(c for c in triples.values() if c > 1)
    top = max(Counter(words).values(), default=0)
    shares = [
        symbols / n_words, counts[_UPPER].sum() / max(1, letters), counts[_DIGIT].sum() / n, letters / n,
        counts[[33, 63]].sum() / n_words, counts[[46, 44]].sum() / n_words, counts[124] / n_words, counts[34] / n_words,
        1 - len(set(lines)) / n_lines, twice / n_words, len(set(words)) / n_words, top / n_words,
        n_lines / n_words, sum(x.rstrip().endswith((b".", b"!", b"?", b"\"")) for x in lines) / n_lines,
        counts[[58, 59]].sum() / n_words, counts[[45, 47]].sum() / n_words, counts[[40, 41]].sum() / n_words,
    ]
    size = [min(np.log1p(len(words)), 12.0), max(0.0, np.log(51) - np.log1p(len(words))), len(raw) / n_words / 10, float(not words)]
    return [float(x) for x in (*shares, *[np.log1p(50 * float(x)) for x in shares], *size)]


N_FEATURES = len(features(""))


@dataclass(frozen=True)
class Ranking:
    """A fitted ranking; plain arrays, so that it travels with a task."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    quantile: float

    def rating(self, x: np.ndarray) -> np.ndarray:
        # summed row by row: a row's rating does not depend on the rows around it
        return (_normed(x, self.mean, self.scale) * self.weights).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, and CUT at the threshold."""
        z = self.rating(x) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _normed(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


#: Blocks of labelled rows: features, and how often each row is labelled 1 and 0.
Blocks = Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _spread(blocks: Blocks) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Labels 1 and 0, the mean of the features, and the sum of their squared distances from it."""
    made = []
    for x, good, bad in blocks:
        n = good + bad
        mean = n @ x / max(1.0, n.sum())
        made.append((good.sum(), bad.sum(), mean, n @ (x - mean) ** 2))
    return _pooled(made)


def _pooled(parts: list[tuple]) -> tuple[float, float, np.ndarray, np.ndarray]:
    good, bad, mean, squares = 0.0, 0.0, np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    for g, b, m, q in parts:
        n, own = good + bad, g + b
        if own:
            squares = squares + q + (m - mean) ** 2 * (n * own / (n + own))
            mean = mean + (m - mean) * (own / (n + own))
            good, bad = good + g, bad + b
    return good, bad, mean, squares


def _placed(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each rating, and its distance from the bin's middle."""
    at = np.floor(r / WIDTH).astype(np.int64)
    return at, r - (at + 0.5) * WIDTH


def _binned(blocks: Blocks, model: Ranking) -> tuple[int, np.ndarray]:
    """The first bin, and for label 0 and 1, by bin: moments of the distances from its middle, and sums of the normed features."""
    made = []
    for x, good, bad in blocks:
        if not len(x):
            continue
        z = _normed(x, model.mean, model.scale)
        at, v = _placed(model.rating(x))
        first = int(at.min())
        cols = [*(v**k for k in range(TERMS)), *z.T]
        made.append((first, np.array([[np.bincount(at - first, weights=c * n) for c in cols] for n in (bad, good)]).transpose(0, 2, 1)))
        made = [_laid(made)]
    return _laid(made)


def _laid(parts: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    """Arrays (first bin, [label, bin, column]) added up as one."""
    parts = [p for p in parts if p[1].shape[1]]
    if not parts:
        return 0, np.zeros((2, 0, TERMS + N_FEATURES))
    first, end = min(at for at, _ in parts), max(at + x.shape[1] for at, x in parts)
    out = np.zeros((2, end - first, TERMS + N_FEATURES))
    for at, x in parts:
        out[:, at - first : at - first + x.shape[1]] += x
    return first, out


def _pulled(blocks: Blocks, model: Ranking, first: int, series: list[np.ndarray], bent: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums over rows of label 0 and 1: how the loss pulls at the weights, and the rows' own part of the Newton matrix."""
    pull, own = np.zeros(N_FEATURES), np.zeros((N_FEATURES, N_FEATURES))
    for x, good, bad in blocks:
        z = _normed(x, model.mean, model.scale)
        at, v = _placed(model.rating(x))
        at -= first
        for n, s, c, sign in zip((bad, good), series, bent, (1, -1), strict=True):
            value = np.zeros(len(v))
            for k in reversed(range(TERMS)):
                value = value * v + s[at, k]
            pull += sign * (n * value) @ z
            own += (z * (n * c[at])[:, None]).T @ z
    return pull, own


def _kernels(bins: int) -> np.ndarray:
    """log(1 + exp(d)) and its first TERMS derivatives, at the distances d between the middles of `bins` bins."""
    d = np.arange(1 - bins, bins) * WIDTH
    s = 1 / (1 + np.exp(np.abs(d)))  # at -|d|, where the derivatives lose no digits
    out = [np.logaddexp(0, d), np.where(d > 0, 1 - s, s)]
    p = np.polynomial.Polynomial([0, 1])
    for k in range(1, TERMS):
        p = p.deriv() * np.polynomial.Polynomial([0, 1, -1])
        out.append(np.where(d > 0, (-1) ** (k + 1), 1) * p(s))
    return np.array(out)


def _series(kernels: np.ndarray, moments: np.ndarray, label: int) -> np.ndarray:
    """By bin, the coefficients in v of the sum of f(r of label 0 - r of label 1) over all rows of the other label, for a row of this one at v from the bin's middle."""
    out = np.zeros((len(moments), TERMS))
    for own in range(TERMS):
        for other in range(TERMS - own):
            f, power = kernels[own + other], own if label else other
            out[:, own] += (-1) ** power / math.factorial(own) / math.factorial(other) * np.convolve(moments[:, other], f[::-1] if label else f, "valid")
    return out


def _weights(passes: Callable, l2: float) -> tuple[Ranking, float, float]:
    """The ranking without its threshold, and how many labels are 1 and 0. `passes(f, *args)` gives f(blocks, *args) of every part of the labelled rows.

    Newton's method: weights at which the loss over all pairs, penalty included, is least. A step is
    halved until the loss falls enough; when none falls, numbers have no further digits to give.
    """
    n_good, n_bad, mean, squares = _pooled(passes(_spread))
    n, pairs = n_good + n_bad, n_good * n_bad
    model = Ranking(mean, np.sqrt(squares / n) + 1e-6 if n else np.ones(N_FEATURES), np.zeros(N_FEATURES), -1e-9, 0.0)
    if not pairs:
        return model, n_good, n_bad

    def state(w: np.ndarray):
        tried = Ranking(mean, model.scale, w, 0.0, 0.0)
        first, sums = _laid(passes(_binned, tried))
        kernels = _kernels(sums.shape[1])
        loss = (_series(kernels, sums[0, :, :TERMS], 1) * sums[1, :, :TERMS]).sum() / pairs + l2 / 2 * w @ w
        return loss, tried, first, sums, kernels

    loss, model, first, sums, kernels = state(model.weights)
    while True:
        series = [_series(kernels[1:], sums[1 - label, :, :TERMS], label) for label in (0, 1)]
        # the matrix takes each row at its bin's middle: that of a sum of squares still, and near enough for steps
        over = lambda m: np.array([np.convolve(c, kernels[2], "valid") for c in m.T]).T  # noqa: E731, B023
        bent = [over(sums[1 - label, :, :1])[:, 0] for label in (0, 1)]
        pulls, owns = zip(*passes(_pulled, model, first, series, bent), strict=True)
        slope = sum(pulls) / pairs + l2 * model.weights
        cross = sums[1, :, TERMS:].T @ over(sums[0, :, TERMS:])
        step = -np.linalg.solve((sum(owns) - cross - cross.T) / pairs + l2 * np.eye(N_FEATURES), slope)
        fall = -slope @ step
        # no point below the first one's loss lies further out than this
        share = min(1.0, np.sqrt(2 * np.log(2) / l2) / max(1e-300, np.linalg.norm(step)))
        while fall * share >= GAIN:
            found = state(model.weights + share * step)
            if found[0] <= loss - 0.1 * share * fall:
                break
            share /= 2
        else:
            return model, n_good, n_bad
        loss, model, first, sums, kernels = found


def _best(good_below: np.ndarray, bad_below: np.ndarray, n_bad: float) -> int:
    """The cut, of those in ascending order, that parts the labels best: a good document lost counts as two bad ones let through; of equally good cuts the middle one."""
    cost = 2 * good_below + n_bad - bad_below
    best = np.flatnonzero(cost == cost.min())
    return int(best[len(best) // 2])


def _shares(quantile: float | None) -> np.ndarray:
    return np.linspace(0, 1, QUANTILES + 1) if quantile is None else np.array([quantile])


def fit(x: np.ndarray, y: np.ndarray, l2: float = L2, quantile: float | None = None) -> Ranking:
    """The ranking by all pairs of rows labelled 1 and 0; with one label only, all weights are zero and every score passes."""
    good, bad = (y == 1).astype(float), (y == 0).astype(float)
    model, n_good, n_bad = _weights(lambda f, *args: [f([(x, good, bad)], *args)], l2)
    if not n_good or not n_bad:
        return model
    r, shares = model.rating(x), _shares(quantile)
    cuts = np.quantile(r, shares)
    k = _best(*[np.searchsorted(np.sort(r[y == label]), cuts) for label in (1, 0)], n_bad) if quantile is None else 0
    return Ranking(model.mean, model.scale, model.weights, float(cuts[k]), float(shares[k]))


def _passes(rows: DataFrame) -> Callable:
    """What _weights asks of the labelled rows, a part per task; the parts come in the order of the tasks."""

    def passes(f, *args):
        def run(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            blocks = ((_matrix(b.column(0)), *[b.column(k).to_numpy().astype(np.float64) for k in (1, 2)]) for b in batches if b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(f(blocks, *args))], pa.binary())], names=["part", "made"])

        return [pickle.loads(r["made"]) for r in sorted(rows.select("features", "good", "bad").mapInArrow(run, "part int, made binary").collect(), key=lambda r: r["part"])]

    return passes


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), N_FEATURES)


def fit_rows(rows: DataFrame, l2: float = L2, quantile: float | None = None) -> Ranking:
    """As fit(), over a written table of labelled rows: features, and how often each is labelled 1 (`good`) and 0 (`bad`).

    What reaches the driver: per task sums by bins of ratings, then ratings at the quantiles, and counts by cut.
    """
    model, n_good, n_bad = _weights(_passes(rows), l2)
    if not n_good or not n_bad:
        return model

    def rate(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.rating(_matrix(batch.column(0)))), batch.column(1), batch.column(2)], names=["rating", "good", "bad"])

    rated = rows.select("features", "good", "bad").mapInArrow(rate, "rating double, good long, bad long")
    rated = rated.groupBy("rating").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    ordered = written(numbered(rated.select(F.lit(0).alias("of"), "rating", "good", "bad", (F.col("good") + F.col("bad")).alias("n")), "of", ["rating"], "n", "before"), "ratings")
    shares = _shares(quantile)
    place = shares * (n_good + n_bad - 1)
    low = np.floor(place).astype(np.int64)
    high = np.minimum(low + 1, int(n_good + n_bad) - 1)
    ranks = np.unique(np.concatenate([low, high]))

    def pick(batches):
        import pyarrow as pa

        for batch in batches:
            before, n = (batch.column(k).to_numpy() for k in (1, 2))
            yield batch.filter(pa.array(np.searchsorted(ranks, before + n) > np.searchsorted(ranks, before)))

    found = ordered.select("rating", "before", "n").mapInArrow(pick, "rating double, before long, n long").orderBy("before").collect()
    ratings, before = np.array([r["rating"] for r in found]), np.array([r["before"] for r in found])
    a, b = (ratings[np.searchsorted(before, k, side="right") - 1] for k in (low, high))
    cuts, k = a + (b - a) * (place - low), 0

    def count(batches):
        import pyarrow as pa

        sums = np.zeros((2, len(cuts) + 1), np.int64)
        for batch in batches:
            at = np.searchsorted(cuts, batch.column(0).to_numpy(), side="right")
            for label in (0, 1):
                np.add.at(sums[label], at, batch.column(1 + label).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts) + 1)), pa.array(sums[0]), pa.array(sums[1])], names=["cut", "good", "bad"])

    if quantile is None:
        # by the number of cuts at or below it, a rating lies below all later ones
        counts = ordered.select("rating", "good", "bad").mapInArrow(count, "cut long, good long, bad long").groupBy("cut").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        by = {r["cut"]: r for r in counts.collect()}
        k = _best(*[np.cumsum([by[c][label] for c in range(len(cuts))]) for label in ("good", "bad")], n_bad)
    return Ranking(model.mean, model.scale, model.weights, float(cuts[k]), float(shares[k]))


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and `features` of every row's whole text (null: empty)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [features(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float32()))], names=["doc_id", "features"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, features array<float>")


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 5, is 0; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def rank(df: DataFrame, labels: DataFrame, text: str = "text", labelled: int | None = None, quantile: float | None = None) -> tuple[DataFrame, Ranking]:
    """Scored rows (doc_id, held_out, score, predicted) and the ranking behind them.

    The fit sees every row that has a label 0 or 1 and is not held out, once for each such label; only
    if asked for, at most `labelled` of them, picked by a hash of their id. With `quantile` the
    threshold is that quantile of their ratings. Null texts count as empty; repeated rows get equal
    scores; an empty table gives an empty one; texts of any length are read whole.
    """
    found = written(with_features(df, text), "features")
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("long").alias("quality"))
    if labelled is not None:
        known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(labelled)
    marks = known.groupBy("doc_id").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    rows = found.join(marks, "doc_id")
    if labelled is not None:
        rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(labelled)
    model = fit_rows(written(rows.select("features", "good", "bad"), "labelled"), quantile=quantile)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values, ids = _matrix(batch.column(1)), batch.column(0)
            out = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0 for i in ids.to_pylist()], bool)
            score = model.score(values)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return found.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int"), model


def op5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))[0]
