"""Quality classifier: ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import spare

#: Buckets that words are hashed to.
BUCKETS = 1 << 18
#: Labelled documents that the model is fitted on at most: those with the smallest seeded hash of their id.
MOST_LABELLED = 8000
_REMEMBERED = 200_000


class _Hasher:
    """Bucket counts of a whole text. A word gives its letters in lower case, and marks for the signs
    that cling to it, for capitals only, and for being the same as the word before."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, word: str) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            core = "".join(c for c in word if c.isalnum())
            signs = "".join(c for c in word if not c.isalnum())
            parts = ([f"w {core.lower()}"] if core else []) + ([f"s {signs}"] if signs else []) + (["caps"] if len(core) > 1 and core.isupper() else [])
            got = tuple(zlib.crc32(p.encode()) % BUCKETS for p in parts)
            if len(word) < 64:
                self.known[word] = got
        return got

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        total: Counter[int] = Counter()
        for word, n in Counter(words).items():
            for k in self.of(word):
                total[k] += n
        again = sum(map(str.__eq__, words, words[1:]))
        if again:
            total[zlib.crc32(b"again") % BUCKETS] += again
        k = np.fromiter(total.keys(), np.int32, len(total))
        return k, 1 + np.log(np.fromiter(total.values(), np.float64, len(total)))


@dataclass
class OrdinalModel:
    """P(grade <= k) = 1 / (1 + exp(weights . x - thresholds[k])): one weight vector for all grades and
    thresholds in ascending order; grades are 0 to len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k below the highest grade."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def _minimise(f, x: np.ndarray, rounds: int = 80, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with halved steps; f gives the value and the gradient."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for s, y in reversed(past):
            alphas.append(a := (s @ q) / (s @ y))
            q -= a * y
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.abs(grad).max())
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        step, slope = 1.0, -(grad @ q)
        while step > 1e-8:
            new_value, new_grad = f(x - step * q)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, new_grad - grad
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        x, done, value, grad = x + s, value - new_value < 1e-7 * abs(value), new_value, new_grad
        if done:
            break
    return x


def ordinal_loss(row: np.ndarray, flat: np.ndarray, values: np.ndarray, grades: np.ndarray, n_used: int, n_grades: int, decay: float):
    """The penalised mean negative log-likelihood and its gradient, as a function of the weights of n_used
    features, the first threshold, and the logarithms of the gaps between thresholds."""
    n, cuts = max(1, len(grades)), n_grades - 1
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, gaps = x[:n_used], np.exp(np.clip(x[n_used + 1 :], -30, 30))
        cut = x[n_used] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(row, w[flat] * values, len(grades))
        edge = np.concatenate([[-np.inf], cut, [np.inf]])
        hi, lo = edge[grades + 1] - score, edge[grades] - score
        up, down = np.where(np.isinf(hi), 1.0, sigmoid(hi)), np.where(np.isinf(lo), 0.0, sigmoid(lo))
        p = np.maximum(up - down, 1e-12)
        d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
        g_w = np.bincount(flat, ((d_up - d_down)[row]) * values, n_used) / n + decay * w
        g_cut = (np.bincount(grades, -d_up, n_grades)[:cuts] + np.bincount(grades, d_down, n_grades)[1:]) / n
        g_gaps = np.cumsum(g_cut[::-1])[::-1][1:] * gaps
        return -np.log(p).sum() / n + decay / 2 * (w @ w), np.concatenate([g_w, [g_cut.sum()], g_gaps])

    return loss


def fit_ordinal(sizes: np.ndarray, flat: np.ndarray, values: np.ndarray, grades: np.ndarray, n_grades: int, decay: float = 0.001, least: int | None = None) -> OrdinalModel:
    """Fits the model to documents of `sizes` buckets each; flat and values hold all of their buckets
    and values in turn. Buckets in fewer than `least` documents (one in 400, 3 at least) have weight 0.
    Every grade counts one document more than it has at the start, so that an absent one is allowed."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    least = max(3, len(sizes) // 400) if least is None else least
    used = np.flatnonzero(np.bincount(flat, minlength=BUCKETS) >= least)
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    keep = place[flat] >= 0
    share = np.cumsum(np.bincount(grades, minlength=n_grades) + 1.0)[:-1] / (len(grades) + n_grades)
    theta = np.log(share / (1 - share))
    start = np.concatenate([np.zeros(len(used)), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    x = _minimise(ordinal_loss(row[keep], place[flat[keep]], values[keep], grades, len(used), n_grades, decay), start)
    weights = np.zeros(BUCKETS)
    weights[used] = x[: len(used)]
    cut = x[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(x[len(used) + 1 :], -30, 30)))])
    return OrdinalModel(weights, cut)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, grade: str, most: int, seed: int) -> DataFrame:
    """(grade, buckets, values) of at most `most` labelled documents: ids by their seeded hash, the
    least grade of an id that has several. Those ids are broadcast, `most` rows at most; whole texts
    are hashed where they lie."""
    ids = labels.where(F.col(grade).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(grade).cast("int").alias("_grade"))
    present = ids.join(docs.select(F.col(id_col).alias("_id")).where("_id is not null").distinct(), "_id", "left_semi")
    ids = present.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(most)

    @F.pandas_udf("buckets array<int>, values array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hasher = _Hasher()
        for texts in batches:
            rows = [hasher.counts(t) for t in texts]
            yield pd.DataFrame({"buckets": pd.Series([k for k, _ in rows], dtype=object), "values": pd.Series([v for _, v in rows], dtype=object)})

    got = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(ids), "_id")
    # one row for each id: of several texts the one with the smallest hash
    got = got.select("_id", F.xxhash64("_text").alias("h"), F.col("_grade").alias("grade"), of("_text").alias("x"))
    got = got.groupBy("_id").agg(F.min_by(F.struct("grade", "x"), "h").alias("s"))
    return got.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(most).select("s.grade", "s.x.buckets", "s.x.values")


def fit(docs: DataFrame, labels: DataFrame, n_grades: int, id_col: str = "doc_id", text: str = "text", grade: str = "grade", most: int = MOST_LABELLED, seed: int = 5, decay: float = 0.001) -> OrdinalModel | None:
    """The model for labels(id_col, grade), grades 0 to n_grades - 1; None if no labelled document is
    there. The driver gets the bucket counts of `most` documents at most."""
    sample = labelled_sample(docs, labels, id_col, text, grade, most, seed).toArrow().combine_chunks()
    if not sample.num_rows:
        return None
    grades = np.clip(sample.column("grade").to_numpy(), 0, n_grades - 1).astype(np.int64)
    sizes = sample.column("buckets").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    flat, values = (sample.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("buckets", "values"))
    return fit_ordinal(sizes, flat, values, grades, n_grades, decay)


def grade_documents(docs: DataFrame, model: OrdinalModel | None, text: str = "text", tail: int = 2, least: float = 0.7) -> DataFrame:
    """docs with expected_grade, tail_probability = P(grade >= tail) and kept = tail_probability >= least.

    Each row is judged by its whole text alone; a null text is an empty one. Without a model the two
    numbers are null and everything is kept. Columns of these names are replaced.
    """
    if model is None:
        null = F.lit(None).cast("double")
        return docs.withColumns({"expected_grade": null, "tail_probability": null, "kept": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, tail_probability double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hasher, m = _Hasher(), shared.value
        for texts in batches:
            score = np.zeros(len(texts))
            for i, t in enumerate(texts):
                k, v = hasher.counts(t)
                score[i] = m.weights[k] @ v
            tails = m.tails(score)
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "tail_probability": tails[:, tail - 1]})

    g = spare(docs, "_grades")
    got = docs.withColumn(g, of(F.col(text)))
    got = got.withColumns({n: F.col(f"{g}.{n}") for n in ("expected_grade", "tail_probability")}).drop(g)
    return got.withColumn("kept", F.col("tail_probability") >= least)


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from 0/1 quality and toxicity: 2 good and harmless, 1 one fault, 0 both; null, so
    unlabelled, if either is null."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
