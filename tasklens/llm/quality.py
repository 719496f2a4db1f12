"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel. Each partition of the labelled sample sums its part of the normal equations
and of the statistics' moments, so only matrices of a fixed size reach the driver, which solves them. The calibration
is a monotone step function, fitted by pooling adjacent violators and read with linear interpolation.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tasklens.llm.common import labelled_sample, map_batches, map_rows, map_stream, table

FEATURES, GAMMA, RIDGE, SEED = 256, 0.15, 1e-2, 7
#: Most labelled rows that the model is fitted on, and partitions that sum them.
MOST_LABELLED, FIT_PARTITIONS = 20_000, 24
N_STATS = 16


def statistics(text: str | None) -> list[float]:
    """Sixteen statistics of a whole text, each of a bounded size; null counts as empty."""
    text = text or ""
    n, words = len(text), text.split()
    m = len(words)
    if not m:
        return [0.0] * N_STATS
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[48:58].sum())
    marks = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    stops = int(counts[44] + counts[46])
    letters = upper + lower + int(counts[128:].sum()) / 2
    seen = Counter(words)
    top = seen.most_common(1)[0][1]
    same = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    size = np.log1p(n)
    odd = zlib.compress(raw, 1)
    lengths = len("".join(words)) / m
    return [
        size / 10, min(m, 50) / 50, lengths / 10, upper / n, digit / n * 4, (marks - stops) / n * 4, stops / n * 10, letters / n,
        len(seen) / m, top / m, same / m, len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))) / 10,
        len(odd) / len(raw), (counts[33] + counts[63]) / n * 10, (counts[124] + counts[35] + counts[42] + counts[36] + counts[37] + counts[38]) / n * 6,
    ]


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, np.sqrt(2 * GAMMA), (N_STATS, FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.xs, self.ys = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.w + self.b
        return np.hstack([np.cos(z) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; a little of the raw score keeps the order inside a calibrated step."""
        raw = self.raw(x)
        return np.clip(0.98 * np.interp(raw, self.xs, self.ys) + 0.02 * np.clip(raw, 0, 1), 0, 1)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and means of the pooled blocks, ascending; ties in score are one point from the start."""
    points, inverse = np.unique(score, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, y) / weight
    blocks: list[list[float]] = []
    for x, m, w in zip(points, mean, weight):
        blocks.append([x * w, m * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    out = np.array(blocks)
    return out[:, 0] / out[:, 2], out[:, 1] / out[:, 2]


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """A model of at most `most` labelled rows outside the held-out fifth; without any, every score is about 0.5."""
    sample = labelled_sample(docs, labels, "quality", most).select("text", "y")

    def stats():
        return lambda batch: ((np.array(statistics(t.as_py())).tobytes(), y) for t, y in zip(batch.column(0), batch.column(1).to_pylist()))

    seen = table(map_rows(sample, "x binary, y int", stats), "quality_sample").coalesce(FIT_PARTITIONS)

    def summed(reduce):
        def make():
            def stream(batches):
                total = None
                for batch in batches:
                    if batch.num_rows:
                        x = np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(-1, N_STATS)
                        part = reduce(x, np.array(batch.column(1).to_pylist(), float))
                        total = part if total is None else total + part
                if total is not None:
                    yield (total.tobytes(),)

            return stream

        return [np.frombuffer(r.part) for r in map_stream(seen, "part binary", make).collect()]  # FIT_PARTITIONS rows at most

    moments = summed(lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    if not moments:
        return Model(np.zeros(N_STATS), np.ones(N_STATS))
    n, sums, squares = (t := sum(moments))[0], t[1 : N_STATS + 1], t[N_STATS + 1 :]
    mean = sums / n
    model = Model(mean, np.sqrt(np.maximum(squares / n - mean**2, 0)) + 1e-3)
    half = FEATURES + 1

    def normal(x, y):
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = sum(summed(normal))
    model.beta = np.linalg.solve(sums[: half * half].reshape(half, half) + RIDGE * np.eye(half), sums[half * half :])

    def scores():
        return lambda batch: zip(model.raw(np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(-1, N_STATS)).tolist(), batch.column(1).to_pylist())

    got = np.array([(r.s, r.y) for r in map_rows(seen, "s double, y int", scores).collect()])  # at most `most` pairs
    model.xs, model.ys = isotonic(got[:, 0], got[:, 1])
    return model


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of docs (doc_id, text); null texts count as empty, which have a score as well."""

    def make():
        def rows(batch):
            x = np.array([statistics(t.as_py()) for t in batch.column(1)], float).reshape(-1, N_STATS)
            return zip(batch.column(0).to_pylist(), model.score(x).tolist())

        return rows

    return map_rows(docs.select("doc_id", "text"), "doc_id long, score double", make)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs whose score is at least threshold; columns and repeated rows stay as they are.

    Null and empty texts are scored like any other, long ones whole; no rows give none.
    """
    at = docs.columns.index("text")

    def make():
        def change(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([statistics(t.as_py()) for t in batch.column(at)], float).reshape(-1, N_STATS)
            return batch.filter(pa.array(model.score(x) >= threshold))

        return change

    return map_batches(docs, make)
