"""Quality classifier: Naive Bayes support vectors.

A text's features are indicators of hashed n-grams: byte trigrams, bigrams of word shapes, and
n-grams of recurrence (runs of words that equal the word a fixed distance before). Each indicator is
scaled by the log ratio of its smoothed class counts, the vector is brought to length 1, and a linear
hinge-loss model is fitted by dual coordinate descent. A logistic curve fitted on labelled rows apart
from those of the descent turns margins into scores from 0 to 1.

The model is fitted on at most per_class labelled rows of each class; scoring covers every row and
whole texts. Labels, language, source and id are no features. Null and empty texts have no features
and score by the intercept; without labels of both classes every score is the share of label 1 (1/2
without labels); repeated rows and extra columns change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronq.llm.common import arrow_map, batch, filter_rows, ngram_hashes, utf8, word_hashes, word_spans
from heronq.llm.training import class_counts, held_out, labelled_sample, sampled_texts

#: Labelled rows of each class at most.
PER_CLASS = 5_000
BITS = 18
DIM = 1 << BITS
#: Distances at which a word may equal an earlier one, and the least run that counts.
PERIODS, RUN = 24, 6

_CLASS = np.zeros(256, np.uint64)
_CLASS[list(range(97, 123))] = 1
_CLASS[list(range(65, 91))] = 2
_CLASS[list(range(48, 58))] = 3
_CLASS[33:48] = 4
_CLASS[58:65] = 4
_CLASS[91:97] = 4
_CLASS[123:127] = 4
_CLASS[128:] = 5


def _fold(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted feature numbers of each row."""
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    lengths = ends - starts
    # shape of a word: classes of its first two and last bytes, and its length up to 15
    shape = np.zeros(len(starts), np.uint64)
    if len(starts):
        shape = _CLASS[data[starts]] * np.uint64(64) + _CLASS[data[np.minimum(starts + 1, ends - 1)]] * np.uint64(8) + _CLASS[data[ends - 1]] + np.minimum(lengths, 15).astype(np.uint64) * np.uint64(512)
    shapes = _fold(ngram_hashes(shape + np.uint64(1), 2))
    grams = np.zeros(0, np.int64)
    if len(data) > 2:
        wide = data.astype(np.uint32)
        code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
        grams = ((code * np.uint32(2654435769)) >> np.uint32(32 - BITS)).astype(np.int64)
    out, seen = [], np.zeros(DIM, bool)
    for r in range(len(offsets) - 1):
        a, z = int(offsets[r]), int(offsets[r + 1])
        i, j = int(first[r]), int(first[r + 1])
        seen[grams[a : max(a, z - 2)]] = True
        seen[shapes[i : max(i, j - 1)]] = True
        h = words[i:j]
        for d in range(1, min(PERIODS, len(h) - RUN) + 1):
            same = h[d:] == h[:-d]
            if same.any():
                runs = np.diff(np.flatnonzero(np.concatenate([[True], ~same, [True]]))) - 1
                longest = int(runs.max())
                if longest >= RUN:
                    k = min(int(np.log2(longest)), 7)
                    seen[[d * 8 + q for q in range(k + 1)]] = True
        got = np.flatnonzero(seen)
        seen[got] = False
        out.append(got)
    return out


@dataclass
class Model:
    weights: np.ndarray  # of unscaled indicators, f32
    ratios: np.ndarray  # f32
    bias: float
    slope: float
    offset: float
    prior: float | None = None  # a constant score instead

    def margin(self, x: np.ndarray) -> float:
        if not len(x):
            return self.bias
        r = self.ratios[x].astype(np.float64)
        norm = np.sqrt(r @ r)
        return float(self.weights[x].astype(np.float64) @ r / norm) + self.bias if norm else self.bias

    def score(self, x: np.ndarray) -> float:
        if self.prior is not None:
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -500, 500))))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, dim: int, epochs: int = 12, tolerance: float = 0.02, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + sum cost_i max(0, 1 - y_i (w x_i + b)); rows are (indices, values), the bias is a constant feature."""
    w, b = np.zeros(dim), 0.0
    alpha, square = np.zeros(len(rows)), np.array([v @ v + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i]
            gradient = y[i] * (w[x] @ v + b) - 1
            projected = min(gradient, 0) if alpha[i] == 0 else max(gradient, 0) if alpha[i] == cost[i] else gradient
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(alpha[i] - gradient / square[i], 0), cost[i])
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                b += step
                alpha[i] = new
        if worst < tolerance:
            break
    return w, b


def logistic_curve(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """slope, offset of the probability that y is 1, by Newton steps with smoothed targets."""
    n1, n0 = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g = weight * (p - target)
        h = weight * p * (1 - p) + 1e-9
        ga, gb = (g * margins).sum() + 1e-6 * a, g.sum()
        haa, hab, hbb = (h * margins**2).sum() + 1e-6, (h * margins).sum(), h.sum()
        det = haa * hbb - hab**2
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return (a, b) if a > 0 else (1.0, float(np.log((n1 + 1) / (n0 + 1))))


def fit_rows(rows: list[np.ndarray], y: np.ndarray, calibrate: np.ndarray, natural: tuple[int, int], smoothing: float = 1.0, cost: float = 1.0) -> Model:
    """rows of feature numbers, labels 0/1, which rows are kept for the curve, and the classes' counts among all labelled rows."""
    empty = np.zeros(DIM, np.float32)
    if not (y == 1).any() or not (y == 0).any():
        n0, n1 = natural
        return Model(empty, empty, 0.0, 1.0, 0.0, n1 / (n0 + n1) if n0 + n1 else 0.5)
    fit = ~calibrate
    if len(set(y[fit])) < 2 or len(set(y[calibrate])) < 2:
        fit = calibrate = np.ones(len(y), bool)
    counts = []
    for c in (1, 0):
        total = np.full(DIM, smoothing)
        for i in np.flatnonzero(fit & (y == c)):
            total[rows[i]] += 1
        counts.append(total / total.sum())
    ratio = np.log(counts[0] / counts[1])
    scaled = []
    at = np.flatnonzero(fit)
    for i in at:
        v = ratio[rows[i]]
        norm = np.sqrt(v @ v)
        scaled.append((rows[i], v / norm if norm else v))
    side = np.where(y[at] == 1, 1.0, -1.0)
    share = np.where(side > 0, (side < 0).mean(), (side > 0).mean()) * 2
    w, b = dual_coordinate_descent(scaled, side, cost * share, DIM)
    model = Model(w.astype(np.float32), ratio.astype(np.float32), float(b), 1.0, 0.0)
    at = np.flatnonzero(calibrate)
    margins = np.array([model.margin(rows[i]) for i in at])
    n = np.array([(y[at] == 0).sum(), (y[at] == 1).sum()])
    weight = np.where(y[at] == 1, natural[1] / n[1], natural[0] / n[0])
    weight *= len(at) / weight.sum()
    model.slope, model.offset = logistic_curve(margins, y[at], weight)
    return model


_ROWS = pa.schema([("y", pa.int32()), ("part", pa.int64()), ("x", pa.binary())])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    def run(batches):
        for b in batches:
            rows = features(*utf8(b.column(0)))
            yield batch(_ROWS, b.column(1), b.column(2), [x.astype("<i4").tobytes() for x in rows])

    sample = sampled_texts(docs, labelled_sample(labels, label, per_class))
    got = arrow_map(sample.select("text", "y", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)).alias("part")), run, "y int, part long, x binary").collect()
    got.sort(key=lambda r: (r.y, r.part, bytes(r.x)))  # the order of arrival must not matter
    y = np.array([r.y for r in got], np.int64)
    return fit_rows([np.frombuffer(r.x, "<i4") for r in got], y, np.array([r.part == 0 for r in got], bool), class_counts(labels, label))


_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; the model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            yield batch(_SCORES, b.column(0).cast(pa.int64()), [m.score(x) for x in features(*utf8(b.column(1)))])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, score double")


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of docs, all columns, that score at least the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, per_class))
    return filter_rows(docs, "text", lambda: lambda texts: np.array([shared.value.score(x) >= threshold for x in features(*utf8(texts))], bool))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    got = score(docs, fit(docs, labels, label, per_class))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
