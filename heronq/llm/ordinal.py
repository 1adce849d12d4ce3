"""Toxicity: severity grades by cumulative-link ordinal regression on sparse text features.

Features are counts of words and of word beginnings (2 to 8 bytes), lower-cased, between signs and
spaces; the `features` that tell toxic labelled rows best from others (signed root of the likelihood
ratio) are kept, matched by their whole 64-bit hash. Grade 0 is not toxic; toxic rows are graded 1
to GRADES by the density of strongly toxic features in them, at quantiles of the labelled toxic
rows. One weight vector is shared by all thresholds: P(grade <= k) = 1 / (1 + exp(-(theta_k - w x))).
The result is the expected grade; a row is toxic where P(grade >= 1) is at least the threshold.

The model is fitted on at most per_class labelled rows of each class, none held out, and has at most
`features` features, each in LEAST_ROWS toxic rows of the sample or more. Null and empty
texts have no features: their grade follows from the thresholds alone. Without toxic labels, or where no
feature stands in so many rows, every row has severity 0. Very long texts are read whole; null doc_ids are graded, but never fitted on.
Repeated rows, ties and extra columns change nothing. Grades above 1 come from the features themselves, as labels know only 0 and 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronq.llm.common import _BYTE, _P, arrow_map, batch, filter_rows, lower_bytes, mix, settle, utf8, word_hashes, word_spans
from heronq.llm.training import class_counts, held_out, labelled_sample, sampled_texts

PER_CLASS = 4_000
#: A row is toxic from this probability of grade 1 or more.
THRESHOLD = 0.25
FEATURES = 1_500
GRADES = 3
#: A feature must stand in so many labelled rows.
LEAST_ROWS = 6
MAX_PREFIX = 8
#: Features count by so many words, and select by the rows where they are at least one in DENSE words.
PER_WORDS, DENSE = 50, 120

_APART = np.ones(256, bool)
_APART[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = False
_STEP = np.array([pow(int(_P), k, 1 << 64) for k in range(MAX_PREFIX)], np.uint64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of every word and word beginning, and the words of each row."""
    low = lower_bytes(data)
    low[_APART[low]] = 0x20
    starts, ends, first = word_spans(low, offsets)
    lengths = ends - starts
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    rows, hashes = [row], [word_hashes(low, starts, ends)]
    h = np.zeros(len(starts), np.uint64)
    for k in range(MAX_PREFIX):
        more = np.flatnonzero(lengths > k)
        h[more] += _BYTE[low[starts[more] + k]] * _STEP[k]
        # a beginning ends between characters and before the word's end
        inner = more[lengths[more] > k + 1]
        inner = inner[(low[starts[inner] + k + 1] & 0xC0) != 0x80]
        if k >= 1:
            rows.append(row[inner])
            hashes.append(mix(h[inner] ^ np.uint64(0xA5A5A5A5 + k)))
    return np.concatenate(rows), np.concatenate(hashes), np.diff(first)


@dataclass
class Model:
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thetas: np.ndarray = field(default_factory=lambda: np.full(GRADES, 40.0))

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, count) of the kept features in each row, and the words of each row."""
        rows, hashes, n = tokens(data, offsets)
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), n
        maybe = np.zeros(1 << 16, bool)
        maybe[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
        some = np.flatnonzero(maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[some]
        key, count = np.unique(rows[some[hit]] * len(self.hashes) + at[hit], return_counts=True)
        return key // len(self.hashes), key % len(self.hashes), count, n

    def exceedance(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.., a row each."""
        r, f, c, n = self.counts(data, offsets)
        z = np.bincount(r, self.weights[f] * values(c, n[r]), minlength=len(offsets) - 1) if len(r) else np.zeros(len(offsets) - 1)
        return 1 / (1 + np.exp(np.clip(self.thetas[None, :] - z[:, None], -500, 500)))


def values(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A feature's value: the log of one more than its count in PER_WORDS words, for long texts hold anything once."""
    return np.log1p(count * PER_WORDS / np.maximum(words, 1))


def gain(n_toxic: int, n_other: int) -> Column:
    """Likelihood ratio of a feature that stands in `toxic` toxic rows and `other` others, less than 0 where it speaks against toxicity."""
    share = lambda k, n: (k + F.lit(0.1)) / F.lit(n + 0.2)
    fit_ = lambda k, n, q: k * F.ln(q) + (F.lit(float(n)) - k) * F.ln(F.greatest(F.lit(1e-12), 1 - q))
    a, b = F.col("toxic").cast("double"), F.col("other").cast("double")
    both = (a + b + F.lit(0.2)) / F.lit(n_toxic + n_other + 0.4)
    ratio = fit_(a, n_toxic, share(a, n_toxic)) + fit_(b, n_other, share(b, n_other)) - fit_(a, n_toxic, both) - fit_(b, n_other, both)
    return F.when(share(a, n_toxic) > share(b, n_other), ratio).otherwise(-ratio)


def fit_ordinal(n_rows: int, rows: np.ndarray, feats: np.ndarray, x: np.ndarray, grade: np.ndarray, weight: np.ndarray, dim: int, grades: int = GRADES, ridge: float = 2e-3, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative-link model, by Adam on the penalised mean log-likelihood.

    Thresholds are a first one and positive gaps, so they stay in order.
    """
    w = np.zeros(dim)
    gap = np.concatenate([[2.0], np.zeros(grades - 1)])  # logs of gaps but for the first
    moments = np.zeros((2, dim + grades))
    total = weight.sum()

    def sigma(t):
        return 1 / (1 + np.exp(-np.clip(t, -500, 500)))

    for step in range(1, steps + 1):
        theta = np.cumsum(np.concatenate([gap[:1], np.exp(gap[1:])]))
        z = np.bincount(rows, w[feats] * x, minlength=n_rows)
        bounds = np.concatenate([[-np.inf], theta, [np.inf]])
        up, down = bounds[grade + 1] - z, bounds[grade] - z
        su, sd = sigma(up), sigma(down)
        p = np.maximum(su - sd, 1e-12)
        du, dd = su * (1 - su), sd * (1 - sd)
        gz = weight * (du - dd) / p  # minus the log-likelihood, by z
        gt = np.zeros(grades)
        np.add.at(gt, np.minimum(grade, grades - 1), np.where(grade < grades, -weight * du / p, 0))
        np.add.at(gt, np.maximum(grade - 1, 0), np.where(grade > 0, weight * dd / p, 0))
        gw = np.bincount(feats, gz[rows] * x, minlength=dim) / total + ridge * w
        tail = np.cumsum(gt[::-1])[::-1] / total
        gg = tail.copy()
        gg[1:] *= np.exp(gap[1:])
        g = np.concatenate([gw, gg])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.999 * moments[1] + 0.001 * g * g
        move = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w -= move[:dim]
        gap -= move[dim:]
    return w, np.cumsum(np.concatenate([gap[:1], np.exp(gap[1:])]))


_COUNTED = pa.schema([("h", pa.int64()), ("toxic", pa.int64()), ("other", pa.int64())])
_SPARSE = pa.schema([("y", pa.int32()), ("words", pa.int64()), ("f", pa.binary()), ("c", pa.binary())])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, features: int = FEATURES) -> Model:
    # the sample is bounded, so it is written out once and the tables of all documents are read once
    texts = settle(sampled_texts(docs, labelled_sample(labels, label, per_class)).select("text", "y"), "sample")
    natural = class_counts(labels, label)

    def present(batches):
        for b in batches:
            y = np.asarray(b.column(1).to_pylist(), np.int64)
            rows, hashes, words = tokens(*utf8(b.column(0)))
            order = np.lexsort((hashes, rows))
            rows, hashes = rows[order], hashes[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
            heads = np.flatnonzero(new)
            count = np.diff(np.append(heads, len(rows)))
            dense = count * DENSE >= words[rows[heads]]
            rows, hashes = rows[heads][dense], hashes[heads][dense]
            names, inverse = np.unique(hashes, return_inverse=True)
            toxic = np.bincount(inverse, y[rows], minlength=len(names)).astype(np.int64)
            both = np.bincount(inverse, minlength=len(names))
            yield batch(_COUNTED, names.view(np.int64), toxic, both - toxic)

    totals = {r.y: r.n for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_other:
        return Model()
    counted = arrow_map(texts, present, "h long, toxic long, other long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    best = counted.where(F.col("toxic") >= LEAST_ROWS).orderBy(F.desc(gain(n_toxic, n_other)), "h").limit(features).collect()
    if not best:
        return Model()
    best.sort(key=lambda r: r.h % (1 << 64))
    table = np.array([(r.toxic, r.other) for r in best], np.int64)
    names = np.array([r.h for r in best], np.int64).view(np.uint64)
    strong = (table[:, 0] + 0.1) / (n_toxic + 0.2) > 8 * (table[:, 1] + 0.5) / (n_other + 1.0)
    model = Model(names, np.zeros(len(names)))

    def sparse(batches):
        for b in batches:
            r, f, c, n = model.counts(*utf8(b.column(0)))
            edges = np.searchsorted(r, np.arange(len(n) + 1))
            cut = lambda x: [x[i:j].astype("<i4").tobytes() for i, j in zip(edges, edges[1:])]
            yield batch(_SPARSE, b.column(1), n, cut(f), cut(c))

    got = arrow_map(texts, sparse, "y int, words long, f binary, c binary").collect()
    got.sort(key=lambda r: (r.y, r.words, bytes(r.f), bytes(r.c)))
    f = [np.frombuffer(r.f, "<i4") for r in got]
    c = [np.frombuffer(r.c, "<i4") for r in got]
    y, words = np.array([r.y for r in got], np.int64), np.array([r.words for r in got], np.int64)
    density = np.array([ci[strong[fi]].sum() / max(1, n) for fi, ci, n in zip(f, c, words)])
    cuts = np.quantile(density[y == 1], np.arange(1, GRADES) / GRADES)
    grade = np.where(y == 1, 1 + np.searchsorted(cuts, density, "right"), 0)
    weight = np.where(y == 1, natural[1] / n_toxic, natural[0] / n_other)
    rows = np.repeat(np.arange(len(got)), [len(x) for x in f])
    feats, counts = (np.concatenate(a).astype(np.int64) if a else np.zeros(0, np.int64) for a in (f, c))
    model.weights, model.thetas = fit_ordinal(len(got), rows, feats, values(counts, words[rows]), grade, weight, len(names))
    return model


_GRADED = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("grade", pa.int32()), ("p_toxic", pa.float64())])


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity: expected grade, grade: most likely, p_toxic) of every row; the model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            over = m.exceedance(*utf8(b.column(1)))
            steps = np.concatenate([np.ones((len(over), 1)), over, np.zeros((len(over), 1))], axis=1)
            yield batch(_GRADED, b.column(0).cast(pa.int64()), over.sum(axis=1), (steps[:, :-1] - steps[:, 1:]).argmax(axis=1), over[:, 0])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, severity double, grade int, p_toxic double")


def harmless(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of docs, all columns, that are not toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class=per_class))
    return filter_rows(docs, "text", lambda: lambda texts: shared.value.exceedance(*utf8(texts))[:, 0] < threshold)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, severity, grade, p_toxic, toxic, kept) of every row."""
    got = grade(docs, fit(docs, labels, per_class=per_class))
    toxic = F.col("p_toxic") >= threshold
    return got.select("doc_id", held_out().alias("held_out"), "severity", "grade", "p_toxic", toxic.cast("int").alias("toxic"), (~toxic).alias("kept"))
