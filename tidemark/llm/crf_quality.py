"""Document quality from a linear-chain conditional random field over lines.

Every line of a document is labelled good or bad; emissions look at the line
and its neighbours, transitions at the label of the line before.  Marginals
come from forward-backward; a document's quality is the mean marginal of its
lines weighted by their length, calibrated to a probability.  The field is
fitted on a bounded sample of labelled documents (``max_labelled``): lines
first take their document's label, then lines of bad documents that look good
are relabelled and the field is fitted again.  Every document is scored over
its whole text.

Defined results: a null or empty text is one empty line; repeated rows repeat
their result; without labels of both classes every score is the base rate; an
empty table gives an empty result.  Only doc_id and text are read; labels,
language, source and id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .mixing import uniform

MAX_LABELLED = 4096
ROUNDS = 2
STEPS = 120
CUT = 0.3


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


# fixed values: the byte classes that line features count
CLASSES = {
    "upper": _table(bytes(range(65, 91))),
    "lower": _table(bytes(range(97, 123))),
    "digit": _table(b"0123456789"),
    "wide": _table(bytes(range(128, 256))),
    "stop": _table(b".,;:?"),
    "bang": _table(b"!"),
    "bar": _table(b"|"),
    "sign": _table(b"#$%&*@^~=+_<>{}[]\\/"),
    "quote": _table(b"\"'`()-"),
}


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes per line, first line of each document).  A document has
    one line more than line feeds."""
    breaks = np.flatnonzero(data == 10)
    doc = np.searchsorted(offs, breaks, "right") - 1
    per = np.bincount(doc, minlength=len(offs) - 1) + 1
    first = np.concatenate(([0], np.cumsum(per)))
    starts = np.empty(first[-1], np.int64)
    ends = np.empty(first[-1], np.int64)
    is_first = np.zeros(first[-1], bool)
    is_first[first[:-1]] = True
    starts[is_first] = offs[:-1]
    starts[~is_first] = breaks + 1
    is_last = np.zeros(first[-1], bool)
    is_last[first[1:] - 1] = True
    ends[is_last] = offs[1:]
    ends[~is_last] = breaks
    n = ends - starts
    size = np.maximum(n, 1).astype(float)

    def count(mask):
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[ends] - total[starts]
    share = np.column_stack([count(t[data]) / size for t in CLASSES.values()])
    ws, we, _ = grams.word_spans(data, offs, grams.NOT_SPACE)
    wl = np.searchsorted(ends, ws, "right")
    words = np.bincount(wl, minlength=len(n)).astype(float)
    some = np.maximum(words, 1)
    length = np.bincount(wl, we - ws, len(n)) / some
    short = np.bincount(wl, we - ws <= 3, len(n)) / some
    h = grams.span_hashes(grams.prefix_sums(data, True), ws, we)
    distinct = np.bincount(_distinct(wl, h), minlength=len(n)) / some
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (wl[1:] == wl[:-1])
    again = np.bincount(wl, again, len(n)) / some
    own = np.column_stack([share, share[:, [0, 5, 6, 7]] > 0.02, np.log1p(n) / 5, np.log1p(words) / 3, length / 8,
                           length > 9, short, distinct, again, again > 0.15, n == 0, words == 1])
    before = np.zeros_like(own)
    after = np.zeros_like(own)
    before[1:] = own[:-1]
    before[is_first] = 0
    after[:-1] = own[1:]
    after[is_last] = 0
    return np.column_stack([own, before, after, is_first, is_last, np.ones(len(n))]), n, first


def _distinct(line: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The line of each distinct (line, word)."""
    order = np.lexsort((h, line))
    a, b = line[order], h[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep]


class Field:
    """Weights of the two-label chain: good against bad emissions, transitions."""

    def __init__(self, n_features: int):
        self.w = np.zeros(n_features)
        self.t = np.zeros((2, 2))
        self.a, self.b = 1.0, 0.0

    def marginals(self, x: np.ndarray, first: np.ndarray):
        """(P(good) per line, pair marginals summed over lines).  Documents go
        side by side, longest first, so a step handles all that are so long."""
        n_lines = np.diff(first)
        order = np.argsort(-n_lines, kind="stable")
        start, n = first[:-1][order], n_lines[order]
        active = np.searchsorted(-n, -np.arange(1, n.max(initial=0) + 1), "right")
        e = np.zeros((len(x), 2))
        e[:, 1] = x @ self.w
        e = np.exp(e - e.max(axis=1, keepdims=True))
        t = np.exp(self.t)
        f, g = np.zeros_like(e), np.ones_like(e)
        for i, k in enumerate(active):
            at = start[:k] + i
            step = e[at] if i == 0 else e[at] * (f[at - 1] @ t)
            f[at] = step / step.sum(axis=1, keepdims=True)
        for i in range(len(active) - 2, -1, -1):
            at = start[:active[i + 1]] + i
            back = (e[at + 1] * g[at + 1]) @ t.T
            g[at] = back / back.sum(axis=1, keepdims=True)
        p = f * g
        p /= p.sum(axis=1, keepdims=True)
        inner = np.ones(len(x), bool)
        inner[first[:-1]] = False
        j = np.flatnonzero(inner)
        pair = f[j - 1][:, :, None] * t * (e[j] * g[j])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        return p[:, 1], pair, j

    def fit(self, x, first, y, weight, steps: int = STEPS, l2: float = 1e-3):
        """Adam on the conditional log-likelihood of line labels ``y``."""
        theta = np.concatenate([self.w, self.t.ravel()])
        m, s = np.zeros_like(theta), np.zeros_like(theta)
        total = weight.sum()
        for k in range(1, steps + 1):
            self.w, self.t = theta[:-4], theta[-4:].reshape(2, 2)
            p, pair, j = self.marginals(x, first)
            gw = x.T @ ((p - y) * weight)
            seen = np.zeros_like(pair)
            seen[np.arange(len(j)), y[j - 1].astype(int), y[j].astype(int)] = 1
            gt = ((pair - seen) * weight[j][:, None, None]).sum(axis=0)
            grad = np.concatenate([gw, gt.ravel()]) / total + l2 * theta
            m = 0.9 * m + 0.1 * grad
            s = 0.999 * s + 0.001 * grad * grad
            theta = theta - 0.08 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
        self.w, self.t = theta[:-4], theta[-4:].reshape(2, 2)

    def quality(self, x, n, first) -> np.ndarray:
        """Length-weighted mean of P(good) per document."""
        p = self.marginals(x, first)[0] if len(x) else np.zeros(0)
        size = np.maximum(n, 1).astype(float)
        mass = np.concatenate(([0.0], np.cumsum(p * size)))
        all_ = np.concatenate(([0.0], np.cumsum(size)))
        return (mass[first[1:]] - mass[first[:-1]]) / (all_[first[1:]] - all_[first[:-1]])

    def score(self, x, n, first) -> np.ndarray:
        q = np.clip(self.quality(x, n, first), 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-np.clip(self.a * np.log(q / (1 - q)) + self.b, -30, 30)))

    def calibrate(self, x, n, first, y) -> None:
        q = np.clip(self.quality(x, n, first), 1e-4, 1 - 1e-4)
        z = np.log(q / (1 - q))
        a, b = 1.0, 0.0
        for _ in range(30):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            v = p * (1 - p) + 1e-6
            g = np.array([((p - y) * z).sum() + 0.01 * a, (p - y).sum() + 0.01 * b])
            h = np.array([[(v * z * z).sum() + 0.01, (v * z).sum()], [(v * z).sum(), v.sum() + 0.01]])
            a, b = np.array([a, b]) - np.linalg.solve(h, g)
        self.a, self.b = float(max(a, 1e-3)), float(b)


def train_field(texts: list[str], labels: np.ndarray) -> Field:
    # slice by slice: the features are far smaller than the arrays over all bytes
    parts = [line_features(data, offs) for _, data, offs in
             grams.slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]))]
    parts = parts or [line_features(np.zeros(0, np.uint8), np.zeros(1, np.int64))]
    x, n, per = (np.concatenate(a) for a in zip(*[(x, n, np.diff(first)) for x, n, first in parts]))
    first = np.concatenate(([0], np.cumsum(per)))
    field = Field(x.shape[1])
    if not len(labels) or labels.min() == labels.max():
        p = (labels.sum() + 1) / (len(labels) + 2)
        field.a, field.b = 0.0, float(np.log(p / (1 - p)))
        return field
    per = np.diff(first)
    y = np.repeat(labels, per).astype(float)
    share = labels.mean()
    # a document weighs the same whatever its length, and the classes weigh the same
    weight = np.repeat(np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / np.sqrt(per), per)
    for r in range(ROUNDS):
        field.fit(x, first, y, weight)
        if r + 1 < ROUNDS:
            p = field.marginals(x, first)[0]
            worst = np.repeat(np.minimum.reduceat(p, first[:-1]), per)
            y = np.where((np.repeat(labels, per) == 0) & (p > 0.5) & (p > worst), 1.0, np.repeat(labels, per))
    field.calibrate(x, n, first, labels)
    return field


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Field:
    """Fit on at most about ``max_labelled`` documents drawn by a hash of their
    id; ``labels`` has doc_id and quality (0/1)."""
    labels = labels.select("doc_id", "quality").dropna()
    n = labels.count()
    drawn = labels.where(uniform(F.col("doc_id"), "quality") < max_labelled / max(n, 1))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(drawn, "doc_id") \
        .select("doc_id", "quality", "text").toArrow()
    at = sorted(range(len(rows)), key=lambda i: (rows["doc_id"][i].as_py(), rows["text"][i].as_py()))
    return train_field([rows["text"][i].as_py() for i in at], np.array([rows["quality"][i].as_py() for i in at], int))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def score(docs: DataFrame, field: Field) -> DataFrame:
    """``(doc_id, score)`` for every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in grams.slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(field.score(*line_features(data, offs)))], ["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, learnt from the rows that are not held out."""
    field = train(docs, labels.where(~held_out()))
    return score(docs, field).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                                     (F.col("score") >= CUT).cast("int").alias("predicted"))
