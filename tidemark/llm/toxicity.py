"""Toxicity by classifier chains.

Categories are predicted one after another by linear models over hashed word
presence.  A later model also sees the earlier categories' probabilities; it is
trained on out-of-fold predictions, so it learns how far to trust them on
unseen text.  The models are fitted on a bounded sample of labelled documents
(``max_labelled``); every document is scored over its whole text.

Defined results: null and empty texts are scored with no features (the models'
intercepts); repeated rows repeat their result; without labelled rows of both
classes a category is predicted with its base rate; an empty table gives an
empty result.  Only doc_id and text are read from the documents; rows of the
label table without a label are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import grams
from .mixing import uniform

BITS = 18
BUCKETS = 1 << BITS
FOLDS = 4
MAX_LABELLED = 8192
#: leading bytes of a word that are features of their own, so that unseen forms of a stem count
STEMS = (4, 5, 6, 7)
#: features kept: those that tell a category's classes apart best, by this many standard errors at least
MAX_FEATURES = 2048
LEAST_Z = 5.0
THRESHOLD = 0.5


def word_buckets(data: np.ndarray, offs: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of the distinct words and word stems of every document."""
    starts, ends, first = grams.word_spans(data, offs, grams.ALNUM)
    sums = grams.prefix_sums(data, True)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    pairs = []
    for stem in (None, *STEMS):
        long = slice(None) if stem is None else ends - starts > stem
        stop = ends if stem is None else starts[long] + stem
        h = grams.span_hashes(sums, starts[long], stop) ^ np.uint64(stem or 0)
        bucket = (grams.mix(h) >> np.uint64(64 - BITS)).astype(np.int64)
        d = doc[long]
        if wanted is not None:
            keep = wanted[bucket]
            d, bucket = d[keep], bucket[keep]
        pairs.append(d << BITS | bucket)
    pairs = np.unique(np.concatenate(pairs))
    return pairs >> BITS, pairs & (BUCKETS - 1)


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offs in grams.slices(batch):
            doc, bucket = word_buckets(data, offs)
            ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(part)))))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("labels"), lists], ["labels", "buckets"])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Linear:
    """Logistic regression on sparse rows plus a few dense columns."""

    def __init__(self, n: int, extra: int):
        self.w, self.v, self.b = np.zeros(n), np.zeros(extra), 0.0

    def raw(self, row, col, n_rows, dense):
        return np.bincount(row, self.w[col], n_rows) + dense @ self.v + self.b

    def fit(self, row, col, dense, y, l2: float = 0.5, steps: int = 200):
        """Adam over the whole sample; the classes weigh the same."""
        n = len(y)
        if not n or y.min() == y.max():
            p = (y.sum() + 1) / (n + 2)
            self.b = float(np.log(p / (1 - p)))
            return self
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
        theta = np.concatenate([self.w, self.v, [self.b]])
        m, s = np.zeros_like(theta), np.zeros_like(theta)
        nw = len(self.w)
        for t in range(1, steps + 1):
            self.w, self.v, self.b = theta[:nw], theta[nw:-1], theta[-1]
            d = (sigmoid(self.raw(row, col, n, dense)) - y) * weight
            grad = np.concatenate([np.bincount(col, d[row], nw), dense.T @ d, [d.sum()]])
            grad[:-1] += l2 / n * theta[:-1]
            m = 0.9 * m + 0.1 * grad
            s = 0.999 * s + 0.001 * grad * grad
            theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        self.w, self.v, self.b = theta[:nw], theta[nw:-1], float(theta[-1])
        return self


class Chain:
    """Fitted models of all categories, and the buckets they look at."""

    def __init__(self, docs: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS):
        n, k = labels.shape
        row = np.repeat(np.arange(n), [len(d) for d in docs])
        bucket = np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64)
        telling = [self._telling(row, bucket, y) for y in labels.T]
        self.buckets = np.unique(np.concatenate([*telling, np.zeros(0, np.int64)])).astype(np.int64)
        place = np.full(BUCKETS, -1)
        place[self.buckets] = np.arange(len(self.buckets))
        keep = place[bucket] >= 0
        row, col = row[keep], place[bucket[keep]]
        fold = np.arange(n) % folds
        dense = np.zeros((n, 0))
        self.models = []
        for j in range(k):
            y = labels[:, j].astype(float)
            own = np.isin(self.buckets, telling[j])[col]
            r_own, c_own = row[own], col[own]
            unseen = np.zeros(n)
            for f in range(folds):
                inside = fold != f
                new = np.cumsum(inside) - 1
                r = inside[r_own]
                part = Linear(len(self.buckets), j).fit(new[r_own[r]], c_own[r], dense[inside], y[inside])
                unseen[~inside] = part.raw(row, col, n, dense)[~inside]
            self.models.append(Linear(len(self.buckets), j).fit(r_own, c_own, dense, y))
            dense = np.column_stack([dense, sigmoid(unseen)])
        self.wanted = place >= 0
        self.place = place

    @staticmethod
    def _telling(row, bucket, y) -> np.ndarray:
        """Buckets whose log-odds between the classes differ by many standard errors."""
        total = np.bincount(bucket, minlength=BUCKETS)
        a = np.bincount(bucket[y[row] == 1], minlength=BUCKETS) + 0.5
        b = total - a + 1.0
        na, nb = (y == 1).sum() + 1.0, (y == 0).sum() + 1.0
        z = np.abs(np.log(a / na) - np.log(b / nb)) / np.sqrt(1 / a + 1 / b)
        z[total < 3] = 0
        top = np.argsort(-z, kind="stable")[:MAX_FEATURES]
        return np.sort(top[z[top] >= LEAST_Z])

    def predict(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Probabilities, documents by categories."""
        dense = np.zeros((n, 0))
        for model in self.models:
            dense = np.column_stack([dense, sigmoid(model.raw(doc, self.place[bucket], n, dense))])
        return dense


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Chain:
    """Fit on at most about ``max_labelled`` documents, drawn by a hash of their
    id.  ``labels`` has doc_id and one 0/1 column for each category, in chain order."""
    names = [c for c in labels.columns if c != "doc_id"]
    labels = labels.dropna()
    n = labels.count()
    drawn = labels.where(uniform(F.col("doc_id"), "toxicity") < max_labelled / max(n, 1)) \
        .select("doc_id", F.array(*[F.col(c).cast("int") for c in names]).alias("labels"))
    rows = docs.select("doc_id", "text").join(drawn, "doc_id").select("labels", "text") \
        .mapInArrow(_bucket_rows, "labels array<int>, buckets array<int>").toArrow()
    y = np.array(rows.column("labels").to_pylist(), int).reshape(-1, len(names))
    found = rows.column("buckets").combine_chunks()
    found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
    ends, flat = found.offsets.to_numpy(), found.values.to_numpy(zero_copy_only=False)
    each = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    order = sorted(range(len(each)), key=lambda i: (len(each[i]), each[i].tobytes(), tuple(y[i])))
    return Chain([each[i] for i in order], y[order])


def score(docs: DataFrame, chain: Chain, names: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, carried columns, p_<category>...)`` for every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c for c in carry if c != "text"])
    schema = StructType([rows.schema[c] for c in ("doc_id", *carry)] + [StructField(f"p_{c}", DoubleType()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in grams.slices(batch):
                p = chain.predict(*word_buckets(data, offs, chain.wanted), len(part))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", *carry)], *map(pa.array, p.T)],
                                                 ["doc_id", *carry, *[f"p_{c}" for c in names]])
    return rows.mapInArrow(run, schema)


def categories(labels: DataFrame) -> DataFrame:
    """The chain of the label table: low quality first, then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """Probabilities of each category and ``toxic`` (0/1) for every document, beside
    the columns ``carry`` of its own row."""
    cats = categories(labels)
    out = score(docs, train(docs, cats), [c for c in cats.columns if c != "doc_id"], carry)
    return out.withColumn("toxic", (F.col("p_toxic") >= threshold).cast("int"))
