"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades 0, 1, 2: junk; sound but toxic; sound and not toxic. P(grade > k) = sigmoid(w.x - t_k), with one
weight vector over hashed words and ordered thresholds t_0 <= t_1. The fit reads a bounded sample of
labelled documents (SAMPLE, the smallest hashes of their ids); every document is scored.

Features: the presence of each word and of each beginning of four letters, and the share of words that
repeat, are in capitals, or hold signs.

Defined cases: a null or empty text has no features and gets the thresholds' own probabilities; repeated
rows are scored alike; without labels every document is kept, at the highest grade; an empty table gives
an empty result; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Labelled documents that the fit reads at most; hashed word features; grades.
SAMPLE, BITS, GRADES = 4000, 18, 3
#: Documents of the sample that a word must be in for a weight of its own.
SEEN = 4
DIM = (1 << BITS) + 8
#: A document is kept if the probability of the highest grade is at least this.
KEEP = 0.5


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: words in lower case and their stems count once; then the dense measures."""
    words = text.split()
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0)
    once = set(words)
    bare = {w.strip(".,;:!?\"'()").lower() for w in once}
    crc, mask = zlib.crc32, (1 << BITS) - 1
    stems = {w[:4] + "-" for w in bare if len(w) > 4}  # inflected forms share it
    idx = [crc(w.encode("utf-8", "surrogatepass")) & mask for w in bare | stems]
    value = [1.0] * len(idx)
    signs = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:!?\"')")
    loud = sum(1 for w in words if len(w) > 1 and w.isupper())
    shout = sum(1 for w in words if w.endswith("!!"))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    for k, x in enumerate((signs / n, loud / n, shout / n, again, float(signs > 2), float(loud > 3), float(again > 0.2))):
        if x:
            idx.append((1 << BITS) + k)
            value.append(10.0 * x)
    return np.array(idx, np.int64), np.array(value)


def fit(rows: list[tuple[str, int]], rounds: int = 300, rate: float = 0.05, lasso: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the likelihood, rare grades weighing more. Words of under SEEN
    documents of the sample get no weight, and small weights are cut to 0, so that long texts gather no noise."""
    w, base, gap = np.zeros(DIM), -1.0, 0.0
    if not rows:
        return w, np.array([-20.0, -20.0])
    each = [features(t) for t, _ in rows]
    at = np.repeat(np.arange(len(rows)), [len(i) for i, _ in each])
    idx, val = np.concatenate([i for i, _ in each]), np.concatenate([v for _, v in each])
    y = np.array([g for _, g in rows])
    known = np.bincount(idx, minlength=DIM) >= SEEN
    at, val = at[known[idx]], val[known[idx]]
    used, idx = np.unique(idx[known[idx]], return_inverse=True)
    n = len(used)
    share = np.bincount(y, minlength=GRADES) / len(y)
    weight = 1 / np.maximum(share[y], 1e-9) ** 0.5
    weight /= weight.sum()
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    p = np.concatenate([w[:n], [base, gap]])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        own_w, base, width = p[:n], p[n], np.exp(np.clip(p[n + 1], -10, 10))
        s = np.bincount(at, val * own_w[idx], minlength=len(rows))
        up0, up1 = sig(s - base), sig(s - base - width)  # P(grade > 0), P(grade > 1)
        probs = np.stack([1 - up0, up0 - up1, up1])
        own = np.maximum(probs[y, np.arange(len(y))], 1e-12)
        d0, d1 = up0 * (1 - up0), up1 * (1 - up1)
        g0 = np.where(y == 0, -d0, np.where(y == 1, d0, 0)) / own * weight  # by (s - base) through up0
        g1 = np.where(y == 1, -d1, np.where(y == 2, d1, 0)) / own * weight
        g = g0 + g1
        grad = -np.concatenate([np.bincount(idx, val * g[at], minlength=n), [-g.sum(), -(g1 * width).sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        p = p - step * (m / (1 - 0.9**t))
        p[:n] = np.sign(p[:n]) * np.maximum(np.abs(p[:n]) - step[:n] * lasso, 0)
    w[used] = p[:n]
    return w, np.array([p[n], p[n] + np.exp(np.clip(p[n + 1], -10, 10))])


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list[tuple[str, int]]:
    """At most `most` labelled texts with their grade, the same in every run."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    graded = labels.where("quality IS NOT NULL AND toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    # as many of the labels as the sample takes are chosen before texts are read; grades come as often as among the labels
    kept = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = texts(docs).join(F.broadcast(kept), "doc_id").select("doc_id", "text", "grade").orderBy("doc_id", "text").limit(most).collect()
    return [(r["text"], r["grade"]) for r in rows]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected (grade), tail_1, tail_2 (probabilities of at least that grade), kept."""
    weights, cuts = fit(sample(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # DIM numbers, whatever the input
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            s = np.array([float((w[i] * v).sum()) for i, v in map(features, batch.column(1).to_pylist())])
            tails = [1 / (1 + np.exp(-np.clip(s - c, -40, 40))) for c in cuts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, tails)], ["doc_id", "tail_1", "tail_2"])

    out = texts(docs).mapInArrow(rate, f"doc_id {id_type}, tail_1 double, tail_2 double")
    return out.select("doc_id", F.round(F.col("tail_1") + F.col("tail_2"), 6).alias("expected"), F.round("tail_1", 6).alias("tail_1"), F.round("tail_2", 6).alias("tail_2"), (F.col("tail_2") >= KEEP).alias("kept"))


def selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that score() keeps."""
    weights, cuts = fit(sample(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            s = [float((w[i] * v).sum()) for i, v in (features(t or "") for t in batch.column(at).to_pylist())]
            yield batch.filter(pa.array([1 / (1 + np.exp(-np.clip(x - cuts[1], -40, 40))) >= KEEP for x in s], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES, ORACLE = {"op4_quality": op4_quality}, {}
