"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram of 4 to 6 characters anywhere in the whole text.
Its value is the log ratio of its smoothed document frequencies under label 1 and label 0; a
logistic regression is then fitted on the scaled features, from at most 2 x `per_class` labelled
documents: the smallest by a hash of doc_id in each class (of several texts under one doc_id the
first in binary order).  Its intercept is moved to the share of label 1 among all labels.  Scoring
is one narrow pass.

Defined results: null and empty texts get the score of a text without features; without labels
of both classes every score is the share of label 1 (0 without labels); where a doc_id has
several labels, 1 counts if any is 1; null labels count as none; repeated rows score alike; very
long texts are scored whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import map_arrow, materialize, release, row_slices, text_or_empty
from tidefold.llm.ngrams import code_points, hashed

BITS = 20
LENGTHS = (4, 5, 6)
PER_CLASS = 2500
LEAST = 11.0  # of the log-likelihood ratio, chance exceeds it once in a thousand times
FOLDS = 5


@dataclass
class Model:
    """score = sigmoid(bias + the sum of weight over the distinct n-grams of the text)."""

    weight: np.ndarray
    bias: float
    bits: int = BITS
    lengths: tuple[int, ...] = LENGTHS

    def score(self, text: str) -> float:
        found = hashed(code_points(text), self.lengths, self.bits)
        found = np.unique(found[self.weight[found] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weight[found].sum(dtype=np.float64), -50, 50))))


def held_out(doc_id: str | Column = "doc_id", folds: int = FOLDS) -> Column:
    """Rows that no model may learn from; a null id is one of them."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == 0, F.lit(True))


def log_likelihood_ratio(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Dunning's statistic for a of n_a against b of n_b."""
    k = a + b
    out = np.zeros(len(a))
    for seen, of in ((a, n_a), (b, n_b)):
        for x, total in ((seen, k), (of - seen, n_a + n_b - k)):
            expected = total * (of / (n_a + n_b))
            out += np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(expected, 1e-12)), 0.0)
    return 2 * out


def presence(text: str, lengths: tuple[int, ...], bits: int) -> np.ndarray:
    """The distinct n-grams of a whole text."""
    return np.unique(hashed(code_points(text), lengths, bits))


def prior(base_rate: float) -> float:
    return float(np.log((base_rate + 1e-6) / (1 - base_rate + 1e-6)))


def standing_out(counts: np.ndarray, n_pos: int, n_neg: int, smoothing: float = 1.0, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(features, scales): those whose smoothed ratio of presence under label 1 and 0 stands out from chance; `counts` by label and feature."""
    p, q = (counts[1] + smoothing) / (n_pos + 2 * smoothing), (counts[0] + smoothing) / (n_neg + 2 * smoothing)
    kept = np.flatnonzero((counts.sum(axis=0) >= 3) & (log_likelihood_ratio(counts[1], counts[0], n_pos, n_neg) >= least))
    return kept, np.log(p[kept] / q[kept])


def regress(row: np.ndarray, col: np.ndarray, labels: np.ndarray, scale: np.ndarray, ridge: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression, both classes weighing the same; row i has the scaled features `col` where `row` is i."""
    n_pos = labels.sum()
    value, m = scale[col], len(scale)
    w, b = np.zeros(m), 0.0
    m_w, v_w, m_b, v_b = np.zeros(m), np.zeros(m), 0.0, 0.0
    balance = np.where(labels == 1, 0.5 / n_pos, 0.5 / (len(labels) - n_pos))
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, weights=w[col] * value, minlength=len(labels))
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) * balance
        g_w, g_b = np.bincount(col, weights=g[row] * value, minlength=m) + ridge * w, g.sum()
        m_w, m_b = 0.9 * m_w + 0.1 * g_w, 0.9 * m_b + 0.1 * g_b
        v_w, v_b = 0.999 * v_w + 0.001 * g_w**2, 0.999 * v_b + 0.001 * g_b**2
        rate = 0.05 / (1 - 0.9**t) * np.sqrt(1 - 0.999**t)
        w -= rate * m_w / (np.sqrt(v_w) + 1e-8)
        b -= rate * m_b / (np.sqrt(v_b) + 1e-8)
    return w, b


def sample_of(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, float | None]:
    """The labelled documents to fit on (doc_id, text, toxic), and the share of label 1 among all labels that may be learned."""
    marked = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shares = marked.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("ones")).first()
    picked = None
    for value in (0, 1):
        part = marked.where((F.col("toxic") == 1) == F.lit(value == 1)).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(per_class).drop("h")
        picked = part if picked is None else picked.unionByName(part)
    ids = F.broadcast(picked)  # 2 x per_class ids at most
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(ids, "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), shares.ones / shares.n if shares.n else None


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bits: int = BITS, lengths: tuple[int, ...] = LENGTHS) -> Model:
    """Fit on labelled rows of `docs` that are not held out.

    Texts stay with the executors: the driver gets counts by feature and label, and then of each
    sampled document the features that stand out, so its memory depends on neither text lengths nor corpus.
    """
    sample, base_rate = sample_of(docs, labels, per_class)
    none = Model(np.zeros(1 << bits, dtype=np.float32), prior(base_rate or 0.0), bits, lengths)
    if base_rate is None:
        return none
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    sample = materialize(sample.repartition(n, "doc_id"), "labelled")

    def count(batches):
        import pyarrow as pa

        counts, rows = np.zeros((2, 1 << bits), dtype=np.int32), np.zeros(2, dtype=np.int64)
        for whole in batches:
            for text, y in zip(whole.column("text").to_pylist(), whole.column("toxic").to_pylist(), strict=True):
                counts[int(y == 1), presence(text, lengths, bits)] += 1
                rows[int(y == 1)] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([int(rows[0]), *counts[0, at].tolist()], pa.int64()), pa.array([int(rows[1]), *counts[1, at].tolist()], pa.int64())], names=["feature", "clean", "toxic"])

    # a sum each for 2**bits features at most; rarer ones than three documents are no features
    found = map_arrow(sample, count, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("feature = -1 OR clean + toxic >= 3").toArrow()
    feature, clean, toxic = (found.column(c).to_numpy() for c in ("feature", "clean", "toxic"))
    counts = np.zeros((2, 1 << bits), dtype=np.int64)
    real = feature >= 0
    counts[:, feature[real]] = clean[real], toxic[real]
    n_neg, n_pos = int(clean[~real].sum()), int(toxic[~real].sum())
    if not n_pos or not n_neg:
        return none
    kept, scale = standing_out(counts, n_pos, n_neg)
    if not len(kept):
        return none
    shared = docs.sparkSession.sparkContext.broadcast(kept)

    def features(batches):
        import pyarrow as pa

        for whole in batches:
            ids, texts, y = (whole.column(c).to_pylist() for c in ("doc_id", "text", "toxic"))
            at = [np.flatnonzero(np.isin(shared.value, presence(t, lengths, bits), assume_unique=True)).tolist() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([int(v == 1) for v in y], pa.int32()), pa.array(at, pa.list_(pa.int32()))], names=["doc_id", "toxic", "features"])

    rows = map_arrow(sample.withColumn("doc_id", F.col("doc_id").cast("long")), features, "doc_id long, toxic int, features array<int>").toArrow().sort_by("doc_id")
    release(sample)
    lists = rows.column("features").combine_chunks()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    w, b = regress(row, lists.flatten().to_numpy().astype(np.int64), rows.column("toxic").to_numpy().astype(np.float64), scale)
    weight = np.zeros(1 << bits, dtype=np.float32)
    weight[kept] = w * scale
    return Model(weight, b + prior(base_rate), bits, lengths)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        scorer = shared.value.score
        for whole in batches:
            for batch in row_slices(whole):
                found = [scorer(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    rows = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), run, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, unchanged, that score below `threshold`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        scorer = shared.value.score
        for whole in batches:
            for batch in row_slices(whole):
                yield batch.filter(pa.array([scorer(t or "") < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
