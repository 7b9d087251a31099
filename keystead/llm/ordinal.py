"""Toxicity by cumulative-link ordinal regression on sparse word counts.

P(grade > k) = logistic(x w - cut_k): one weight vector for all ordered cuts. Features are words whose presence
goes with the labels (log-likelihood ratio); x is log2(1 + count) over the whole text. The expected severity is
the sum of P(grade > k).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from . import bytewise as bw
from .tables import stored

#: At most this many labelled rows (those with the smallest id hash) and features enter a fit.
MAX_ROWS, MAX_FEATURES = 20_000, 2_000
#: A text is rejected from this P(grade > 0) on.
REJECT = 0.3
#: Least log-likelihood ratio of a feature (chance below 1e-7).
LEAST_RATIO = 30.0
#: Least share of positive rows among the rows with a feature word, as a multiple of their share among all rows (3 at
#: most half way to 1): words of one language or genre are no evidence of their own.
LEAST_LIFT = 3.0


@dataclass
class OrdinalModel:
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cuts: np.ndarray = field(default_factory=lambda: np.full(3, 20.0))

    def exceed(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k), a column per cut."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - eta[:, None], -50, 50)))


def feature_counts(texts: pa.Array, words: np.ndarray):
    """(text index, feature index, count) of the feature words, and the number of words of each text."""
    data, at = bw.flat(texts)
    parts, total = [], np.zeros(len(at) - 1, np.int64)
    for i, j in bw.pieces(at):
        doc, h, _, _ = bw.words(data[at[i] : at[j]], at[i : j + 1] - at[i])
        total[i:j] = np.bincount(doc, minlength=j - i)
        if len(words):
            k = np.minimum(np.searchsorted(words, h), len(words) - 1)
            hit = words[k] == h
            cell, n = np.unique((doc[hit] + i) * len(words) + k[hit], return_counts=True)
            parts.append((cell, n))
    cell = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    n = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    return cell // max(1, len(words)), cell % max(1, len(words)), n, total


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(id, y, text) of at most ``max_rows`` labelled ids; null ids and labels are left out, a repeated id has its largest label."""
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")


def select_words(sample: DataFrame, max_features: int) -> np.ndarray:
    """Sorted hashes of the feature words."""

    def run(batches):
        for batch in batches:
            data, at = bw.flat(batch.column(1))
            y = batch.column(0).to_numpy(zero_copy_only=False) > 0
            yield pa.record_batch([pa.array([0], pa.int64()), pa.array([int(y.sum())]), pa.array([len(y)], pa.int64()), pa.array([True])],
                                  names=["word", "pos", "n", "is_total"])
            for i, j in bw.pieces(at):
                doc, h = bw.distinct(*bw.words(data[at[i] : at[j]], at[i : j + 1] - at[i])[:2])
                u, back = np.unique(h, return_inverse=True)
                pos = np.bincount(back, weights=y[i:j][doc], minlength=len(u)).astype(np.int64)
                yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(pos), pa.array(np.bincount(back, minlength=len(u)), pa.int64()),
                                       pa.array(np.zeros(len(u), bool))], names=["word", "pos", "n", "is_total"])

    rows = sample.select("y", "text").mapInArrow(bw.released(run), "word long, pos long, n long, is_total boolean")
    rows = stored(rows.groupBy("is_total", "word").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).filter("is_total or n > 2"), "toxic-words")
    total = rows.filter("is_total").first()
    if total is None or not 0 < total.pos < total.n:
        return np.zeros(0, np.uint64)
    p, n = float(total.pos), float(total.n)
    part = lambda seen, row, col: F.when(seen > 0, seen * F.log(seen * F.lit(n) / (row * col))).otherwise(0.0)
    a, m = F.col("pos").cast("double"), F.col("n").cast("double")
    ratio = 2 * (part(a, m, F.lit(p)) + part(m - a, m, F.lit(n - p)) + part(p - a, n - m, F.lit(p)) + part(n - p - m + a, n - m, F.lit(n - p)))
    best = rows.filter("not is_total").withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO)
    best = best.filter(a / m >= min(LEAST_LIFT * p / n, (1 + p / n) / 2))
    best = best.orderBy(F.desc("ratio"), "word").limit(max_features).toPandas()
    return np.sort(best["word"].to_numpy(np.int64).view(np.uint64))


def fit_cuts(row, col, x, y, features: int, grades: int, penalty: float = 1e-4, steps: int = 800):
    """Weights and increasing cuts by gradient steps on the cumulative-link likelihood."""
    share = np.array([(np.sum(y > k) + 0.5) / (len(y) + 1) for k in range(grades - 1)])
    start = np.log((1 - share) / share)
    free = np.r_[np.zeros(features), start[0], np.log(np.maximum(np.diff(start), 0.05))]
    m1, m2 = np.zeros_like(free), np.zeros_like(free)
    n = len(y)
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for t in range(1, steps + 1):
        w, gaps = free[:features], np.exp(free[features + 1 :])
        cuts = free[features] + np.r_[0, np.cumsum(gaps)]
        eta = np.bincount(row, weights=w[col] * x, minlength=n)
        edges = np.r_[-np.inf, cuts, np.inf]
        hi, lo = logistic(edges[y + 1] - eta), logistic(edges[y] - eta)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_eta = (d_hi - d_lo) / n
        g_edge = np.bincount(y + 1, weights=-d_hi, minlength=grades + 1) + np.bincount(y, weights=d_lo, minlength=grades + 1)
        g_cut = g_edge[1:-1] / n
        tail = np.cumsum(g_cut[::-1])[::-1]
        g = np.r_[np.bincount(col, weights=g_eta[row] * x, minlength=features) + penalty * w, tail[0], tail[1:] * gaps]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        free = free - 0.1 * (1 - t / (steps + 1)) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
    return free[:features], free[features] + np.r_[0, np.cumsum(np.exp(free[features + 1 :]))]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", grades: int = 4,
        max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> OrdinalModel:
    """Model from labelled documents.

    Labels may be grades 0, 1, ... (``grades`` of them). Where they are only 0 and 1, positives are graded by the
    amount of feature words in their text, in equal parts. Without rows of both kinds the model has no
    features and gives every text a severity near 0.
    """
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, max_rows)
    words = select_words(sample, max_features)
    if not len(words):
        return OrdinalModel(cuts=np.full(grades - 1, 20.0))

    def run(batches):
        for batch in batches:
            row, col, n, total = feature_counts(batch.column(1), words)
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.record_batch([batch.column(0), pa.array(total), pa.ListArray.from_arrays(cut, pa.array(col, pa.int64())),
                                   pa.ListArray.from_arrays(cut, pa.array(n, pa.int64()))], names=["y", "total", "col", "n"])

    rows = sample.select("y", "text").mapInArrow(bw.released(run), "y long, total long, col array<long>, n array<long>")
    rows = rows.orderBy("y", "total", "col", "n").toPandas()  # a few words of each of at most max_rows documents
    y = rows["y"].to_numpy(np.int64).clip(0, grades - 1)
    size = rows["col"].map(len).to_numpy()
    row = np.repeat(np.arange(len(y)), size)
    col = np.concatenate(rows["col"].to_numpy()).astype(np.int64)
    n = np.concatenate(rows["n"].to_numpy()).astype(np.float64)
    if y.max() == 1 and grades > 2:
        amount = np.bincount(row, weights=np.log2(1 + n), minlength=len(y))
        at = np.flatnonzero(y > 0)
        rank = np.argsort(np.argsort(amount[at], kind="stable"), kind="stable")
        y[at] = 1 + rank * (grades - 1) // len(at)
    weights, cuts = fit_cuts(row, col, np.log2(1 + n), y, len(words), grades)
    return OrdinalModel(words, weights, cuts)


def severity(model: OrdinalModel, text):
    """Struct (severity, toxic): expected grade, and P(grade > 0). Null is read as empty."""
    kind = StructType([StructField("severity", DoubleType()), StructField("toxic", DoubleType())])

    @arrow_udf(kind)
    def score(texts: pa.Array) -> pa.Array:
        row, col, n, total = feature_counts(texts, model.words)
        eta = np.bincount(row, weights=model.weights[col] * np.log2(1 + n), minlength=len(total)) if len(row) else np.zeros(len(total))
        p = model.exceed(eta)
        bw.release()
        return pa.StructArray.from_arrays([pa.array(p.sum(axis=1)), pa.array(p[:, 0])], names=["severity", "toxic"])

    return score(text)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = REJECT) -> DataFrame:
    """Rows of ``docs`` whose P(grade > 0) is below ``least``; all columns stay."""
    model = fit(docs, labels, id_col, text_col)
    return docs.filter(severity(model, F.col(text_col))["toxic"] < least)
