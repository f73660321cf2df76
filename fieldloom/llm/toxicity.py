"""Operator 6: severity grades by cumulative-link ordinal regression.

Features are words and word beginnings, hashed; those whose share among
toxic rows differs most from the rest are kept. Labels are binary, so
grades are made from them: 0 for rows labelled clean, and for toxic rows 1
or 2, by whether they hold fewer marked words than the median toxic row.
One weight vector serves every threshold:

    P(grade >= k) = 1 / (1 + exp(theta_k - w x)),  theta_1 < theta_2,

fitted by full-batch Adam on the negative log likelihood with an L2 term.
The fit uses at most MOST_LABELS labelled documents (by hash of doc_id), the
scores cover every whole text. A document is toxic where P(grade >= 1)
reaches the cut with the best F1 on held-out documents: each fifth of them
(by another hash of doc_id) is scored by a model of the other four. Rows
are put in one order before the fit, so that the model doesn't depend on
how the data are partitioned.

Defined results: null and empty texts have no features and get the base
rate's severity; repeated rows are scored alike, and each labelled one is a
row of the fit; labels without a document and labels with a null in either
column don't count, of repeated ones the largest does; without both classes
the severity is 0 and nothing is toxic; null doc_ids are carried through;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .common import buffers, dropped, pieces, staged, table, texts

MOST_LABELS, MOST_FEATURES = 20_000, 1024
HEADS = (0, 4, 5, 6)
LEAST_CHI2, LEAST_DOCS = 15.0, 3
GRADES, FOLDS = 3, 5


@dataclass
class Model:
    features: np.ndarray  # sorted uint64
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, np.inf))
    cut: float = 1.1

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..: one row for each linear score."""
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(self.thresholds[None, :] - x[:, None]))


def _cells(batch: pa.RecordBatch, lookup: textvec.Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, occurrences) of a batch, for known features."""
    hashes, starts = textvec.heads(*buffers(batch.column("raw")), HEADS, punctuation=False)
    owner, rows, width = textvec.owners(starts), [], max(1, len(lookup.keys))
    for h in hashes:
        at = lookup.find(h)
        hit = np.flatnonzero(at >= 0)
        rows.append(owner[hit] * width + at[hit])
    cell, n = np.unique(np.concatenate(rows), return_counts=True)
    return cell // width, cell % width, n


def sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """doc_id, raw and toxic of at most `most` labelled documents, chosen by hash."""
    one = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    few = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return texts(docs).join(F.broadcast(few), "doc_id")  # at most `most` rows


def chosen(rows: DataFrame) -> np.ndarray:
    """The features that tell toxic rows best, by chi-square."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "raw"):
            hashes, starts = textvec.heads(*buffers(batch.column("raw")), HEADS, punctuation=False)
            toxic, owner = batch.column("toxic").to_numpy() > 0, textvec.owners(starts)
            found, where = np.concatenate(hashes), np.tile(owner, len(HEADS))
            order = np.lexsort((where, found))
            found, where = found[order], where[order]
            new = np.ones(len(found), bool)
            new[1:] = (found[1:] != found[:-1]) | (where[1:] != where[:-1])
            found, where = found[new], where[new]
            keys, at = np.unique(found, return_inverse=True)
            n = np.bincount(at, minlength=len(keys))
            bad = np.bincount(at, toxic[where].astype(float), minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(bad)], ["feature", "n", "bad"])

    all_ = rows.agg(F.count("*"), F.sum("toxic")).first()
    n, bad = all_[0], all_[1] or 0
    if not bad or bad == n:
        return np.zeros(0, np.uint64)
    sums = rows.select("raw", "toxic").mapInArrow(run, "feature long, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    a, b = F.col("bad").cast("double"), (F.col("n") - F.col("bad")).cast("double")
    c, d = F.lit(float(bad)) - a, F.lit(float(n - bad)) - b
    chi2 = F.lit(float(n)) * F.pow(a * d - b * c, F.lit(2)) / ((a + b) * (c + d) * F.lit(float(bad) * (n - bad)))
    best = sums.filter((F.col("n") >= LEAST_DOCS) & (F.col("n") < n)).withColumn("chi2", chi2).filter(F.col("chi2") >= LEAST_CHI2)
    kept = best.orderBy(F.desc("chi2"), "feature").limit(MOST_FEATURES).collect()
    return np.sort(np.array([r["feature"] for r in kept], np.int64).view(np.uint64))


def fitted(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> Model:
    rows, path = staged(sample(docs, labels, most))
    features = chosen(rows)
    lookup = textvec.Lookup(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "raw"):
            doc, feature, n = _cells(batch, lookup)
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (feature.astype(np.int32), n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("place", "fold", "toxic")), *lists], ["place", "fold", "toxic", "at", "n"])

    placed = rows.select(F.xxhash64("doc_id").alias("place"), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold"), "raw", "toxic")
    got = placed.mapInArrow(run, "place long, fold int, toxic int, at array<int>, n array<int>").collect() if len(features) else []  # at most `most` documents
    dropped(docs.sparkSession, path)
    if not got:
        return Model(features)
    got.sort(key=lambda r: (r["place"], r["at"], r["n"], r["toxic"]))
    x, tf = Sparse.of([r["at"] for r in got], [r["n"] for r in got], len(features)), np.concatenate([r["n"] for r in got])
    toxic, folds = np.array([r["toxic"] > 0 for r in got]), np.array([r["fold"] for r in got])
    count = lambda which: np.bincount(x.columns, which[x.rows].astype(float), minlength=len(features)) / max(1, which.sum())
    marking = count(toxic) > 10 * count(~toxic)
    marked = np.bincount(x.rows, tf * marking[x.columns], minlength=len(got))
    grade = np.where(toxic, 1 + (marked > np.median(marked[toxic])), 0)
    p = np.zeros(len(got))
    for fold in np.unique(folds):
        fit, rest = np.flatnonzero(folds != fold), np.flatnonzero(folds == fold)
        if len(fit):
            own = ordinal(features, x.taken(fit), grade[fit])
            p[rest] = own.above(x.taken(rest).dot(own.weights))[:, 0]
    model = ordinal(features, x, grade)
    cuts = np.linspace(0.1, 0.9, 33)
    f1 = [2 * (toxic & (p >= c)).sum() / max(1, toxic.sum() + (p >= c).sum()) for c in cuts]
    best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
    model.cut = float(cuts[best[len(best) // 2]])
    return model


@dataclass
class Sparse:
    """A matrix of n rows by its filled cells, rows in order."""

    n: int
    width: int
    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, at: list, n: list, width: int) -> Sparse:
        """Row k has log(1 + n) in the columns at[k]."""
        rows = np.repeat(np.arange(len(at)), [len(x) for x in at])
        return cls(len(at), width, rows, np.concatenate([np.asarray(x, np.int64) for x in at]), np.log1p(np.concatenate([np.asarray(x, float) for x in n])))

    def taken(self, which: np.ndarray) -> Sparse:
        place = np.full(self.n, -1, np.int64)
        place[which] = np.arange(len(which))
        own = place[self.rows] >= 0
        return Sparse(len(which), self.width, place[self.rows[own]], self.columns[own], self.values[own])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.columns], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        """The transposed matrix by g."""
        return np.bincount(self.columns, self.values * g[self.rows], minlength=self.width)


def loss(w: np.ndarray, raw: np.ndarray, x: Sparse, grade: np.ndarray, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood with the L2 term, and its slopes by the weights and by raw (first threshold, logarithms of the gaps)."""
    n, gaps, rows = x.n, np.exp(raw[1:]), np.arange(x.n)
    theta = raw[0] + np.concatenate([[0], np.cumsum(gaps)])
    s = x.dot(w)
    p = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(theta[None, :] - s[:, None], -50, 50))), np.zeros((n, 1))], axis=1)
    slope = p * (1 - p)  # derivative of P(grade >= k) by the score
    own = np.maximum(p[rows, grade] - p[rows, grade + 1], 1e-12)
    by_score = -(slope[rows, grade] - slope[rows, grade + 1]) / own
    by_theta = np.zeros(GRADES + 1)
    np.add.at(by_theta, grade, slope[rows, grade] / own)
    np.add.at(by_theta, grade + 1, -slope[rows, grade + 1] / own)
    back = np.cumsum((by_theta[1:GRADES] / n)[::-1])[::-1]
    return float(-np.log(own).mean() + l2 / 2 * w @ w), x.back(by_score) / n + l2 * w, np.concatenate([back[:1], back[1:] * gaps])


def ordinal(features: np.ndarray, x: Sparse, grade: np.ndarray, steps: int = 400, l2: float = 1e-4, rate: float = 0.1) -> Model:
    """Fit shared weights and ordered thresholds (the first, then positive gaps as exponentials)."""
    share = np.array([(grade >= k).mean() for k in range(1, GRADES)]).clip(1e-4, 1 - 1e-4)
    start = np.log((1 - share) / share)
    at = np.concatenate([np.zeros(x.width), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros(len(at)), np.zeros(len(at))
    for step in range(1, steps + 1):
        _, *slopes = loss(at[: x.width], at[x.width :], x, grade, l2)
        g = np.concatenate(slopes)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        at = at - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, raw = at[: x.width], at[x.width :]
    return Model(features, w, raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_severity (0 to GRADES - 1), grade (the likeliest), p_toxic, toxic."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        lookup = textvec.Lookup(own.features)
        for batch in pieces(batches, "raw"):
            score = np.zeros(batch.num_rows)
            if len(own.features):
                doc, feature, n = _cells(batch, lookup)
                score = np.bincount(doc, own.weights[feature] * np.log1p(n), minlength=batch.num_rows)
            above = own.above(score)
            each = -np.diff(np.concatenate([np.ones((len(score), 1)), above, np.zeros((len(score), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(above.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= own.cut)],
                ["doc_id", "expected_severity", "grade", "p_toxic", "toxic"],
            )

    return texts(docs).mapInArrow(run, f"doc_id {kind}, expected_severity double, grade int, p_toxic double, toxic boolean")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
