"""Quality scores by regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .words import release

MARKS = b"!#$%&*+<=>@^_`{|}~\\/"
_NO_UPPER = bytes(range(65, 91))
_NO_DIGIT = b"0123456789"


def document_statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text: shares under a square root, counts and ratios under a logarithm."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * 14
    share = lambda k, of: (k / (of + (60 if of > n else 10))) ** 0.5  # noqa: E731  a short text's shares stay small
    letters = size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    upper = size - len(raw.translate(None, _NO_UPPER))
    marks = size - len(raw.translate(None, MARKS))
    stops = raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")
    low = raw.lower().split()
    distinct = len(set(low))
    repeats = sum(map(bytes.__eq__, low, low[1:]))
    pairs = len(set(zip(low, low[1:], strict=False))) if n > 1 else 1
    lines = raw.split(b"\n")
    length = size / n
    return [
        np.log(n + 20),
        np.log((size + 60) / (n + 10)),
        share(upper, max(1, letters)),
        share(marks, size),
        share(raw.count(b"|"), n),
        share(raw.count(b"!"), n),
        share(repeats, n),
        np.log(distinct / n),
        np.log(pairs / max(1, n - 1)),
        share(stops, n),
        share(raw.count(b","), n),
        share(size - len(raw.translate(None, _NO_DIGIT)), size),
        ((len(lines) - len(set(lines))) / (len(lines) + 3)) ** 0.5,
        np.log(n / len(lines) + 10),
    ]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): each row's statistics, from the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [document_statistics(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Qda:
    """Two Gaussian classes with shrunk covariances and cached Cholesky factors."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]

    @classmethod
    def fit(cls, sums: dict[int, tuple[int, np.ndarray, np.ndarray]], shrinkage: float = 0.1, floor: float = 1e-3) -> Qda:
        """sums: per class the number of rows, their sum, and the sum of their outer products.

        A class's covariance is drawn by ``shrinkage`` towards the pooled
        covariance's diagonal; no variance is below ``floor`` times it.
        """
        total = sum(n for n, _, _ in sums.values())
        mean = sum(s for _, s, _ in sums.values()) / total
        pooled = np.maximum(np.diag(sum(q for _, _, q in sums.values())) / total - mean**2, 1e-9)
        means, factors, offsets = [], [], []
        for c in (0, 1):
            n, s, q = sums[c]
            m = s / n
            cov = (1 - shrinkage) * (q / n - np.outer(m, m)) + np.diag((shrinkage + floor) * pooled)
            factor = np.linalg.cholesky(cov)
            means.append(m)
            factors.append(factor)
            offsets.append(float(np.log(n / total) - np.log(np.diag(factor)).sum()))
        return cls(means, factors, offsets)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1: the logistic of the difference of the classes' log densities."""
        log = [o - 0.5 * (np.linalg.solve(f, (x - m).T) ** 2).sum(axis=0) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def held_out(id_col: str, modulus: int):
    """Whether a row is kept from learning: crc32 of the id as text is divisible by ``modulus``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == 0


def fit(rows: DataFrame, shrinkage: float = 0.1) -> Qda | None:
    """Learns from (x, y) rows, all of them; None unless either class has two rows.

    Tasks add up moments by batch; only one sum per class and moment, in
    number fixed by the statistics, goes to the driver.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, own in b.groupby("y"):
                x = np.stack(own["x"].to_numpy())
                flat = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                yield pd.DataFrame({"y": int(c), "k": np.arange(len(flat)), "v": flat})

    got = rows.mapInPandas(moments, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).collect()
    sums = {}
    for c in (0, 1):
        v = np.asarray([r["v"] for r in sorted((r for r in got if r["y"] == c), key=lambda r: r["k"])])
        if not len(v) or v[0] < 2:
            return None
        d = int((np.sqrt(4 * len(v) - 3) - 1) // 2)
        sums[c] = (int(v[0]), v[1 : d + 1], v[d + 1 :].reshape(d, d))
    return Qda.fit(sums, shrinkage)


def teachers(labels: DataFrame, sample: int, modulus: int, id_col: str, label_col: str) -> DataFrame:
    """(doc_id, y): distinct labels 0 and 1 of ids that are not held out; beyond ``sample`` of them about that many, by a hash of the id."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").where(~held_out("doc_id", modulus)).distinct()
    n = known.count()
    return known if n <= sample else known.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(n)) < sample)


def score_quality(docs: DataFrame, labels: DataFrame, shrinkage: float = 0.1, threshold: float = 0.3, modulus: int = 5, sample: int = 100_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Learns from the rows of labelled ids that are not held out (see held_out);
    of over ``sample`` such labels from about that many, chosen by a hash of
    the id. That bound makes the labels small enough to go to all tasks. Scores
    use the text's statistics alone, which are computed once and written to the
    shared folder; texts are never shuffled.

    Texts of any length count whole. Null and empty texts have all statistics 0
    and a score. Null labels and
    labels other than 0 and 1 teach nothing; without two rows of either class
    every score is 0.5. Null ids are not held out and match no label. Repeated
    rows come back repeated and teach each; repeated labels count once. Other
    columns are ignored. An empty table gives an empty result.
    """
    own = materialise(statistics(docs, id_col, text_col), "statistics")
    model = fit(own.join(F.broadcast(teachers(labels, sample, modulus, id_col, label_col)), "doc_id").select("y", "x"), shrinkage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 1))
            s = model.score(x) if model and n else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = own.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out("doc_id", modulus), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, shrinkage: float = 0.1, threshold: float = 0.3, modulus: int = 5, sample: int = 100_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the classifier of score_quality predicts to be good, all columns as they were.

    Rows that teach are picked by id before their statistics are computed;
    texts are scored where they are, so they are not shuffled. Without enough
    labels to learn from every row stays. Null, empty and repeated texts, null
    ids and odd labels are treated as in score_quality: each row stays or goes
    by its own text. An empty table gives an empty result.
    """
    known = teachers(labels, sample, modulus, id_col, label_col)
    learn = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_semi")
    model = fit(statistics(learn).join(F.broadcast(known), "doc_id").select("y", "x"), shrinkage)
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray([document_statistics(t.as_py()) for t in b.column(at)])
                yield b.filter(pa.array(model.score(x) >= threshold))
        release()

    return docs.mapInArrow(run, docs.schema)
