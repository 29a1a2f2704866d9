"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every document becomes a short vector of statistics of its whole text. Each class is a Gaussian whose covariance is
shrunk towards a scaled identity; a document's score is the logistic of the difference of the two log densities
(Mahalanobis terms from Cholesky factors computed once) plus the log prior odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrain.llm.common import LOWER, byte_class, small_batches, spans_hash, text_pieces, words_of

_SPACE = byte_class((9, 13), (32, 32))
_WORD = ~_SPACE
_CLASSES = {
    "upper": byte_class((65, 90)),
    "digit": byte_class((48, 57)),
    "stop": byte_class((33, 33), (44, 44), (46, 46), (63, 63)),
    "symbol": byte_class((33, 33), (35, 38), (42, 43), (60, 62), (64, 64), (92, 92), (94, 96), (123, 126)),
    "line": byte_class((10, 10)),
    "letter": byte_class((65, 90), (97, 122), (128, 255)),
}
STATISTICS = (
    "log_words", "log_word_length", "upper", "digit", "sentence_marks", "symbols", "letters", "words_with_symbol",
    "repeated_neighbours", "distinct_words", "shouted_words", "log_line_words",
)
#: Labelled rows used to fit; a uniform hash sample beyond it. Scoring, counts and statistics always see all rows.
FIT_ROWS = 2_000_000
SHRINKAGE = 0.1
#: Least score of a document that is kept.
ACCEPTED = 0.7


def _share(hit: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A share with its variance stabilised: the arc sine of its root; 0 of nothing is 0."""
    return np.arcsin(np.sqrt(np.clip(hit / np.maximum(of, 1), 0, 1)))


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x statistics of the documents at ``offsets``."""
    starts, ends, first = words_of(data, offsets, _WORD)
    words = np.diff(first).astype(float)
    row = np.repeat(np.arange(len(words)), np.diff(first))
    count = {}
    for name, mark in _CLASSES.items():
        running = np.concatenate(([0], np.cumsum(mark[data], dtype=np.int64)))
        count[name] = np.diff(running[offsets]).astype(float)
        if name in ("symbol", "upper"):
            count[name + " in word"] = running[ends] - running[starts]
    size = (ends - starts).astype(float)
    inside = np.bincount(row, size, len(words))
    h = spans_hash(LOWER[data], starts, ends)
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    if len(h) > 1:
        new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=len(words)).astype(float)
    per_row = lambda flag: np.bincount(row, flag, len(words))
    return np.column_stack(
        [
            np.log1p(words),
            np.log1p(inside / np.maximum(words, 1)),
            _share(count["upper"], inside),
            _share(count["digit"], inside),
            _share(count["stop"], inside),
            _share(count["symbol"], inside),
            _share(count["letter"], inside),
            _share(per_row((count["symbol in word"] > 0).astype(float)), words),
            _share(per_row(same), words),
            # the share of distinct words falls with length by itself: take it relative to the square root of the length
            np.log((distinct + 1) / np.sqrt(words + 1)) - 0.25 * np.log1p(words),
            _share(per_row((count["upper in word"] * 2 > size).astype(float)), words),
            np.log1p(words / (count["line"] + 1)),
        ]
    )


def with_statistics(df: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    """``df`` with an array column of the statistics of each whole text; null counts as empty. ``out`` must be free."""
    small_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [_statistics(data, offsets) for _, _, data, offsets in text_pieces(b.column(b.schema.names.index(text)))]
            x = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
            arr = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(STATISTICS), dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, arr], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class Discriminant:
    """A fitted model: per class (0, 1) mean, Cholesky factor of the shrunk covariance and log prior."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_prior: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        z = (x - self.centre) / self.scale
        density = []
        for mean, factor, prior in zip(self.means, self.factors, self.log_prior, strict=True):
            y = np.linalg.solve(factor, (z - mean).T)
            density.append(prior - np.log(np.diag(factor)).sum() - 0.5 * (y * y).sum(axis=0))
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(labelled: DataFrame, label: str, statistics: str = "statistics", shrinkage: float = SHRINKAGE) -> Discriminant:
    """Fit on rows with label 0 or 1 (others are ignored), from one aggregation of sums of products.

    Without any row of a class that class gets the
    other one's shape and almost no prior weight; without any rows the score is one half everywhere.
    """
    d = len(STATISTICS)
    rows = labelled.where(F.col(label).isin(0, 1))
    schema = "cls int, n long, s array<double>, p array<double>"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {0: [0, np.zeros(d), np.zeros((d, d))], 1: [0, np.zeros(d), np.zeros((d, d))]}
        for b in batches:
            x = np.array(b.column(0).flatten()).reshape(-1, d)
            y = np.array(b.column(1))
            for c, t in total.items():
                own = x[y == c]
                t[0] += len(own)
                t[1] += own.sum(axis=0)
                t[2] += own.T @ own
        yield pa.RecordBatch.from_pydict(
            {"cls": pa.array(total, pa.int32()), "n": [t[0] for t in total.values()], "s": [t[1] for t in total.values()], "p": [t[2].ravel() for t in total.values()]}
        )

    partial = rows.select(statistics, F.col(label).cast("int").alias("cls")).mapInArrow(sums, schema)
    flat = partial.select("cls", "n", F.posexplode(F.concat("s", "p")).alias("at", "value"))
    got = flat.groupBy("cls", "at").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).collect()
    counts, first, second = np.zeros(2), np.zeros((2, d)), np.zeros((2, d * d))
    for r in got:
        counts[r["cls"]] = r["n"]
        (first if r["at"] < d else second)[r["cls"], r["at"] - (0 if r["at"] < d else d)] = r["value"]
    second = second.reshape(2, d, d)
    total = max(counts.sum(), 1)
    centre = first.sum(axis=0) / total
    scale = np.sqrt(np.maximum(np.diag(second.sum(axis=0)) / total - centre**2, 0)) if counts.sum() else np.ones(d)
    scale = np.where(scale > 1e-9, scale, 1.0)
    means, factors = np.zeros((2, d)), np.zeros((2, d, d))
    for c in (0, 1):
        k = c if counts[c] else 1 - c
        n_k = max(counts[k], 1)
        mean = first[k] / n_k
        cov = (second[k] / n_k - np.outer(mean, mean)) / np.outer(scale, scale)
        level = max(np.trace(cov) / d, 1e-3)
        factors[c] = np.linalg.cholesky((1 - shrinkage) * cov + shrinkage * level * np.eye(d))
        means[c] = (mean - centre) / scale
    return Discriminant(centre, scale, means, factors, np.log((counts + 1) / (counts.sum() + 2)))


def score(df: DataFrame, model: Discriminant, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability of good quality of each whole text; ``out`` must be a free name.

    Null and empty texts are scored as empty.
    """
    small_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [model.scores(_statistics(data, offsets)) for _, _, data, offsets in text_pieces(b.column(b.schema.names.index(text)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=schema.names)

    return df.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels are never used to fit: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Discriminant:
    """Fit on the labelled documents outside the held-out fold. Labels are joined by doc_id and reach nothing else.

    ``fit_rows`` bounds the labelled rows used: beyond it a uniform sample by a hash of the id.
    """
    chosen = labels.where(~held_out()).where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("label"))
    n = labels.count()
    if n > fit_rows:
        chosen = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * fit_rows / n)))
    rows = docs.select("doc_id", "text").where(~held_out())
    rows = with_statistics(rows, "text", "statistics").select("doc_id", "statistics").join(chosen, "doc_id")
    return fit(rows, "label")
