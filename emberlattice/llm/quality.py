"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlattice.scratch import small_batches

FEATURES = [
    "log_bytes", "log_words", "mean_word", "distinct", "top_word", "repeats", "upper", "symbols", "digits", "stops", "bars", "shouts", "line_words",
    "repeated_lines", "beyond_ascii", "long_words",
]
UPPER = bytes(range(0x41, 0x5B))
DIGITS = bytes(range(0x30, 0x3A))
SYMBOLS = b"#$%&*+/<=>@\\^_`{}~[]"
STOPS = b".,;:?"
ASCII = bytes(range(0x80))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, in the order of FEATURES; all zero for a null, empty or blank one."""
    raw = text.encode() if text else b""
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = sum(map(len, words))

    def share(of: bytes) -> float:
        return (size - len(raw.translate(None, of))) / letters

    repeats = sum(map(bytes.__eq__, words[1:], words))
    return [
        math.log1p(size),
        math.log1p(n),
        math.log1p(letters / n),
        math.sqrt(len(counts) / n) * math.log1p(n) / 8,
        math.sqrt(max(counts.values()) / n),
        math.sqrt(repeats / n),
        math.sqrt(share(UPPER)),
        math.sqrt(share(SYMBOLS)),
        math.sqrt(share(DIGITS)),
        math.sqrt(share(STOPS)),
        math.sqrt(raw.count(b"|") / n),
        math.sqrt(raw.count(b"!") / n),
        math.log1p(n / len(lines)),
        math.sqrt(1 - len(set(lines)) / len(lines)),
        math.sqrt(len(raw.translate(None, ASCII)) / letters),
        math.sqrt(sum(len(w) > 24 for w in counts) / len(counts)),
    ]


def features(texts) -> np.ndarray:
    """A row of statistics for each text."""
    return np.array([statistics(t.as_py()) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass
class Discriminant:
    """Two Gaussians with shrunk covariances: for each class mean, inverse Cholesky factor, log density constant with prior."""

    centre: np.ndarray
    scale: np.ndarray
    classes: list[tuple[np.ndarray, np.ndarray, float]]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        if not self.classes:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        logs = []
        for mean, factor, constant in self.classes:
            y = (z - mean) @ factor.T
            logs.append(constant - 0.5 * np.einsum("ij,ij->i", y, y))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", shrinkage: float = 0.1, most: int = 50_000
) -> Discriminant:
    """Fits on at most `most` labelled rows, those whose ids have the smallest hashes, with the whole texts of docs. The labels taken are
    broadcast (16 bytes each), so only these texts are looked at and nothing but their moments is shuffled: tasks reduce them to counts, sums
    and products a class, a fixed number of numbers. Class covariances are drawn towards the pooled one and that towards its mean
    variance. Null labels or ids teach nothing; repeated labels count each; without rows of both classes every score is the smoothed share of
    label 1."""
    own = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    taken = own.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(taken), "doc_id").select("text", "y")
    d = len(FEATURES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = features(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                part = x[y == c]
                total[c] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).reshape(-1)])
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1))], names=["at", "v"])

    sums = texts.mapInArrow(moments, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(2 * (1 + d + d * d))
    for r in sums:
        total[r["at"]] = r["v"]
    total = total.reshape(2, -1)
    counts = total[:, 0]
    prior = (counts[1] + 1) / (counts.sum() + 2)
    if counts.min() < 2:
        return Discriminant(np.zeros(d), np.ones(d), [], float(prior))
    centre = total[:, 1 : 1 + d].sum(axis=0) / counts.sum()
    second = total[:, 1 + d :].sum(axis=0).reshape(d, d) / counts.sum() - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(second), 1e-12))
    covariances, means = [], []
    for c in (0, 1):
        mean = total[c, 1 : 1 + d] / counts[c]
        cov = total[c, 1 + d :].reshape(d, d) / counts[c] - np.outer(mean, mean)
        means.append((mean - centre) / scale)
        covariances.append(cov / np.outer(scale, scale))
    pooled = (counts[0] * covariances[0] + counts[1] * covariances[1]) / counts.sum()
    classes = []
    for c in (0, 1):
        cov = (1 - shrinkage) * covariances[c] + shrinkage * pooled
        cov = (1 - shrinkage) * cov + shrinkage * max(np.trace(cov) / d, 1e-6) * np.eye(d)
        lower = np.linalg.cholesky(cov)
        classes.append((means[c], np.linalg.inv(lower), math.log(counts[c] / counts.sum()) - float(np.log(np.diag(lower)).sum())))
    return Discriminant(centre, scale, classes, float(prior))


def held_out(doc_id) -> F.Column:
    """Rows whose labels are kept for measuring: crc32 of the id as text, modulo 5, is 0 (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id_col, held_out, score and predicted (1 if score >= threshold) of every document, learned from labels of rows that
    aren't held out.

    Null and empty texts have all statistics zero and a score; null or repeated ids keep a row each; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    model = fit(docs, labels.filter(~held_out(labels[id_col])), id_col, text_col)
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(features(batch.column(1))))], names=["doc_id", "score"])

    scored = source.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        F.col("doc_id").alias(id_col), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is at least the threshold. Scores come from the text where it is
    read. Null and empty texts are scored like all others; rows with null or repeated ids are judged by their own text."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels.filter(~held_out(labels[id_col])), id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(features(batch.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
