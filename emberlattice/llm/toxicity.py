"""Toxicity by multiple-instance learning: sentences are scored, noisy-or makes document scores of them, and document labels teach."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlattice.scratch import Scratch, small_batches

#: Sentences end at these bytes; other bytes that belong to no word part words. ASCII letters and all bytes of other characters make words.
ENDS = b".!?\n"
BYTES = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 10 if b in ENDS else 32 for b in range(256))
#: Characters of the beginnings of words that count as features beside the whole word.
PREFIXES = (4, 5, 6, 7, 8)
#: Words that a worker remembers, features that a task tallies before it hands them on, files of the taught texts.
MEMORY, TALLY, FILES = 200_000, 400_000, 16


def sentences(text: str | None) -> list[list[bytes]]:
    """The words of each sentence that has any."""
    if not text:
        return []
    return [words for s in text.lower().encode().translate(BYTES).split(b"\n") if (words := s.split())]


def features(word: bytes) -> list[str]:
    w = word.decode(errors="replace")
    return [w, *(f"{w[:k]}~" for k in PREFIXES if len(w) > k)]


class Remembered(dict):
    """What `of` makes of a word, kept up to a bound."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, word: bytes):
        if len(self) >= MEMORY:
            self.clear()
        out = self[word] = self.of(word)
        return out


@dataclass
class Instances:
    """A sentence's log odds are the bias and the weights of its words' features. A document is toxic unless none of its sentences is: its score is
    1 - prod(1 - p). Without weights to learn from (constant is set), every document with a sentence has the score `constant`."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    constant: float | None = None

    def word(self, word: bytes) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def odds(self, words: list[bytes], known: Remembered) -> float:
        return self.bias + sum(map(known.__getitem__, words))

    def document(self, text: str | None, known: Remembered) -> tuple[float, int, int | None, float | None]:
        """Score, number of sentences, place of the worst one (the first of equals) and its own score."""
        found = sentences(text)
        if not found or self.constant is not None:
            return (self.constant if found else 0.0), len(found), None, None
        odds = [self.odds(words, known) for words in found]
        none = sum(map(softplus, odds))
        worst = max(odds)
        return -math.expm1(-none), len(odds), odds.index(worst), sigmoid(worst)


def softplus(z: float) -> float:
    return z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def tallied(taught: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents of either label that hold each feature."""

    def emit(found: tuple[Counter, Counter]) -> pa.RecordBatch:
        names = list(found[0] | found[1])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in found[::-1])], names=["feature", "toxic", "clean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = Remembered(features), (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = {w for s in sentences(text.as_py()) for w in s}
                found[y].update({f for w in words for f in known[w]})
                if len(found[0]) + len(found[1]) >= TALLY:
                    yield emit(found)
                    found = (Counter(), Counter())
        if found[0] or found[1]:
            yield emit(found)

    return taught.mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def telling(counts: DataFrame, toxic: int, clean: int, most: int, least: int) -> list[str]:
    """The `most` features, of those in at least `least` documents, whose presence tells most about the label (likelihood ratio of independence)."""
    both = F.col("toxic") + F.col("clean")
    cell = lambda k, n: F.when(k > 0, k * F.log(k / n)).otherwise(0.0)
    ratio = cell(F.col("toxic"), toxic) + cell(toxic - F.col("toxic"), toxic) + cell(F.col("clean"), clean) + cell(clean - F.col("clean"), clean)
    ratio = ratio - cell(both, toxic + clean) - cell(toxic + clean - both, toxic + clean)
    best = counts.filter(both >= least).select("feature", F.round(ratio, 6).alias("ratio")).orderBy(F.col("ratio").desc(), "feature").limit(most)
    return [r["feature"] for r in best.collect()]


def bags(taught: DataFrame, place: dict[str, int]) -> DataFrame:
    """(y, n, sentence, feature): a document's number of sentences, and for each telling feature that occurs its sentence and its place, as packed int32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(lambda word: [place[f] for f in features(word) if f in place])
        for batch in batches:
            rows: list[tuple] = []
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = sentences(text.as_py())
                pairs = np.array([(i, f) for i, words in enumerate(found) for w in words for f in known[w]], dtype=np.int32).reshape(-1, 2)
                rows.append((y, len(found), pairs[:, 0].tobytes(), pairs[:, 1].tobytes()))
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["y", "n", "sentence", "feature"])

    return taught.mapInArrow(run, "y int, n int, sentence binary, feature binary")


def slope(y: np.ndarray, n: np.ndarray, sentence: np.ndarray, feature: np.ndarray, weights: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
    """Sums over documents: negative log likelihood of the labels under noisy-or, and its slope by weights and bias. sentence counts over all documents,
    whose n sentences follow each other."""
    total = int(n.sum())
    z = bias + np.bincount(sentence, weights=weights[feature], minlength=total)
    owner = np.repeat(np.arange(len(n)), n)
    none = np.bincount(owner, weights=np.logaddexp(0, z), minlength=len(n))
    some = np.maximum(-np.expm1(-none), 1e-12)
    pull = np.where(y == 1, -np.exp(-none) / some, 1.0)
    dz = pull[owner] * np.exp(z - np.logaddexp(0, z))
    loss = float(np.where(y == 1, -np.log(some), none).sum())
    return loss, np.bincount(feature, weights=dz[sentence], minlength=len(weights)), float(dz.sum())


def slopes(table: DataFrame, weights: np.ndarray, bias: float) -> np.ndarray:
    """Loss, slope by the weights and slope by the bias, summed over all documents: a task sends one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(weights) + 2)
        for batch in batches:
            y, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            own, feature = ([np.frombuffer(x.as_py(), dtype=np.int32) for x in batch.column(i)] for i in (2, 3))
            sentence = np.concatenate(own).astype(np.int64) + np.repeat(np.cumsum(n) - n, [len(x) for x in own])
            loss, by_weight, by_bias = slope(y, n, sentence, np.concatenate(feature), weights, bias)
            total += np.concatenate([[loss], by_weight, [by_bias]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return np.sum([np.frombuffer(r["sums"]) for r in table.mapInArrow(run, "sums binary").collect()], axis=0)


def fit(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str, text_col: str, label_col: str, most: int = 20_000, n_features: int = 4096, rounds: int = 40, ridge: float = 2e-4
) -> Instances:
    """Learns from at most `most` labelled rows, those whose ids have the smallest hashes, with the whole texts of docs.

    Features are words and beginnings of words; the n_features whose presence tells most about the label get weights. Each round's slope is
    summed by Spark over the taught documents' packed features (a row of fixed size from each of at most FILES tasks), the step (Adam) is the
    driver's. Null labels or ids teach nothing; repeated labels count each. Without rows of both classes every
    document with a sentence has the smoothed share of label 1 as its score."""
    own = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    taken = own.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(taken), "doc_id").select("text", "y")
    taught = scratch.keep(texts.repartition(FILES), "taught")
    toxic, clean = (sum(r["count"] for r in rows if r["y"] == y) for rows in [taught.groupBy("y").count().collect()] for y in (1, 0))
    share = (toxic + 1) / (toxic + clean + 2)
    if not toxic or not clean:
        return Instances(constant=share)
    place = {f: i for i, f in enumerate(telling(tallied(taught), toxic, clean, n_features, least=4))}
    table = scratch.keep(bags(taught, place).repartition(FILES), "bags")
    scratch.drop("taught")
    per_doc = (table.agg(F.sum("n")).first()[0] or 0) / (toxic + clean)
    w = np.append(np.zeros(len(place)), math.log(share / max(per_doc, 1)))
    first, second = np.zeros(len(w)), np.zeros(len(w))
    for k in range(1, rounds + 1):
        g = slopes(table, w[:-1], float(w[-1]))[1:] / (toxic + clean)
        g[:-1] += ridge * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w - 0.3 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    scratch.drop("bags")
    return Instances({f: float(w[i]) for f, i in place.items()}, float(w[-1]))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are kept for measuring: crc32 of the id as text, modulo 4, is 2 (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **more) -> Instances:
    """The model that rows teach which aren't held out."""
    small_batches(docs.sparkSession)
    return fit(docs, labels.filter(~held_out(labels[id_col])), Scratch(docs.sparkSession, "toxicity"), id_col, text_col, label_col, **more)


def score_documents(docs: DataFrame, model: Instances, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score, predicted (1 if score >= threshold), n_sentences, and the worst sentence's place (from 0) and own score, of every document.

    Null and empty texts, and texts without words, have no sentence and the score 0; null or repeated ids keep a row each; an empty table gives no
    rows; other columns are left aside."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Instances = shared.value
        known = Remembered(m.word)
        for batch in batches:
            rows = [m.document(t.as_py(), known) for t in batch.column(1)]
            types = [pa.float64(), pa.int64(), pa.int64(), pa.float64()]
            arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "score", "n_sentences", "worst_sentence", "worst_score"])

    scored = source.mapInArrow(run, f"doc_id {kind}, score double, n_sentences long, worst_sentence long, worst_score double")
    return scored.select(
        F.col("doc_id").alias(id_col), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "worst_sentence", "worst_score"
    )


def locate(docs: DataFrame, model: Instances, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, sentence, begin, end, text, score): the sentences whose own score reaches the threshold, as stretches of characters of their whole
    texts (begin from 0, end after the last; the sentence's mark isn't part of it)."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Instances = shared.value
        known = Remembered(m.word)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text, at, begin = text.as_py() or "", 0, 0
                for part in text.translate({ord(c): "\n" for c in ENDS.decode()}).split("\n") if m.constant is None else []:
                    if words := [w for s in sentences(part) for w in s]:
                        score = sigmoid(m.odds(words, known))
                        if score >= threshold:
                            rows.append((key, at, begin, begin + len(part), text[begin : begin + len(part)], score))
                        at += 1
                    begin += len(part) + 1
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "sentence", "begin", "end", "text", "score"])

    found = source.mapInArrow(run, f"doc_id {kind}, sentence long, begin long, end long, text string, score double")
    return found.withColumnRenamed("doc_id", id_col)
