"""Token counts by a two-tier lookup of pre-token lengths on the map side."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_MARK = "▁"  # the model writes a space so
RUNS = re.compile(r" +[^ ]*")


class PieceLengths(dict):
    """Number of pieces of each pre-token: a run of spaces and the word behind it, less the one space that the model puts
    before every text. Pieces never hold a space behind another character, so lengths of pre-tokens add up to the text's.

    Starts with the broadcast table; misses are encoded and kept in the worker up to a bound, then that tier starts anew.
    """

    def __init__(self, model_file: str, known: dict[str, int], bound: int = 500_000, longest: int = 64):
        import sentencepiece

        super().__init__(known)
        self.known, self.bound, self.longest = known, bound + len(known), longest
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError("the model has pieces that reach over a space; pre-token lengths don't add up")
        self.lines = not any("\n" in p for p in pieces)

    def __missing__(self, rest: str) -> int:
        if self.lines and "\n" in rest[1:]:
            # no piece holds a line feed either, and it is encoded as one byte piece
            first, *more = rest.split("\n")
            n = (self[first] if first else 1) + sum(self["\n" + x] - 1 for x in more)
        else:
            n = len(self.model.encode(rest)) if rest else 1
        if len(rest) <= self.longest:
            if len(self) >= self.bound:
                self.clear()
                self.update(self.known)
            self[rest] = n
        return n

    def of(self, text: str) -> int:
        return sum(map(self.__getitem__, pre_tokens(text))) if text else 0


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text that isn't empty, each without the space that every text starts with or that parts it."""
    if SPACE_MARK in text:
        text = text.replace(SPACE_MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [x[1:] for x in RUNS.findall(" " + text)]


def frequent_pre_tokens(texts: DataFrame, per_task: int = 8192, size: int = 32_768, fan_in: int = 32) -> list[str]:
    """The most frequent pre-tokens of all texts, from summaries of at most per_task entries that tasks merge in rounds of
    fan_in; what reaches the driver is bounded by fan_in * per_task entries, whatever the size of the input."""

    def summary(counts: Counter) -> Iterator[pa.RecordBatch]:
        top = counts.most_common(per_task)
        if top:
            yield pa.RecordBatch.from_pydict({"pre": [x for x, _ in top], "n": pa.array([n for _, n in top], type=pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                if text := text.as_py():
                    counts.update(pre_tokens(text))
                if len(counts) > 16 * per_task:
                    counts = Counter(dict(counts.most_common(4 * per_task)))
        for pre in [x for x in counts if len(x) > 64]:
            del counts[pre]
        yield from summary(counts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for pre, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[pre] += n
            if len(counts) > 16 * per_task:
                counts = Counter(dict(counts.most_common(4 * per_task)))
        yield from summary(counts)

    parts = texts.rdd.getNumPartitions()
    found = texts.mapInArrow(count, "pre string, n long")
    while parts > fan_in:
        parts = -(-parts // fan_in)
        found = found.repartition(parts).mapInArrow(merge, "pre string, n long")
    total: Counter = Counter()
    for pre, n in found.collect():
        total[pre] += n
    return [x for x, _ in total.most_common(size)]


def count_tokens(
    docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, frequent: int = 32_768
) -> DataFrame:
    """Tokens of every whole text as the sentencepiece model gives them, without begin or end tokens.

    A first pass finds the frequent pre-tokens, whose lengths go to the tasks as one broadcast table of at most `frequent`
    entries; a second looks every pre-token up there or in the worker's cache and encodes the misses. No pre-token is
    shuffled. The table decides the speed only, never a count.

    Returns id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). Null and empty texts have 0 bytes and tokens;
    rows with a null or repeated id are counted like all others; an empty table gives no rows.
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    known = PieceLengths(model_file, {})
    table = {pre: known[pre] for pre in frequent_pre_tokens(source.select("text"), size=frequent)}
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = PieceLengths(model_file, shared.value)
        for batch in batches:
            sizes = pa.array([lengths.of(x.as_py()) for x in batch.column(2)], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes], names=["doc_id", "n_bytes", "n_tokens"])

    counted = source.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text").mapInArrow(
        count, f"doc_id {kind}, n_bytes long, n_tokens long"
    )
    return counted.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
