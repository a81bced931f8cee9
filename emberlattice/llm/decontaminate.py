"""Benchmark decontamination: a prefix-filtered set join of item windows with documents."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlattice.scratch import Scratch

#: Bytes of words (after A-Z became lower case): digits, letters and everything beyond ASCII.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SHINGLE = 3


def bench_words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text whose A-Z became lower case; none for null."""
    return text.encode().lower().translate(WORD_BYTES).split() if text else []


class Windows:
    """The windows of a block of items, and which shingle of each has to be looked up.

    A window is `width` consecutive words of an item, or the whole of a shorter one. Its set is its shingles of up to
    three words. A document range holds the window only if it holds all of these, so of the shingles ordered by rarity a
    prefix of one is enough: required containment n of n leaves n - n + 1 = 1.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[str | None] = []
        number: dict[tuple[int, ...], int] = {}
        owners: dict[int, set[int]] = defaultdict(set)
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in bench_words(text)]
            if not words:
                continue
            own = len(self.items)
            self.items.append(item)
            for i in range(max(1, len(words) - width + 1)):
                owners[number.setdefault(tuple(words[i : i + width]), len(number))].add(own)
        if len(self.vocabulary) + 1 >= 1 << 21:
            raise ValueError("a block of items has over 2^21 different words: ask for smaller block_bytes")
        self.length = np.array([len(w) for w in number], dtype=np.int64)
        self.words = np.zeros((len(number), width), dtype=np.int64)
        for i, w in enumerate(number):
            self.words[i, : len(w)] = w
        self.owners = [sorted(owners[i]) for i in range(len(number))]
        shingles: dict[tuple[int, ...], int] = {}
        self.places: list[list[tuple[int, int]]] = []  # of each window: shingle, offset
        for w in number:
            k = min(SHINGLE, len(w))
            self.places.append([(shingles.setdefault(w[o : o + k], len(shingles)), o) for o in range(len(w) - k + 1)])
        self.tables = {}  # by shingle length: sorted codes, shingle numbers
        for k in range(1, SHINGLE + 1):
            own = [(self.codes(np.array([s]))[0], n) for s, n in shingles.items() if len(s) == k]
            if own:
                own.sort()
                self.tables[k] = np.array([c for c, _ in own], dtype=np.int64), np.array([n for _, n in own], dtype=np.int64)
        self.n_shingles = len(shingles)

    def codes(self, columns: np.ndarray) -> np.ndarray:
        """Exact codes of shingles given as rows of word numbers; below 2^21 words they need 63 bits at most."""
        out = np.zeros(len(columns), dtype=np.int64)
        for j in range(columns.shape[1]):
            out = out * (len(self.vocabulary) + 1) + columns[:, j]
        return out

    def prefixes(self, frequency: dict[int, int]) -> None:
        """Orders each window's shingles by rarity and keeps the one that has to be joined."""
        entries: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for w, places in enumerate(self.places):
            shingle, offset = min(places, key=lambda p: (frequency.get(p[0], 0), p[0], p[1]))
            entries[shingle].append((w, offset))
        self.places = []
        for k, (codes, numbers) in self.tables.items():
            kept = np.array([int(n) in entries for n in numbers], dtype=bool)
            own = [entries[int(n)] for n in numbers[kept]]
            starts = np.cumsum([0, *map(len, own)])
            flat = np.array([e for x in own for e in x], dtype=np.int64).reshape(-1, 2)
            self.tables[k] = codes[kept], starts, flat[:, 0], flat[:, 1]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))

    def joined(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of a document and the index of the table's shingle that stands there, by shingle length."""
        for k, table in self.tables.items():
            if len(ids) >= k and len(table[0]):
                rows = np.stack([ids[j : len(ids) - k + 1 + j] for j in range(k)], axis=1)
                known = np.flatnonzero((rows > 0).all(axis=1))
                codes = self.codes(rows[known])
                at = np.minimum(np.searchsorted(table[0], codes), len(table[0]) - 1)
                same = table[0][at] == codes
                yield k, known[same], at[same]

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Which words of a document are hit, and the numbers of the items with occurring windows."""
        hit = np.zeros(len(ids) + 1, dtype=np.int64)
        windows: set[int] = set()
        for k, places, at in self.joined(ids):
            _, starts, window, offset = self.tables[k]
            many = starts[at + 1] - starts[at]
            entry = np.repeat(starts[at], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            begin = np.repeat(places, many) - offset[entry]
            w = window[entry]
            fits = (begin >= 0) & (begin + self.length[w] <= len(ids))  # positional and length bounds
            begin, w = begin[fits], w[fits]
            wide = np.arange(self.words.shape[1])
            inside = wide < self.length[w][:, None]
            there = ids[np.minimum(begin[:, None] + wide, len(ids) - 1)]
            same = ((there == self.words[w]) | ~inside).all(axis=1)
            np.add.at(hit, begin[same], 1)
            np.add.at(hit, begin[same] + self.length[w[same]], -1)
            windows.update(w[same].tolist())
        return np.cumsum(hit[:-1]) > 0, {i for w in windows for i in self.owners[w]}


def item_pieces(bench: DataFrame, width: int, most: int) -> DataFrame:
    """(item, text): the words of each item in stretches of at most `most` windows; together they have the item's windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = bench_words(text.as_py())
                starts = range(0, max(1, len(words) - width + 1), most) if words else ()
                names += [item] * len(starts)
                texts += [b" ".join(words[i : i + most + width - 1]) for i in starts]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], names=["item", "text"])

    return bench.mapInArrow(cut, "item string, text string")


def _shingle_frequency(source: DataFrame, windows) -> dict[int, int]:
    """Occurrences in all documents of the block's shingles; tasks pre-aggregate, the answer has a row a shingle at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Windows = windows.value
        total = np.zeros(block.n_shingles, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                ids = block.numbers(bench_words(text.as_py()))
                for k, _, at in block.joined(ids):
                    total += np.bincount(block.tables[k][1][at], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["shingle", "n"])

    counts = source.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {r.shingle: r.n for r in counts.collect()}


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    block_bytes: int = 4 << 20,
    piece_windows: int = 20_000,
    with_key: bool = False,
) -> DataFrame:
    """Words of documents that lie in any occurrence of a window of any benchmark item.

    Items are cut into pieces of piece_windows windows at most, of which distinct ones go to the tasks in broadcast blocks of
    about block_bytes, so neither a long item nor a repeated one makes a block larger. With more pieces than one block holds,
    the documents are read once a block and the blocks' findings are put together by document. Documents are never shuffled
    for one block. Windows are compared word by word, so hits are exact.

    Returns id_col, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans (array of start, end in words) and
    items (ids as strings, sorted) and, with with_key, text_key (text_digest of the text). Null or empty texts have no words and no hits; an item without words has no windows; an item
    without an id hits words but is no counted item; rows with null or repeated ids keep a result each; repeated items
    count once. Empty tables give no rows or no hits. Other columns are never read.
    """
    spark = docs.sparkSession
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    bench = items.select(items[item_col].cast("string").alias("item"), items[item_text_col].alias("text"))
    scratch = Scratch(spark, "decontaminate")
    pieces = scratch.keep(item_pieces(bench, width, piece_windows).distinct(), "pieces")
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    parts = []
    for b in range(blocks):
        own = pieces if blocks == 1 else pieces.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        block = Windows([(r.item, r.text) for r in own.collect()], width)
        counted = spark.sparkContext.broadcast(block)
        block.prefixes(_shingle_frequency(source, counted))
        parts.append(_scan(source, spark.sparkContext.broadcast(block), kind, keyed=with_key or blocks > 1))
    scratch.drop("pieces")
    if blocks == 1:
        found = parts[0]
    else:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        found = (
            found.groupBy("doc_id", "key", "n_words")
            .agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count("*").alias("times"))
            .withColumn("spans", F.expr(MERGED))
            .withColumn("again", F.explode(F.sequence(F.lit(1), (F.col("times") / blocks).cast("int"))))
        )
    return found.select(
        F.col("doc_id").alias(id_col),
        "n_words",
        _covered("spans").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.col("spans").alias("hit_spans"),
        "items",
        *([F.col("key").alias("text_key")] if with_key else []),
    )


#: Sorted spans put together where they touch.
MERGED = """aggregate(array_sort(spans), cast(array() as array<struct<start:bigint,end:bigint>>),
    (m, s) -> case when size(m) > 0 and element_at(m, -1).end >= s.start
        then concat(slice(m, 1, size(m) - 1), array(named_struct('start', element_at(m, -1).start, 'end', greatest(element_at(m, -1).end, s.end))))
        else concat(m, array(s)) end)"""


def text_digest(text: str) -> Column:
    """The digest by which texts of one id are told apart."""
    return F.unhex(F.md5(F.concat(F.lit(b"\1"), F.col(text).cast("binary"))))


def _covered(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def _scan(source: DataFrame, windows, kind: str, keyed: bool) -> DataFrame:
    """A row per document: what one block's windows hit."""
    schema = f"doc_id {kind}, key binary, n_words long, spans array<struct<start:long,end:long>>, items array<string>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Windows = windows.value
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            keys, sizes, spans, names = [], [], [], []
            for text in batch.column(1):
                text = text.as_py()
                words = bench_words(text)
                sizes.append(len(words))
                keys.append(hashlib.md5(b"\1" + text.encode() if text is not None else b"").digest() if keyed else None)
                hit, owners = block.found(block.numbers(words)) if words else ((), ())
                if owners:
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).reshape(-1, 2).tolist()
                    spans.append([{"start": a, "end": b} for a, b in edges])
                else:
                    spans.append([])
                names.append(sorted({block.items[i] for i in owners if block.items[i] is not None}))
            cols = [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "n_words", "spans", "items"])

    return source.mapInArrow(scan, schema)
