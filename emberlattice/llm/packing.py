"""Vector bin packing of token sequences: a dot-product heuristic under limits on tokens, segments and loss tokens."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
END = b"\0\0\0\0"
ID_BYTES = 4


class UnitIds(dict):
    """Token ids (little-endian unsigned 32-bit) of ' ' + unit for units between single spaces.

    The pattern that cuts a text before the merges never lets a token reach over a space that stands between two
    characters that are no white space, so ids of such units put together are the ids of the text. A unit that begins or
    ends with white space is kept as None: the text is then cut by SAFE_SPACE instead. The cache is emptied at its bound.
    """

    def __init__(self, encode: Callable[[str], list[int]], bound: int = 200_000, longest: int = 48):
        super().__init__()
        self.encode, self.bound, self.longest = encode, bound, longest

    def ids(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def __missing__(self, unit: str) -> bytes | None:
        found = None if not unit or unit[0].isspace() or unit[-1].isspace() else array("I", self.encode(" " + unit)).tobytes()
        if len(unit) <= self.longest:
            if len(self) >= self.bound:
                self.clear()
            self[unit] = found
        return found

    def of(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            return b"".join([self.ids(first), *map(self.__getitem__, rest)])
        except TypeError:
            first, *rest = SAFE_SPACE.split(text)
            return b"".join([self.ids(first), *(self[x] or self.ids(" " + x) for x in rest)])


@cache
def unit_ids(tokenizer_file: str) -> UnitIds:
    """The worker's cache for a tokenizer file; it outlives a task.

    Where the file is a plain byte-level BPE whose ids follow its merges, misses go through tiktoken with the file's own
    vocabulary as ranks, which gives the same ids sooner; texts with a special token's string go through tokenizers.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    exact = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    spec = json.loads(tokenizer.to_str())
    special = [t["content"] for t in spec["added_tokens"]]
    vocabulary = spec["model"].get("vocab")
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    merges = [x if isinstance(x, list) else x.split(" ") for x in spec["model"].get("merges", [])]
    if (
        spec["model"].get("type", "BPE") != "BPE" or spec["normalizer"] or spec["model"].get("ignore_merges") or spec["model"].get("unk_token")
        or {k: v for k, v in (spec["pre_tokenizer"] or {}).items() if k in plain} != plain
        or [vocabulary.get("".join(m)) for m in merges] != list(range(256, 256 + len(merges)))
    ):
        return UnitIds(exact)
    import tiktoken
    from public_tokenizers import PATTERN

    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocabulary.items() if piece not in special}
    fast = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if not special:
        return UnitIds(fast)
    if len(special) == 1:
        (mark,) = special
        return UnitIds(lambda text: exact(text) if mark in text else fast(text))
    return UnitIds(lambda text: exact(text) if any(x in text for x in special) else fast(text))


class Packer:
    """Fills one sequence at a time: of the waiting items that fit, the one whose demand has the largest dot product with
    what is left of the limits goes in. Where cutting is allowed a sequence that no whole item can fill any further gets a
    part of the largest item, and the tail of the run is laid out in sequences whose lengths are powers of two.

    Items are (key, start, tokens, loss tokens). waiting bounds the items kept in memory.
    """

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, cut: bool, waiting: int = 512):
        self.limits = np.array([max_tokens, max_segments, max_loss], dtype=np.int64)
        self.cut, self.bound = cut, waiting
        self.keys: list = []
        self.sizes = np.zeros((0, 4), dtype=np.int64)  # start, tokens, segments, loss tokens
        self.fresh: list[tuple] = []

    def add(self, key, start: int, tokens: int, loss: int) -> Iterator[list[tuple]]:
        self.keys.append(key)
        self.fresh.append((start, tokens, 1, loss))
        if len(self.keys) >= self.bound:
            self._settle()
            while len(self.keys) > self.bound // 2 and (not self.cut or self.sizes[:, 1].sum() >= self.limits[0]):
                yield self._fill(int(self.limits[0]))

    def rest(self) -> Iterator[list[tuple]]:
        self._settle()
        while self.keys:
            left = int(self.sizes[:, 1].sum())
            room = int(self.limits[0])
            if self.cut and left < room:
                room = 1 << (left.bit_length() - 1)
            yield self._fill(room)

    def _settle(self) -> None:
        if self.fresh:
            self.sizes = np.concatenate([self.sizes, np.array(self.fresh, dtype=np.int64)])
            self.fresh = []

    def _fill(self, room: int) -> list[tuple]:
        """Pieces (key, start, tokens, loss) of one sequence of at most room tokens."""
        left = np.minimum(self.limits, [room, self.limits[1], self.limits[2]])
        gone = np.zeros(len(self.keys), dtype=bool)
        pieces = []
        need = self.sizes[:, 1:]
        weight = need / self.limits
        while True:
            fits = (need <= left).all(axis=1) & ~gone
            if not fits.any():
                break
            score = np.where(fits, weight @ (left / self.limits), -1.0)
            k = int(score.argmax())
            pieces.append((self.keys[k], int(self.sizes[k, 0]), int(need[k, 0]), int(need[k, 2])))
            left = left - need[k]
            gone[k] = True
        if self.cut and left.min() > 0 and not gone.all():
            k = int(np.where(gone, -1, need[:, 0]).argmax())
            take = int(min(left[0], left[2]))  # every token of a text that may be cut bears loss
            pieces.append((self.keys[k], int(self.sizes[k, 0]), take, take))
            self.sizes[k, 0] += take
            self.sizes[k, 1] -= take
            self.sizes[k, 3] -= take
        if not pieces:
            raise ValueError("an item is larger than the limits and may not be cut")
        self.keys = [x for x, out in zip(self.keys, gone, strict=True) if not out]
        self.sizes = self.sizes[~gone]
        return pieces


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 1024,
    max_segments: int = 128,
    max_loss: int = 1024,
) -> DataFrame:
    """Cuts and packs token streams of whole texts (ids of the tokenizer file, then id 0) into sequences.

    Every id lies in exactly one piece; sequences hold max_tokens ids, or a power of two at the tail of a task; every
    token bears loss. Each task packs what it reads, so nothing is shuffled and memory holds a bounded number of
    remainders; a sequence id is the task's number and a count, the same again if the task is run anew.

    Returns a row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text is the
    id 0 alone; rows with a null or repeated id are packed like all others; an empty table gives no rows.
    """
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("limits must be positive")
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = unit_ids(tokenizer_file)
        packer = Packer(max_tokens, max_segments, max_loss, cut=True)
        whole = min(max_tokens, max_loss)
        number = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def laid(pieces: list[tuple]) -> None:
            nonlocal number
            offset = 0
            for (doc, ids), start, tokens, _ in pieces:
                part = memoryview(ids)[start * ID_BYTES : (start + tokens) * ID_BYTES]
                rows.append((doc, start, tokens, zlib.crc32(part), len(ids) // ID_BYTES, number, offset))
                offset += tokens
            number += 1

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], type=id_type), *(pa.array(c, type=pa.int64()) for c in cols[1:])], names=NAMES)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids = (units.of(text) if text else b"") + END
                n = len(ids) // ID_BYTES
                at = 0
                while n - at >= whole:
                    laid([((doc, ids), at, whole, whole)])
                    at += whole
                if at < n:
                    for pieces in packer.add((doc, ids), at, n - at, n - at):
                        laid(pieces)
                if len(rows) >= 20_000:
                    yield out()
        for pieces in packer.rest():
            laid(pieces)
        if rows:
            yield out()

    return source.mapInArrow(pack, schema).withColumnRenamed("doc_id", id_col)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_examples(
    examples: DataFrame,
    id_col: str,
    tokens_col: str,
    loss_col: str,
    max_tokens: int = 4096,
    max_segments: int = 32,
    max_loss: int = 2048,
) -> DataFrame:
    """Packs whole examples (no cutting) of instruction data under the three limits at once.

    Returns id_col, tokens, loss_tokens, sequence_id, offset, and fits (false: the example alone is beyond a limit, or a
    size is null or negative; such rows keep a null sequence). Each task packs what it reads.
    """
    source = examples.select(
        examples[id_col].alias("example_id"), examples[tokens_col].cast("long").alias("tokens"), examples[loss_col].cast("long").alias("loss_tokens")
    )
    kind = source.schema["example_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(max_tokens, max_segments, max_loss, cut=False)
        number = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def laid(pieces: list[tuple]) -> None:
            nonlocal number
            offset = 0
            for key, _, tokens, loss in pieces:
                rows.append((key, tokens, loss, number, offset, True))
                offset += tokens
            number += 1

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            kinds = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            names = ["example_id", "tokens", "loss_tokens", "sequence_id", "offset", "fits"]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, tokens, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if tokens is None or loss is None or tokens < 0 or loss < 0 or tokens > max_tokens or loss > max_loss:
                    rows.append((key, tokens, loss, None, None, False))
                else:
                    for pieces in packer.add(key, 0, tokens, loss):
                        laid(pieces)
            if len(rows) >= 20_000:
                yield out()
        for pieces in packer.rest():
            laid(pieces)
        if rows:
            yield out()

    schema = f"example_id {kind}, tokens long, loss_tokens long, sequence_id long, offset long, fits boolean"
    return source.mapInArrow(pack, schema).withColumnRenamed("example_id", id_col)
