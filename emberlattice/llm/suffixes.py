"""Suffix-array dedup of byte strings: a distributed sort, by prefixes that triple, of the suffixes that can recur."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlattice.llm.grams import PRIME, U, by_bucket, joined_blobs, mixed
from emberlattice.scratch import Scratch, small_batches

SIZE = 50  # bytes of a string
WIDTH = 17  # bytes of the prefixes that are named first
LEADS = (0, WIDTH, SIZE - WIDTH)  # where the names stand that cover a string
SEEDS = (26, 34)  # bytes of the anchors that decide which strings can recur: among texts, then among distinct chunks of these
CHUNK = 4  # one in so many anchors ends a chunk
SLICE = 1 << 17  # bytes that are hashed at a time


class Room(threading.local):
    """Two arrays that a worker keeps, as new memory costs it more than the arithmetic that is done there."""

    a = b = np.zeros(0, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.a) < n:
            self.a, self.b = np.empty(n, dtype=np.uint64), np.empty(n, dtype=np.uint64)
        return self.a[:n], self.b[:n]


ROOM = Room()


def runs_of_bytes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the strings of `width` bytes that start at each place (as many as there are)."""
    n = max(0, len(data) - width + 1)
    out = np.empty(n, dtype=np.uint64)
    each = n if n <= 2 * SLICE else SLICE
    for i in range(0, n, each or 1):
        hash_into(out[i : i + each], data[i : i + each + width - 1], width)
    return out


def hash_into(out: np.ndarray, data: np.ndarray, width: int) -> None:
    """Hashes of a slice's strings: those of half the length make those of the whole."""
    n, m, size, power = len(out), len(data), 1, int(PRIME)
    level, spare = ROOM.of(m)
    level[:] = data
    level += U(1)
    done, rest = 0, width
    while rest:
        if rest & 1:
            part = level[done : done + n]
            if done:
                out *= U(power)
                out += part
            else:
                out[:] = part
            done += size
        rest >>= 1
        if rest:
            m -= size
            np.multiply(level[:m], U(power), out=spare[:m])
            spare[:m] += level[size : size + m]
            level, spare = spare, level
            size, power = 2 * size, power * power % (1 << 64)
    mixed_into(out, spare[:n])


def mixed_into(h: np.ndarray, spare: np.ndarray) -> None:
    """grams.mixed in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        np.right_shift(h, U(shift), out=spare)
        h ^= spare
        if factor:
            h *= U(factor)


def least_anchors(data: np.ndarray, seed: int) -> np.ndarray:
    """The smallest anchor hash within each string of SIZE bytes; equal strings have equal ones."""
    if len(data) > 2 * SLICE:
        return np.concatenate([least_anchors(data[i : i + SLICE + SIZE - 1], seed) for i in range(0, len(data) - SIZE + 1, SLICE)])
    h = runs_of_bytes(data, seed)
    width, size, n = SIZE - seed + 1, 1, len(h)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    low, (now, spare) = h, ROOM.of(n)
    while 2 * size <= width:
        n -= size
        np.minimum(low[:n], low[size : size + n], out=now[:n])
        low, now, spare, size = now, spare, now, 2 * size
    n = len(h) - width + 1
    return np.minimum(low[:n], low[width - size : width - size + n], out=h[:n])


def changes(a: np.ndarray) -> np.ndarray:
    """Whether each entry differs from the one before it (the first does)."""
    out = np.ones(len(a), dtype=bool)
    out[1:] = a[1:] != a[:-1]
    return out


def ordered(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order of the entries by unsigned keys, the first key first, and which entries of the order differ from the one before."""
    whole, bits = keys[0].astype(np.uint64), 8 * keys[0].itemsize
    for k in keys[1:]:
        more = 8 * k.itemsize
        if bits + more > 64:
            whole = ranks(whole)
            bits = int(whole.max()).bit_length() if len(whole) else 0
        if bits + more > 64:
            k = ranks(k)
            more = int(k.max()).bit_length() if len(k) else 0
        whole, bits = (whole << U(more)) | k.astype(np.uint64), bits + more
    order = np.argsort(whole)
    return order, changes(whole[order])


def ranks(a: np.ndarray) -> np.ndarray:
    """The number of smaller distinct entries."""
    order = np.argsort(a)
    out = np.empty(len(a), dtype=np.uint64)
    out[order] = np.cumsum(changes(a[order])) - 1
    return out


class Stretch:
    """Some items of a block end to end. Places are those that SIZE bytes of an item follow, counted item after item: `least` has their least
    anchors, `new` marks where another one begins, `first` is each item's first place."""

    def __init__(self, rows: list[int], bodies: list[bytes], seed: int):
        self.rows, self.text = np.array(rows), b"".join(bodies)
        sizes = np.array([len(x) for x in bodies], dtype=np.int64)
        n = sizes - SIZE + 1
        self.begin, self.first = np.cumsum(sizes) - sizes, np.cumsum(n) - n
        least = least_anchors(np.frombuffer(self.text, np.uint8), seed)
        self.least = np.concatenate([least[begin:end] for begin, end in zip(self.begin.tolist(), (self.begin + n).tolist(), strict=True)])
        self.new = changes(self.least)
        self.new[self.first] = True

    def item(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1


def stretches(part: pa.Table, seed: int, skip: set) -> Iterator[Stretch]:
    """A block's items in stretches of about SLICE bytes, without those named by skip (document, item)."""
    rows, bodies, size = [], [], 0
    left_out = {i for i, x in enumerate(zip(part["doc"].to_pylist(), part["item"].to_pylist(), strict=True)) if x in skip} if skip else ()
    for i, body in enumerate(body for chunk in part["body"].chunks for body in chunk.to_pylist()):
        if i in left_out:
            continue
        rows.append(i)
        bodies.append(body)
        size += len(body)
        if size >= SLICE:
            yield Stretch(rows, bodies, seed)
            rows, bodies, size = [], [], 0
    if rows:
        yield Stretch(rows, bodies, seed)


def recurring_anchors(items: DataFrame, notes: DataFrame, seed: int, buckets: int) -> DataFrame:
    """(block, h) blobs: the anchors of a block's items that items of another document have too.

    A block sends each of its anchors with the smallest and the largest document that has it, so that an anchor of a third of all
    documents costs two entries a block.
    """

    def spread(part: pa.Table, skipped: pa.Table) -> pa.Table:
        docs = part["doc"].to_numpy()
        h, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for x in stretches(part, seed, skip_of(skipped)):
            at = np.flatnonzero(x.new)
            h.append(x.least[at])
            owner.append(docs[x.rows][x.item(at)])
        h, owner = np.concatenate(h), np.concatenate(owner)
        order = np.argsort(h)
        starts = np.flatnonzero(changes(h[order]))
        if len(order):
            docs_of, many = owner[order], np.diff(np.concatenate([starts, [len(order)]]))
            low, high = (np.repeat(f.reduceat(docs_of, starts), many) for f in (np.minimum, np.maximum))
            order = order[(docs_of == low) | (docs_of == high)]
        keep = np.sort(order)
        rows = list(by_bucket(short(h[keep] % U(buckets), buckets), [h[keep], owner[keep]])) if len(keep) else []
        block = part["block"][0].as_py() if part.num_rows else 0
        return table_of([(b, block, *x) for b, x in rows], [("bucket", pa.int32()), ("block", pa.int32()), ("h", pa.binary()), ("docs", pa.binary())])

    def decide(part: pa.Table) -> pa.Table:
        block = np.repeat(part["block"].to_numpy(), [len(x.as_py()) // 8 for chunk in part["h"].chunks for x in chunk])
        h = joined_blobs(part["h"], np.uint64)
        order = np.argsort(h)
        h, docs, block = h[order], joined_blobs(part["docs"], np.int64)[order], block[order]
        starts = np.flatnonzero(changes(h))
        recurs = np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts)
        keep = np.repeat(recurs, np.diff(np.concatenate([starts, [len(h)]])))
        rows = by_bucket(block[keep], [h[keep]]) if keep.any() else ()
        return table_of([(b, x[0]) for b, x in rows], [("block", pa.int32()), ("h", pa.binary())])

    sent = items.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(spread, "bucket int, block int, h binary, docs binary")
    return sent.groupBy("bucket").applyInArrow(decide, "block int, h binary")


NOTES = "block int, h binary, doc long, item binary"


def skip_of(notes: pa.Table) -> set:
    return {(d, i) for d, i in zip(notes["doc"].to_pylist(), notes["item"].to_pylist(), strict=True) if d is not None}


def table_of(rows: list, fields: list) -> pa.Table:
    schema = pa.schema(fields)
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def chunks_of(items: DataFrame, notes: DataFrame, seed: int) -> DataFrame:
    """(doc, item, start, n, digest, body): stretches of n places of an item whose strings can recur (notes has the anchors that do), cut
    where the content says so, so that copies of a passage fall into equal chunks. The body, with the SIZE - 1 bytes behind the
    places, stands once a block and digest."""

    def cut(part: pa.Table, told: pa.Table) -> pa.Table:
        own = np.sort(joined_blobs(told["h"].drop_null(), np.uint64))
        own = own[changes(own)]
        at_row, at_start, sizes, digests, bodies, seen = [none := np.zeros(0, np.int64)], [none], [none], [], [], set()
        for x in stretches(part, seed, skip_of(told)) if len(own) else ():
            at = np.flatnonzero(x.new)
            h = x.least[at]
            order = np.argsort(h)  # a search in order finds its neighbours in the processor's cache
            known = np.empty(len(h), dtype=bool)
            known[order] = own[np.minimum(np.searchsorted(own, h[order]), len(own) - 1)] == h[order]
            may = np.repeat(known, np.diff(np.concatenate([at, [len(x.least)]])))
            edge = changes(may)
            edge[at[mixed(h) % U(CHUNK) == 0]] = True
            edge[x.first] = True
            begins = np.flatnonzero(edge)
            ends = np.concatenate([begins[1:], [len(may)]])
            keep = may[begins]
            begins, ends = begins[keep], ends[keep]
            item = x.item(begins)
            places = begins - x.first[item]
            offsets = x.begin[item] + places
            for offset, end in zip(offsets.tolist(), (offsets + (ends - begins) + SIZE - 1).tolist(), strict=True):
                body = x.text[offset:end]
                digest = hashlib.blake2b(body, digest_size=16).digest()
                digests.append(digest)
                bodies.append(None if digest in seen else body)
                seen.add(digest)
            at_row.append(x.rows[item])
            at_start.append(places)
            sizes.append(ends - begins)
        at = pa.array(np.concatenate(at_row))
        numbers = pa.array(np.concatenate(at_start).astype(np.int64)), pa.array(np.concatenate(sizes).astype(np.int32))
        data = [part["doc"].take(at), part["item"].take(at), *numbers, pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())]
        return pa.Table.from_arrays(data, names=["doc", "item", "start", "n", "digest", "body"])

    return items.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(cut, "doc long, item binary, start long, n int, digest binary, body binary")


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """(item, doc, body): each chunk once, with the smallest document that has it."""
    return chunks.groupBy("digest").agg(F.min("doc").alias("doc"), F.first("body", ignorenulls=True).alias("body")).withColumnRenamed("digest", "item")


class Block:
    """Some distinct chunks end to end, by rising document. Places are counted over the block."""

    def __init__(self, row: dict):
        self.number = row["block"]
        self.docs = np.frombuffer(row["docs"], np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.text = np.frombuffer(row["text"], np.uint8)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.chunk = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.left = np.repeat((self.begins + self.sizes).astype(np.int32), self.sizes)  # bytes from here to the chunk's end
        self.left -= np.arange(len(self.text), dtype=np.int32)
        self.words = words_of(row["text"])

    def alike(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places from which `length` bytes lie in their chunk so that equal strings stand together by rising document, and where a new string begins.

        Hashes share a number with the place, so the order is the same wherever it is found again; strings whose hashes clash may stand apart and count as new."""
        at = np.flatnonzero(self.left >= length)
        bits = U(len(at).bit_length())
        low = (U(1) << bits) - U(1)
        key = runs_of_bytes(self.text, length)[at]
        key &= ~low
        key |= np.arange(len(at), dtype=np.uint64)
        key.sort()
        at, new = at[(key & low).astype(np.int64)], changes(key >> bits)
        same = np.flatnonzero(~new)
        here, before, differ = at[same], at[same - 1], np.zeros(len(same), dtype=bool)
        for j in (*range(0, length - 8, 8), length - 8):
            differ |= self.words[here + j] != self.words[before + j]  # equal hashes are no proof
        new[same[differ]] = True
        return at, np.flatnonzero(new)


def packed_blocks(items: DataFrame, blocks: int) -> DataFrame:
    """(block, docs, sizes, text, digests): distinct chunks, those of one document in one block, end to end by rising document."""
    own = items.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int"))

    def pack(part: pa.Table) -> pa.Table:
        digests, texts = part["item"].to_pylist(), part["body"].to_pylist()
        docs = part["doc"].to_pylist()
        order = sorted(range(len(digests)), key=lambda i: (docs[i], digests[i]))
        texts = [texts[i] for i in order]
        docs = np.array(docs, dtype=np.int64)[order]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        row = (part["block"][0].as_py(), docs.tobytes(), sizes.tobytes(), b"".join(texts), b"".join(digests[i] for i in order))
        return table_of([row], [("block", pa.int32()), ("docs", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary()), ("digests", pa.binary())])

    return own.groupBy("block").applyInArrow(pack, "block int, docs binary, sizes binary, text binary, digests binary")


def words_of(text: bytes) -> np.ndarray:
    """The eight bytes from each place as a number in the order of the strings (for all but the last seven places)."""
    n = max(0, len(text) - 7)
    out = np.empty(n, dtype=np.uint64)
    for j in range(min(8, n)):
        out[j::8] = np.frombuffer(text, ">u8", -(-(n - j) // 8), j)
    return out


def splitters(blocks: DataFrame, parts: int, each: int = 512) -> np.ndarray:
    """First keys of range partitions from at most `each` keys a block of at most 256 blocks; they balance sorting, and decide no result."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                at = np.flatnonzero(b.left >= WIDTH)
                yield pa.RecordBatch.from_arrays([pa.array(b.words[at[:: max(1, len(at) // each)]].view(np.int64))], names=["k"])

    found = blocks.select("block", "docs", "sizes", "text").filter("block < 256").mapInArrow(some, "k long").toPandas()["k"].to_numpy(np.int64).view(np.uint64)
    return np.quantile(np.sort(found).astype(np.float64), np.linspace(0, 1, parts + 1)[1:-1]).astype(np.uint64) if len(found) else np.zeros(0, np.uint64)


MESSAGE = [("part", pa.int32()), ("block", pa.int32()), *((k, pa.binary()) for k in ("k0", "k1", "k2", "k3", "k4"))]
MESSAGE_SCHEMA = "part int, block int, k0 binary, k1 binary, k2 binary, k3 binary, k4 binary"


def short(part: np.ndarray, parts: int) -> np.ndarray:
    """Numbers of partitions in two bytes where they fit, as these are sorted by counting."""
    return part.astype(np.uint16 if parts <= 1 << 16 else np.int32)


def messages(part: np.ndarray, block: int, keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A block's keys for each range partition, in the order of the places they come from."""
    none = [None] * (5 - len(keys))
    rows = list(by_bucket(part, keys))
    if rows:
        yield from table_of([(p, block, *x, *none) for p, x in rows], MESSAGE).to_batches()


class Names:
    """Names of strings as numbers without gaps, in the order of the strings: `first` has each range partition's smallest name."""

    def __init__(self, counts: dict[int, int], parts: int):
        sizes = np.array([counts.get(p, 0) for p in range(parts)], dtype=np.uint64)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64)
        self.kind = np.uint32 if int(self.first[-1]) < 1 << 32 else np.uint64

    def part_of(self, names: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, names.astype(np.uint64), side="right") - 1

    def settled(self, found: list[dict], sent: Sent, size: int) -> np.ndarray:
        """Names by place: a partition answers in the order in which the block's strings of that partition were sent."""
        names, out = np.zeros(len(sent.starts), dtype=self.kind), np.zeros(size, dtype=self.kind)
        answers = sorted(found, key=lambda x: x["part"])
        names[np.argsort(sent.parts, kind="stable")] = np.concatenate([(self.first[x["part"]] + np.frombuffer(x["name"], np.uint32)).astype(self.kind) for x in answers])
        out[sent.at] = np.repeat(names, np.diff(np.concatenate([sent.starts, [len(sent.at)]])))
        return out


class Sent:
    """A block's strings of WIDTH bytes; each distinct one is sent once, to the range partition of its first eight bytes."""

    def __init__(self, b: Block, cut: np.ndarray):
        self.at, self.starts = b.alike(WIDTH)
        at = self.at[self.starts]
        self.keys = [b.words[at], b.words[at + 8], b.text[at + 16]]
        self.parts = short(np.searchsorted(cut, self.keys[0], side="right"), len(cut) + 1)


def named(sent: DataFrame, kinds: tuple, name: str, parts: int, scratch: Scratch) -> tuple[DataFrame, Names]:
    """Sorts strings (keys of the given kinds) within range partitions and names them by rank: rows (block, found), found a list of
    (part, name) with ranks in the order sent; and the numbering."""

    def rank(part: pa.Table) -> pa.Table:
        keys = [joined_blobs(part[f"k{i}"], k) for i, k in enumerate(kinds)]
        counts = [len(x.as_py()) // np.dtype(kinds[0]).itemsize for chunk in part["k0"].chunks for x in chunk]
        order, new = ordered(keys)
        names = np.empty(len(order), dtype=np.uint32)
        names[order] = (np.cumsum(new) - 1).astype(np.uint32)
        ends = np.cumsum(counts).tolist()
        number, n = part["part"][0].as_py(), int(new.sum())
        rows = [(b, number, names[e - c : e].tobytes(), n) for b, c, e in zip(part["block"].to_pylist(), counts, ends, strict=True)]
        return table_of(rows, [("block", pa.int32()), ("part", pa.int32()), ("name", pa.binary()), ("n", pa.int64())])

    own = scratch.keep(sent.groupBy("part").applyInArrow(rank, "block int, part int, name binary, n long"), name)
    numbering = Names({r.part: r.n for r in own.groupBy("part").agg(F.max("n").alias("n")).collect()}, parts)
    return own.groupBy("block").agg(F.collect_list(F.struct("part", "name")).alias(name)), numbering


def repeated_places(blocks: DataFrame, parts: int, scratch: Scratch) -> DataFrame:
    """(block, at) blobs: a place for each string of a block, with its smallest document there, that also starts in a chunk of a smaller one.

    Suffixes are sorted by prefixes that triple: a distributed sort by WIDTH bytes names all of them by rank, and the names at LEADS order them by SIZE bytes,
    as far as anything is asked of them. Range partitions of the second sort hold equal ones as neighbours, which get the smallest document of their run.
    A block sends equal keys once: what recurs within it is settled there (hits).
    """
    cut = splitters(blocks, parts)
    own = blocks.select("block", "docs", "sizes", "text")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = Sent(Block(row), cut)
                yield from messages(x.parts, row["block"], x.keys)

    short_names, names = named(own.mapInArrow(first, MESSAGE_SCHEMA), (np.uint64, np.uint64, np.uint8), "names", parts, scratch)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                name = names.settled(row["names"], Sent(b, cut), len(b.text))
                at, starts = b.alike(SIZE)
                at = at[starts]
                keys = [name[at + lead] for lead in LEADS]
                yield from messages(short(names.part_of(keys[0]), parts), b.number, [*keys, b.docs[b.chunk[at]], at.astype(np.uint32)])

    def compare(part: pa.Table) -> pa.Table:
        order, new = ordered([joined_blobs(part[f"k{i}"], names.kind) for i in range(len(LEADS))])
        starts = np.flatnonzero(new)
        docs = joined_blobs(part["k3"], np.int64)[order]
        many = np.diff(np.concatenate([starts, [len(docs)]]))
        later = docs > np.repeat(np.minimum.reduceat(docs, starts), many)
        counts = [len(x.as_py()) // 4 for chunk in part["k4"].chunks for x in chunk]
        blocks_of = np.repeat(part["block"].to_numpy(), counts)[order][later]
        at = joined_blobs(part["k4"], np.uint32)[order][later]
        rows = [(b, x[0]) for b, x in by_bucket(blocks_of, [at])] if len(at) else []
        return table_of(rows, [("block", pa.int32()), ("at", pa.binary())])

    sent = own.join(short_names, "block").mapInArrow(second, MESSAGE_SCHEMA)
    found = scratch.keep(sent.groupBy("part").applyInArrow(compare, "block int, at binary"), "repeated")
    scratch.drop("names")
    return found


def hits(blocks: DataFrame, repeated: DataFrame) -> DataFrame:
    """(item, runs): for each distinct chunk the runs of its places whose strings also start in a smaller document than its own first one."""

    def settle(block: pa.Table, told: pa.Table) -> pa.Table:
        fields = [("item", pa.binary()), ("runs", pa.binary())]
        if not block.num_rows:
            return table_of([], fields)
        row = block.to_pylist()[0]
        b = Block(row)
        at, starts = b.alike(SIZE)
        docs = b.docs[b.chunk[at]]
        many = np.diff(np.concatenate([starts, [len(at)]]))
        told_at = joined_blobs(told["at"], np.uint32)
        later = np.repeat(np.isin(at[starts], told_at), many) | (docs > np.repeat(docs[starts], many))
        hit = np.zeros(len(b.text), dtype=bool)
        hit[at[later]] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).reshape(-1, 2)
        owner = b.chunk[edges[:, 0]]
        runs = (edges - b.begins[owner][:, None]).astype(np.int64).tobytes()
        cuts = [*np.flatnonzero(changes(owner)).tolist(), len(owner)] if len(owner) else [0]
        owners = owner[cuts[:-1]].tolist()
        rows = [(row["digests"][16 * o : 16 * o + 16], runs[16 * x : 16 * y]) for o, x, y in zip(owners, cuts[:-1], cuts[1:], strict=True)]
        return table_of(rows, fields)

    return blocks.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(settle, "item binary, runs binary")


def lifted(chunks: DataFrame, heads: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc, item, found): what is repeated of the items that the chunks were cut from; whole: a smaller document has the chunk."""
    placed = chunks.select("doc", "item", "start", "n", "digest").join(heads.select(F.col("item").alias("digest"), F.col("doc").alias("first")), "digest")
    placed = placed.join(runs.withColumnRenamed("item", "digest"), "digest", "left").filter("first < doc or runs is not null")
    return placed.groupBy("doc", "item").agg(F.collect_list(F.struct("start", "n", (F.col("first") < F.col("doc")).alias("whole"), "runs")).alias("found"))


def end_to_end(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, and where each begins and the last one ends there (a null has none)."""
    strings = pc.fill_null(strings, b"").cast(pa.large_binary())
    _, at, data = strings.buffers()
    if not len(strings) or not data:
        return np.zeros(0, np.uint8), np.zeros(len(strings) + 1, np.int64)
    return np.frombuffer(data, np.uint8), np.frombuffer(at, np.int64)[strings.offset : strings.offset + len(strings) + 1]


def runs_in(found: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, begins and ends of the repeated places of a column of items, by row."""
    row = np.repeat(np.arange(len(found)), pc.fill_null(pc.list_value_length(found), 0).to_numpy())
    start, n, whole, runs = found.flatten().flatten()
    start, n, whole = start.to_numpy(), n.to_numpy(), whole.to_numpy(zero_copy_only=False).astype(bool)
    data, at = end_to_end(runs.filter(pa.array(~whole)))
    edges, inner = data[at[0] : at[-1]].view(np.int64).reshape(-1, 2), np.repeat(np.flatnonzero(~whole), np.diff(at) // 16)
    rows = np.concatenate([row[whole], row[inner]])
    begins = np.concatenate([start[whole], start[inner] + edges[:, 0]])
    ends = np.concatenate([start[whole] + n[whole], start[inner] + edges[:, 1]])
    order = np.argsort(rows, kind="stable")
    return rows[order], begins[order], ends[order]


def removed(begins: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of stretches of bytes (of rows that lie end to end) that overlap or touch within a row: begins, ends and rows, in order."""
    order = np.lexsort((begins, row))
    begins, row = begins[order], row[order]
    far = np.maximum.accumulate(ends[order])
    new = changes(row)
    new[1:] |= begins[1:] > far[:-1]
    first = np.flatnonzero(new)
    return begins[first], far[np.concatenate([first[1:], [len(far)]]) - 1] if len(far) else far, row[first]


def repeated_in(items: DataFrame, size: int, notes: DataFrame, seeds: tuple[int, ...], scratch: Scratch, block_bytes: int, cut=lambda: None) -> DataFrame:
    """(doc, item, found): the places of the items whose strings also start in a smaller document's item.

    The stretches of each item that can recur fall into chunks, equal chunks collapse to that of the smallest document; the same is done
    with these for the next seed, and what is left is sorted. cut is called once the items are read for the last time.
    """
    seed, *rest = seeds
    spark = items.sparkSession
    blocks = max(1, -(-size // (4 * block_bytes)))
    items = items.withColumn("block", F.pmod(F.xxhash64("doc", "item"), F.lit(blocks)).cast("int"))
    notes = notes.select(F.pmod(F.xxhash64("doc", "item"), F.lit(blocks)).cast("int").alias("block"), F.lit(None).cast("binary").alias("h"), "doc", "item")
    anchors = scratch.keep(recurring_anchors(items, notes, seed, blocks), f"anchors-{seed}")
    told = anchors.select("block", "h", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("binary").alias("item")).unionByName(notes)
    chunks = scratch.keep(chunks_of(items, told, seed), f"chunks-{seed}")
    scratch.drop(f"anchors-{seed}")
    cut()
    bodies = scratch.keep(distinct_chunks(chunks), f"bodies-{seed}")
    heads = scratch.keep(bodies.select("item", "doc"), f"heads-{seed}")
    chunks = scratch.keep(chunks.drop("body"), f"placed-{seed}")
    scratch.drop(f"chunks-{seed}")
    size = bodies.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    empty = spark.range(0)  # tables without rows start no Python workers
    none = empty.select(F.col("id").alias("doc"), F.lit(b"").alias("item"))
    if not size:
        runs = empty.select(F.lit(b"").alias("item"), F.lit(b"").alias("runs"))
    elif rest:
        inner = repeated_in(bodies, size, none, tuple(rest), scratch, block_bytes, lambda: scratch.drop(f"bodies-{seed}"))

        def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, begins, ends = runs_in(batch.column(1))
                at = (16 * np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])).astype(np.int32)
                runs = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(at), pa.py_buffer(np.column_stack([begins, ends]).astype(np.int64))])
                yield pa.RecordBatch.from_arrays([batch.column(0), runs], names=["item", "runs"])

        runs = inner.select("item", "found").mapInArrow(flat, "item binary, runs binary")
    else:
        blocks = scratch.keep(packed_blocks(bodies, max(1, -(-size // block_bytes))), "blocks")
        scratch.drop(f"bodies-{seed}")
        runs = hits(blocks, repeated_places(blocks, max(1, -(-size // block_bytes)), scratch))
    found = scratch.keep(lifted(chunks, heads, runs), f"found-{seed}")
    scratch.drop(f"placed-{seed}", f"heads-{seed}", *(() if rest else ("blocks", "repeated")))
    return found


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2 << 20) -> DataFrame:
    """Removes bytes covered by a string of SIZE bytes that also starts in a document with a smaller id.

    Strings are judged on the input and never cross documents. Equal texts collapse to that of the smallest id (a later copy goes as a
    whole). Only strings whose smallest anchor occurs in two documents can recur; the stretches of such places are cut into chunks by content,
    equal chunks collapse likewise, and suffixes of distinct chunks are sorted and merged (repeated_places). Anchors are 64-bit hashes: equal strings
    always have equal ones, so none is missed; texts are told apart by SHA-256 and chunks by 128 bits of BLAKE2; suffixes are compared exactly.

    Returns id_col, n_bytes, n_removed, n_spans and kept_sha256 (of the remaining bytes). Ids are whole numbers. Null and empty texts have no bytes; rows with
    a null id are kept as they are; rows of one id don't remove from one another; an empty table gives no rows. Other columns are never read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "suffixes")
    source = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text"))
    source = source.withColumn("item", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    usable = source.filter(f"doc is not null and octet_length(text) >= {SIZE}")
    keys = scratch.keep(usable.select("doc", "item", F.octet_length("text").alias("size")), "keys")
    same = keys.groupBy("item").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    copies = scratch.keep(keys.select("doc", "item").join(same, "item").filter("doc > first").select("doc", "item").distinct(), "copies")
    total = keys.agg(F.sum("size")).first()[0] or 0
    scratch.drop("keys")
    items = usable.select("doc", "item", F.col("text").cast("binary").alias("body"))
    full = source.join(copies.withColumn("copy", F.lit(True)), ["doc", "item"], "left")
    if total:
        full = full.join(repeated_in(items, total, copies, SEEDS, scratch, block_bytes), ["doc", "item"], "left")
    else:
        full = full.withColumn("found", F.expr("cast(null as array<struct<start: bigint, n: int, whole: boolean, runs: binary>>)"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, text, copy, found = batch.columns
            data, at = end_to_end(text)
            sizes, gone = np.diff(at), np.flatnonzero(pc.fill_null(copy, False).to_numpy(zero_copy_only=False))
            row, begins, ends = runs_in(found)
            begins, ends, row = removed(
                np.concatenate([at[gone], at[row] + begins]), np.concatenate([at[gone + 1], at[row] + ends + SIZE - 1]), np.concatenate([gone, row])
            )
            spans, less = np.bincount(row, minlength=len(sizes)), np.zeros(len(sizes), np.int64)
            np.add.at(less, row, ends - begins)
            kept, cuts = [], zip(begins.tolist(), ends.tolist(), strict=True)
            for begin, end, n in zip(at[:-1].tolist(), at[1:].tolist(), spans.tolist(), strict=True):
                digest = hashlib.sha256()
                for a, b in islice(cuts, n):
                    digest.update(data[begin:a])
                    begin = b
                digest.update(data[begin:end])
                kept.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([doc, pa.array(sizes), pa.array(less), pa.array(spans.astype(np.int64)), pa.array(kept)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    done = full.select("doc", F.col("text").cast("binary"), "copy", "found").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return done.withColumnRenamed("doc_id", id_col)
