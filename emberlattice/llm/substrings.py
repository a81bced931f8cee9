"""Substring dedup: repeated passages compiled into sharded Aho-Corasick automata that documents are streamed through."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlattice.llm.grams import WordHashes, by_bucket, chunks, joined_blobs, mixed, rolling, windows_of
from emberlattice.scratch import Scratch, small_batches

#: Words of an automaton's patterns. Each window of 13 words holds one of the passage's blocks that start at multiples of 9.
BLOCK = 5
FIRST, FOLLOWS = 0, 1
BUCKET_BYTES = 8 << 20  # of texts whose windows one task holds at a time
GAP = re.compile(rb"[\x20\x09-\x0D]+")


def confirmed(usable: DataFrame, width: int, buckets: int) -> DataFrame:
    """Which documents hold windows that recur: a row (doc_id, windows, firsts) for each of them.

    windows: hashes of windows that start in this document, in no smaller one, and in another text; firsts: ids of documents
    for which that holds of windows of this one. Window hashes are dealt to buckets as blobs, so that a common window costs a number in a blob and no bucket holds more rows than tasks; what a bucket finds goes
    on as one blob for each bucket of documents.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, parts in chunks(batch.column(1), lambda text: hashes.of(text.encode().split())):
                lengths = np.array([len(x) for x in parts], dtype=np.int64)
                inside, owner = windows_of(lengths, width)
                h = rolling(np.concatenate(parts), width)[inside]
                owner = owner[: len(inside)][inside]
                rows = list(by_bucket((h % np.uint64(buckets)).astype(np.int32), [h, ids[a:b][owner], keys[a:b][owner]]))
                if rows:
                    cols = [pa.array([r for r, _ in rows], pa.int32()), *(pa.array([x[k] for _, x in rows], pa.binary()) for k in range(3))]
                    yield pa.RecordBatch.from_arrays(cols, names=["bucket", "h", "ids", "keys"])

    def decide(part: pa.Table) -> pa.Table:
        h = joined_blobs(part["h"], np.uint64)
        order = np.argsort(h, kind="stable")
        h = h[order]
        ids, keys = joined_blobs(part["ids"], np.int64)[order], joined_blobs(part["keys"], np.int64)[order]
        del order
        starts = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1])
        many = np.diff(np.concatenate([starts, [len(h)]]))
        first = np.minimum.reduceat(ids, starts)
        again = first != np.maximum.reduceat(ids, starts)
        differ = np.minimum.reduceat(keys, starts) != np.maximum.reduceat(keys, starts)
        recurs = differ & again
        ends = [(first[recurs], np.full(recurs.sum(), FIRST), h[starts][recurs].view(np.int64))]
        del h, starts
        pick = np.flatnonzero(np.repeat(recurs, many))
        of = np.repeat(first[recurs], many[recurs])
        doc = ids[pick]
        later = doc != of
        doc, of = unique_pairs(doc[later], of[later])
        ends.append((doc, np.full(len(doc), FOLLOWS), of))
        doc, kind, value = (np.concatenate(x) for x in zip(*ends, strict=True))
        rows = list(by_bucket((mixed(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int32), [doc, kind.astype(np.int8), value]))
        cols = [pa.array([r for r, _ in rows], pa.int32()), *(pa.array([x[k] for _, x in rows], pa.binary()) for k in range(3))]
        return pa.Table.from_arrays(cols, names=["bucket", "doc", "kind", "value"])

    def gather(part: pa.Table) -> pa.Table:
        doc, kind, value = joined_blobs(part["doc"], np.int64), joined_blobs(part["kind"], np.int8), joined_blobs(part["value"], np.int64)
        order = np.lexsort((kind, doc))
        doc, kind, value = doc[order], kind[order], value[order]
        cuts = [0, *(np.flatnonzero(np.diff(doc)) + 1).tolist(), len(doc)]
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                x = a + int(np.searchsorted(kind[a:b], FOLLOWS))
                rows.append((int(doc[a]), value[a:x].tobytes(), np.unique(value[x:b]).tobytes()))
        return pa.Table.from_batches([_batch(rows, INFO)])

    dealt = usable.mapInArrow(spread, "bucket int, h binary, ids binary, keys binary").groupBy("bucket").applyInArrow(
        decide, "bucket int, doc binary, kind binary, value binary"
    )
    return dealt.groupBy("bucket").applyInArrow(gather, "doc_id long, windows binary, firsts binary")


def unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


INFO = pa.schema([("doc_id", pa.int64()), ("windows", pa.binary()), ("firsts", pa.binary())])


def whole_copies(usable: DataFrame) -> DataFrame:
    """(doc_id, copies): SHA-256 of those texts of a document that a smaller one has too; only digests and ids are shuffled."""
    own = usable.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    same = own.groupBy("sha").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    return own.join(same, "sha").filter("doc_id > least").groupBy("doc_id").agg(F.collect_set("sha").alias("copies"))


def cut_passages(source: DataFrame, found: DataFrame, copies: DataFrame, width: int, with_text: bool) -> DataFrame:
    """A row per document: its passages that recur (runs of FIRST windows, each window once) and whose passages it follows.

    Documents that need no scan have their digest at once; the others keep their text.
    """
    together = source.join(found, "doc_id", "left").join(copies, "doc_id", "left")
    schema = (
        "doc_id long, key long, n_words long, n_removed long, kept_sha256 string, kept_text string, text string, firsts array<long>, "
        "passages array<string>, passage_words long"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for doc, text, key, windows, firsts, copies in zip(*(batch.column(c) for c in ("doc_id", "text", "key", "windows", "firsts", "copies")), strict=True):
                raw = text.as_py()
                words = raw.encode().split() if raw else []
                n = len(words)
                passages = []
                if windows := windows.as_py():
                    own = np.frombuffer(windows, dtype=np.uint64)
                    h, first = np.unique(rolling(hashes.of(words), width), return_index=True)
                    at = np.sort(first[np.isin(h, own)])
                    for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                        if len(run):
                            passages.append(b" ".join(words[run[0] : run[-1] + width]).decode())
                follows = np.frombuffer(firsts.as_py() or b"", dtype=np.int64).tolist()
                row = [doc.as_py(), key.as_py(), n, None, None, None, None, None, passages, sum(p.count(" ") + 1 for p in passages)]
                if n >= width and copies.is_valid and hashlib.sha256(raw.encode()).hexdigest() in copies.as_py():
                    row[3:6] = n, sha([]), "" if with_text else None
                elif follows:
                    row[6:8] = raw, follows
                else:
                    row[3:5] = 0, sha(words)
                rows.append(row)
            yield _batch(rows, CUT)

    return together.mapInArrow(cut, schema)


CUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()),
        ("text", pa.string()), ("firsts", pa.list_(pa.int64())), ("passages", pa.list_(pa.string())), ("passage_words", pa.int64()),
    ]
)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


class WordCodes(dict):
    """Three characters for each word, each from a small alphabet of its own, so that a match always starts at a word.
    Words may share a code: every match is compared word by word."""

    def __missing__(self, word: bytes) -> str:
        if len(self) > 1_000_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        c = self[word] = chr(1 + (h & 31)) + chr(33 + (h >> 5 & 31)) + chr(65 + (h >> 10 & 31))
        return c


class PassageAutomaton:
    """Aho-Corasick automaton of blocks of BLOCK words that start at every (width - BLOCK + 1)-th word of each passage: any
    window of `width` words of a passage holds a whole block. Hits are extended to the longest common run of words."""

    def __init__(self, passages: list[tuple[int, str]], width: int):
        import ahocorasick

        self.width = width
        self.codes = WordCodes()
        self.firsts = [first for first, _ in passages]
        self.words = [text.encode().split() for _, text in passages]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for p, words in enumerate(self.words):
            for o in range(0, len(words) - BLOCK + 1, width - BLOCK + 1):
                places["".join(map(self.codes.__getitem__, words[o : o + BLOCK]))].append((p, o))
        self.automaton = ahocorasick.Automaton()
        for pattern, own in places.items():
            self.automaton.add_word(pattern, own)
        if places:
            self.automaton.make_automaton()

    def spans(self, doc: int, words: list[bytes]) -> list[tuple[int, int]]:
        """Runs of words that lie in passages of smaller documents, put together where they touch."""
        if len(words) < self.width or not len(self.automaton):
            return []
        coded = "".join(map(self.codes.__getitem__, words))
        reached: dict[tuple[int, int], int] = {}
        runs = []
        for end, places in self.automaton.iter(coded):
            at = (end + 1) // 3 - BLOCK
            for p, offset in places:
                if self.firsts[p] >= doc or reached.get((p, at - offset), -1) > at:
                    continue
                own = self.words[p]
                left = common(words[max(0, at - offset) : at][::-1], own[max(0, offset - at) : offset][::-1])
                right = common(words[at : at + len(own) - offset], own[offset:])
                reached[p, at - offset] = at + right
                if right >= BLOCK and left + right >= self.width:
                    runs.append((at - left, at + right))
        merged: list[tuple[int, int]] = []
        for a, b in sorted(runs):
            if merged and a <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(b, merged[-1][1])
            else:
                merged.append((a, b))
        return merged


def common(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 8:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    while low < high and a[low] == b[low]:
        low += 1
    return low


def kept(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; white space before a kept word stays, once words behind a cut move up one space
    parts them."""
    raw = text.encode()
    parts = GAP.split(raw)
    gaps = GAP.findall(raw)
    if parts and not parts[0]:
        parts, lead = parts[1:], gaps[:1]
        gaps = gaps[1:]
    else:
        lead = []
    if parts and not parts[-1]:
        parts = parts[:-1]
    gone = np.zeros(len(parts), dtype=bool)
    for a, b in spans:
        gone[a:b] = True
    out = list(lead) if len(gone) and not gone[0] else []
    previous = None
    for i in np.flatnonzero(~gone).tolist():
        if previous is not None:
            out.append(gaps[i - 1] if previous == i - 1 else b" ")
        out.append(parts[i])
        previous = i
    return b"".join(out).decode()


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 13,
    with_text: bool = False,
    shard_words: int = 400_000,
    scan_bytes: int = 16 << 20,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Removes words covered by a window of `width` words that also starts in a document with a smaller id.

    Windows are judged on the input. First the recurring passages are confirmed: hashes of all windows meet by bucket, and each
    document that is the smallest to hold a recurring window gives the passage's words. Passages go to shards of about
    shard_words words, each an Aho-Corasick automaton; every document that holds a window of a shard's passages streams through
    that shard, which finds all occurrences and compares them word by word. Hot shards are split by document.

    Window hashes have 64 bits; two windows that differ but share one could only hide a passage, never remove a word. A text that a smaller
    document has too, by SHA-256, goes as a whole; its windows are no passages of their own.

    Returns id_col, text_key (xxhash64 of the text), n_words, n_removed, kept_sha256 and, with with_text, kept_text (null: the text
    is as before). Ids are whole numbers. Null and empty texts have no words; a row with a null id is kept as it is, as no id is
    smaller or larger; rows of one id don't remove from one another; an empty table gives no rows. Other columns are never read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "passages")
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).withColumn("key", F.xxhash64("text"))
    usable = source.filter("doc_id is not null and text is not null")
    size = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = scratch.keep(confirmed(usable, width, max(1, -(-size // bucket_bytes))), "windows")
    copies = scratch.keep(whole_copies(usable), "copies")
    cut = scratch.keep(cut_passages(source, found, copies, width, with_text), "cut")
    scratch.drop("windows", "copies")
    passages = cut.filter("passage_words > 0").select(F.col("doc_id").alias("first"), "passage_words", F.explode("passages").alias("passage"))
    total = cut.agg(F.sum("passage_words")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    shard = lambda c: F.pmod(F.xxhash64(F.lit(7), c), F.lit(shards)).cast("int")
    followers = cut.filter("firsts is not null")
    routed = followers.select(
        "doc_id", "key", "text", F.explode(F.array_distinct(F.transform("firsts", shard))).alias("shard")
    )
    loads = routed.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("text")) / scan_bytes).cast("int").alias("salts"))
    salted = routed.join(loads, "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.col("salts")).cast("int")).drop("salts")
    patterns = (
        passages.withColumn("shard", shard(F.col("first")))
        .join(loads, "shard")
        .select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "first", "passage")
    )

    def locate(texts: pa.Table, own: pa.Table) -> pa.Table:
        scan = PassageAutomaton(list(zip(own["first"].to_pylist(), own["passage"].to_pylist(), strict=True)), width)
        rows = []
        for doc, key, text in zip(texts["doc_id"], texts["key"], texts["text"], strict=True):
            if spans := scan.spans(doc.as_py(), text.as_py().encode().split()):
                rows.append((doc.as_py(), key.as_py(), np.array(spans, dtype=np.int64).tobytes()))
        return pa.Table.from_batches([_batch(rows, SPANS)])

    spans = (
        salted.groupBy("shard", "salt")
        .cogroup(patterns.groupBy("shard", "salt"))
        .applyInArrow(locate, "doc_id long, key long, spans binary")
    )
    spans = scratch.keep(spans, "spans").groupBy("doc_id", "key").agg(F.collect_list("spans").alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, key, n, text, runs in zip(*(batch.column(c) for c in ("doc_id", "key", "n_words", "text", "spans")), strict=True):
                text = text.as_py()
                words = text.encode().split()
                gone = np.zeros(len(words), dtype=bool)
                for a, b in np.frombuffer(b"".join(runs.as_py() or []), dtype=np.int64).reshape(-1, 2).tolist():
                    gone[a:b] = True
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2).tolist()
                rest = kept(text, edges) if with_text and edges else None
                rows.append((doc.as_py(), key.as_py(), n.as_py(), int(gone.sum()), sha([w for w, out in zip(words, gone.tolist(), strict=True) if not out]), rest))
            yield _batch(rows, DONE)

    scanned = followers.select("doc_id", "key", "n_words", "text").join(spans, ["doc_id", "key"], "left")
    done = scanned.mapInArrow(finish, "doc_id long, key long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    names = ["doc_id", "key", "n_words", "n_removed", "kept_sha256", "kept_text"]
    out = cut.filter("firsts is null").select(*names).unionByName(done)
    columns = [F.col("doc_id").alias(id_col), F.col("key").alias("text_key"), "n_words", "n_removed", "kept_sha256"]
    return out.select(*columns, *(["kept_text"] if with_text else []))


SPANS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("spans", pa.binary())])
DONE = pa.schema(
    [("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]
)
