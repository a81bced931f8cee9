"""N-gram Jaccard join by a token-group matrix: groups of similar documents, their token unions, and bounds on overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlattice.llm.grams import WordHashes, by_bucket, joined_blobs, mixed, rolling
from emberlattice.operators.graph import connected
from emberlattice.scratch import Scratch, small_batches

BUCKET_TOKENS = 1_000_000  # tokens of prefixes that one task holds at a time


def shingle_set(words: list[bytes], hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a shorter sequence is one shingle, none without words."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    size = min(width, len(words))
    return np.unique(rolling(hashes.of(words), size) ^ np.uint64(size % width))


def behind(n: int) -> int:
    """How many shingles of a set of n lie behind its prefix."""
    return 7 * n // 10


def least_overlap(n):
    """Shingles that a set of n has in common with any linked set of m within both prefixes, at least.

    They have 4 (n + m) / 9 in common, of which at most max(behind(n), behind(m)) lie behind either prefix; m is from 4 n / 5 to
    5 n / 4, and over these the rest is smallest at 4 n / 5, where it is n / 10.
    """
    return F.ceil(n / F.lit(10))


def set_table(source: DataFrame, width: int, heavy: np.ndarray) -> DataFrame:
    """Per document: size and digest of its set, and the prefix of the set: its n - behind(n) first shingles in the order
    (frequency among the heavy ones, hash)."""
    codes, counts = (np.zeros(0, np.uint64), np.zeros(0, np.int64)) if not len(heavy) else (heavy[0].astype(np.uint64), heavy[1].astype(np.int64))
    shared = source.sparkSession.sparkContext.broadcast((codes, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        codes, counts = shared.value
        for batch in batches:
            sizes, digests, prefixes = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                own = shingle_set(text.encode().lower().split() if text else [], hashes, width)
                n = len(own)
                sizes.append(n)
                digests.append(digest(own))
                if n:
                    keep = n - behind(n)
                    order = mixed(own)
                    if len(codes):
                        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
                        weight = np.where(codes[at] == own, counts[at], 0)
                        pick = np.lexsort((order, weight))[:keep]
                    else:
                        pick = np.argsort(order)[:keep]
                    prefixes.append(own[pick].tobytes())
                else:
                    prefixes.append(b"")
            cols = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "n", "digest", "prefix"])

    return source.mapInArrow(run, "doc_id long, key long, n long, digest binary, prefix binary")


def digest(own: np.ndarray) -> bytes:
    """128 bits of a set; equal sets have equal ones."""
    import xxhash

    return xxhash.xxh3_128_digest(own.tobytes())


def heavy_shingles(source: DataFrame, width: int, local: int = 4, size: int = 1 << 17) -> np.ndarray:
    """The shingles that recur most: tasks count theirs and name those that recur in a chunk; the sums of these give at most
    `size` heavy ones (two rows: hashes in order, counts). They stand last in the order of shingles, which any set may define, so
    they decide how much is compared and never what is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        parts: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            codes, counts = np.unique(np.concatenate(parts), return_counts=True)
            parts.clear()
            often = counts >= local
            return pa.RecordBatch.from_arrays([pa.array(codes[often].view(np.int64)), pa.array(counts[often])], names=["h", "n"])

        size = 0
        for batch in batches:
            for text in batch.column(0):
                parts.append(shingle_set(text.as_py().encode().lower().split(), hashes, width))
                size += len(parts[-1])
                if size >= BUCKET_TOKENS:
                    yield out()
                    size = 0
        if parts:
            yield out()

    sums = source.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.desc("n"), "h").limit(size).toPandas()
    codes = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(codes)
    return np.stack([codes[order], top["n"].to_numpy(np.int64).astype(np.uint64)[order]]) if len(codes) else np.zeros((0, 0))


def shared_prefixes(reps: DataFrame, blocks: int) -> DataFrame:
    """(token, rep, n, grp, weight) of the prefix shingles that at least two different sets have, for sets that share enough of theirs.

    Sets lie in blocks by their number. A block sends each of its shingles once, with a count, to the shingle's bucket, and gets
    back those that recur over all blocks with their counts: a shingle that a third of all sets have costs an entry a block. Each set
    then joins the group (grp) of the shingle of its prefix that most sets have; weight is the mean count of its shingles.
    """

    def spread(part: pa.Table) -> pa.Table:
        tokens, counts = np.unique(joined_blobs(part["prefix"], np.uint64), return_counts=True)
        rows = list(by_bucket((tokens % np.uint64(blocks)).astype(np.int32), [tokens, counts.astype(np.int32)]))
        cols = [pa.array([b for b, _ in rows], pa.int32()), *(pa.array([x[k] for _, x in rows], pa.binary()) for k in range(2))]
        return pa.Table.from_arrays([cols[0], pa.array([part["block"][0].as_py()] * len(rows), pa.int32()), *cols[1:]], names=["bucket", "block", "token", "many"])

    def decide(part: pa.Table) -> pa.Table:
        sizes = [len(x.as_py()) // 8 for chunk in part["token"].chunks for x in chunk]
        block = np.repeat(part["block"].to_numpy(), sizes)
        token, many = joined_blobs(part["token"], np.uint64), joined_blobs(part["many"], np.int32)
        order = np.argsort(token, kind="stable")
        token, many, block = token[order], many[order], block[order]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        total = np.repeat(np.add.reduceat(many.astype(np.int64), starts), np.diff(np.concatenate([starts, [len(token)]])))
        keep = total > 1
        rows = list(by_bucket(block[keep], [token[keep], total[keep]])) if keep.any() else []
        cols = [pa.array([b for b, _ in rows], pa.int32()), *(pa.array([x[k] for _, x in rows], pa.binary()) for k in range(2))]
        return pa.Table.from_arrays(cols, names=["block", "token", "df"])

    def settle(sets: pa.Table, answers: pa.Table) -> pa.Table:
        known, df = joined_blobs(answers["token"], np.uint64), joined_blobs(answers["df"], np.int64)
        order = np.argsort(known)
        known, df = known[order], df[order]
        out: list[tuple] = []
        for rep, n, prefix in zip(sets["rep"].to_pylist(), sets["n"].to_pylist(), sets["prefix"], strict=True):
            own = np.frombuffer(prefix.as_py(), np.uint64)
            if not len(known):
                break
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            shared = known[at] == own
            if shared.sum() >= -(-n // 10):
                own, count = own[shared], df[at[shared]]
                grp = own[np.lexsort((own, count))[-1]]
                out.append((own, rep, n, grp, count.mean()))
        many = [len(x[0]) for x in out]
        cols = [
            np.concatenate([x[0] for x in out]).view(np.int64) if out else np.zeros(0, np.int64),
            *(np.repeat(np.array([x[k] for x in out], dtype=kind), many) for k, kind in ((1, np.int64), (2, np.int64))),
            np.repeat(np.array([x[3] for x in out], dtype=np.uint64).view(np.int64), many),
            np.repeat(np.array([x[4] for x in out], dtype=np.float64), many),
        ]
        return pa.Table.from_arrays([pa.array(c) for c in cols], names=["token", "rep", "n", "grp", "weight"])

    own = reps.select("rep", "n", "prefix", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block"))
    sent = own.select("block", "prefix").groupBy("block").applyInArrow(spread, "bucket int, block int, token binary, many binary")
    answers = sent.groupBy("bucket").applyInArrow(decide, "block int, token binary, df binary")
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(settle, "token long, rep long, n long, grp long, weight double")


def query_groups(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, n, to, leader of to) that pass the bound, and the members (rep, n, grp).

    The matrix holds the union of each group's prefix shingles; a set has to open a group only if it shares enough shingles with
    that union.
    """
    members = kept.groupBy("rep").agg(F.first("n").alias("n"), F.first("grp").alias("grp"), F.first("weight").alias("weight"))
    leaders = members.groupBy("grp").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("leader"))
    matrix = kept.select("token", F.col("grp").alias("to")).distinct()
    overlap = kept.select("token", "rep", "n").join(matrix, "token").groupBy("rep", "n", "to").agg(F.count("*").alias("common"))
    opened = overlap.filter(F.col("common") >= least_overlap(F.col("n"))).join(leaders.withColumnRenamed("grp", "to"), "to")
    return opened.select("rep", "n", "to", "leader"), members.select("rep", "n", "grp")


def token_arrays(source: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Whole sets (rep, tokens) of the wanted (rep, doc_id, key) only, worked out from their texts again."""
    texts = source.join(wanted, ["doc_id", "key"]).select("rep", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            own = [shingle_set(t.as_py().encode().lower().split(), hashes, width).view(np.int64) for t in batch.column(1)]
            offsets = pa.array(np.cumsum([0, *map(len, own)]), pa.int32())
            flat = pa.array(np.concatenate(own) if own else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["rep", "tokens"])

    return texts.mapInArrow(run, "rep long, tokens array<long>").groupBy("rep").agg(F.first("tokens").alias("tokens"))  # rows may be repeated


def linked(common, n, m):
    return 100 * common >= 80 * (n + m - common)


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, chunk: int = 64, blocks: int | None = None, with_text: bool = False
) -> DataFrame:
    """Links texts whose sets of distinct shingles have a Jaccard similarity of at least 0.8 and names connected components.

    Equal sets collapse to one. Sets that can have a link form groups (shared_prefixes, query_groups). Every set is first compared with
    the leaders of the groups it opens, which joins most of a group of near copies; then sets outside their group's largest
    component open the groups' members, packed `chunk` at a time, and only those of other components are compared (across). No pair that
    could be a link between two components stays uncompared or unconnected, and of the links found only those are kept that join two
    components, so a group's links are no more than its sets a task. Comparisons are over whole sets of 64-bit hashes of shingles.

    Returns id_col, n_shingles and component_id (the smallest id of the component; the document's own if it has no link). Words are runs
    of bytes other than white space after A-Z became lower case; a text of fewer than `width` words is one shingle; null, empty
    and blank texts have none and link with nothing. Rows with a null id have a null component and link with nothing. Rows of one id with
    different texts are each compared, and the id has the links of all of them; with_text adds text_key (xxhash64 of the text) and
    text_component, the component by this row's text alone. An empty table gives no rows; other columns are never read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "jaccard")
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).withColumn("key", F.xxhash64("text"))
    named = source.filter("doc_id is not null and text is not null")
    sets = scratch.keep(set_table(source, width, heavy_shingles(named, width)), "sets")
    full = sets.filter("doc_id is not null and n > 0")
    least = full.groupBy("digest").agg(F.min(F.struct("doc_id", "key", "n", "prefix")).alias("s"), F.count("*").alias("rows"))
    reps = scratch.keep(
        least.select(F.monotonically_increasing_id().alias("rep"), "digest", "rows", F.col("s.doc_id").alias("doc_id"), "s.key", "s.n", "s.prefix"), "reps"
    )
    rows = scratch.keep(sets.select("doc_id", "key", "n", "digest"), "rows")
    scratch.drop("sets")
    tokens = reps.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    kept = scratch.keep(shared_prefixes(reps, blocks or max(1, -(-int(tokens) // BUCKET_TOKENS))), "kept")
    opened, members = (scratch.keep(x, name) for x, name in zip(query_groups(kept), ("opened", "members"), strict=True))
    scratch.drop("kept")
    heads = scratch.keep(reps.drop("prefix"), "heads")
    scratch.drop("reps")
    arrays = scratch.keep(token_arrays(named, heads.select("rep", "doc_id", "key").join(members.select("rep"), "rep"), width), "arrays")
    size = lambda a: F.size(a).cast("long")
    left = opened.filter("rep <> leader").select("rep", "leader").distinct().join(arrays, "rep").withColumnRenamed("tokens", "a")
    pairs = left.join(arrays.select(F.col("rep").alias("leader"), F.col("tokens").alias("b")), "leader")
    common = F.size(F.array_intersect("a", "b")).cast("long")
    stars = scratch.keep(pairs.filter(linked(common, size("a"), size("b"))).select(F.col("rep").alias("a"), F.col("leader").alias("b")), "stars")
    first = connected(stars).withColumnRenamed("id", "rep")
    placed = scratch.keep(members.join(first, "rep", "left").select("rep", "n", "grp", F.coalesce("component", "rep").alias("component")), "placed")
    ranked = placed.join(placed.groupBy("component").agg(F.count("*").alias("size")), "component")
    edges = stars.unionByName(scratch.keep(across(ranked, opened, arrays, chunk), "across"))
    scratch.drop("arrays", "opened", "members", "placed")
    of_text = named_sets(heads, edges)
    out = rows.join(of_text.withColumnRenamed("component_id", "named"), "digest", "left")
    out = out.withColumn("text_component", F.when(F.col("doc_id").isNotNull(), F.coalesce("named", "doc_id"))).drop("named")
    own = rows.filter("doc_id is not null and n > 0").select("doc_id", "digest")
    several = own.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high")
    if several.isEmpty():
        out = out.withColumn("component_id", F.col("text_component"))
    else:
        same = own.join(several.select("doc_id", "low"), "doc_id").filter("digest <> low").select("digest", "low").distinct()
        node = heads.select("digest", "rep")
        same = same.join(node, "digest").select(F.col("rep").alias("a"), F.col("low").alias("digest")).join(node, "digest").select("a", F.col("rep").alias("b"))
        of_set = named_sets(heads, edges.unionByName(scratch.keep(same, "same")))
        of_id = own.join(of_set, "digest").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        out = out.join(of_id, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "text_component"))
    extra = [F.col("key").alias("text_key"), "text_component"] if with_text else []
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", *extra)


def named_sets(heads: DataFrame, edges: DataFrame) -> DataFrame:
    """(digest, component_id) of the sets that have links or several rows: the smallest id of their component."""
    final = connected(edges).withColumnRenamed("id", "rep")
    found = heads.join(final, "rep")
    names = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    alone = heads.filter("rows > 1").join(final, "rep", "left_anti").select("digest", F.col("doc_id").alias("component_id"))
    return found.join(names, "component").select("digest", "component_id").unionByName(alone)


class Forest(dict):
    """Which components a task has joined so far; forgotten beyond a bound, which costs links that are found again, and loses none."""

    def root(self, x: int) -> int:
        top = x
        while (up := self.get(top, top)) != top:
            top = up
        while x != top:
            self[x], x = top, self.get(x, x)
        return top

    def joined(self, a: int, b: int) -> None:
        if len(self) > 1_000_000:
            self.clear()
        self[a] = b


class Pack:
    """Some sets of a group: numbers, components, sizes of these, tokens end to end."""

    def __init__(self, rows):
        self.reps, self.comps, self.sizes = (rows.field(c).to_numpy() for c in ("rep", "component", "size"))
        lists = rows.field("tokens")
        self.ends = lists.offsets.to_numpy()
        self.flat = lists.values.to_numpy().view(np.uint64)
        self.n = np.diff(self.ends)

    def tokens(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i] : self.ends[i + 1]]


def common_tokens(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the others are in own (in order as unsigned numbers)."""
    return own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others


def across(ranked: DataFrame, opened: DataFrame, arrays: DataFrame, chunk: int) -> DataFrame:
    """Links that join different components: packed sets of smaller components against packed members of the groups they open."""
    largest = ranked.groupBy("grp").agg(F.max(F.struct("size", "component")).alias("top"))
    asks = (
        opened.select("rep", F.col("to").alias("grp"))
        .join(ranked.select("rep", "n", "component", "size"), "rep")
        .join(largest, "grp")
        .filter(F.struct("size", "component") < F.col("top"))
        .select("grp", "rep", "n", "component", "size")
    )
    members = ranked.join(asks.select("grp").distinct(), "grp", "left_semi").select("grp", "rep", "n", "component", "size")

    def packed(rows: DataFrame, name: str) -> DataFrame:
        parts = F.ceil(F.greatest(F.count("*") / chunk, F.sum("n") / (512 * chunk)))
        dealt = rows.join(rows.groupBy("grp").agg(parts.alias("parts")), "grp")
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).join(arrays, "rep")
        return dealt.groupBy("grp", "part").agg(F.collect_list(F.struct("rep", "component", "size", "tokens")).alias(name)).drop("part")

    pairs = packed(asks, "asks").join(packed(members, "members"), "grp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            out: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                mine, theirs = Pack(batch.column("asks")[i].values), Pack(batch.column("members")[i].values)
                starts = theirs.ends[:-1] - theirs.ends[0]
                for k in range(len(mine.reps)):
                    own, component, size = mine.tokens(k), int(mine.comps[k]), mine.sizes[k]
                    may = (theirs.comps != component) & ((theirs.sizes > size) | ((theirs.sizes == size) & (theirs.comps > component)))
                    may &= (5 * theirs.n >= 4 * len(own)) & (4 * theirs.n <= 5 * len(own))
                    root = forest.root(component)
                    apart = [j for j in np.flatnonzero(may).tolist() if forest.root(int(theirs.comps[j])) != root]
                    if not apart:
                        continue
                    every = np.add.reduceat(common_tokens(own, theirs.flat[theirs.ends[0] : theirs.ends[-1]]), starts, dtype=np.int64) if len(apart) > 8 else None
                    for j in apart:
                        other = forest.root(int(theirs.comps[j]))
                        if other != root:
                            common = int(common_tokens(own, theirs.tokens(j)).sum()) if every is None else int(every[j])
                            if linked(common, len(own), int(theirs.n[j])):
                                out.append((int(mine.reps[k]), int(theirs.reps[j])))
                                forest.joined(root, other)
                                root = other
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return pairs.select("asks", "members").mapInArrow(compare, "a long, b long")
