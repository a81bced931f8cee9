"""Hard-negative mining: exact inner products of many candidates at a time, packed into fields of one wide integer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlattice.llm.common import shuffle_partitions
from emberlattice.scratch import Scratch

#: Candidates in one wide integer: some kilobytes, so that the words of all components stay in a core's cache.
FIELDS = 2048
#: Anchors of one block, and packed blocks that one task compares with a block of anchors.
ANCHORS, BLOCKS = 2048, 64
#: Whole components must stay below this in size: scores are longs.
LARGEST = float(1 << 62)
LONG = range(-(1 << 63), 1 << 63)


def whole_vectors(vectors: DataFrame, scale: int, relabel: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and v = floor(scale * x) of every component x as double. Where vec_id is divisible by `relabel`, the label becomes
    (label + 1) % 10. Rows with a null id, label or vector, or a null or non-finite component, are left out; a component
    of 2^62 or more is an error."""
    own = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("long").alias("label"), F.transform(vectors[vector_col], lambda x: x.cast("double")).alias("v"))
    own = own.filter("vec_id is not null and label is not null and v is not null")
    own = own.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    fits = lambda x: F.when(F.abs(x * scale) < LARGEST, F.floor(x * scale)).otherwise(F.raise_error("a component is too large for whole scores").cast("long"))
    return own.select("vec_id", F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), F.transform("v", fits).alias("v"))


def rows_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The different rows (vec_id, label, components) of a table as whole numbers, by vec_id, and the place of each in the table; shorter vectors
    go on with zeros."""
    lists = table["v"].combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    out = np.zeros((len(lists), 2 + int(sizes.max(initial=0))), dtype=np.int64)
    if not len(out):
        return out, sizes
    out[:, 0], out[:, 1] = table["vec_id"].to_numpy(), table["label"].to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, 2 + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return np.unique(out, axis=0, return_index=True)


def field_bytes(bias: int, weight: int) -> int:
    """Bytes of a field, a multiple of 4, that hold any score of biased components between 0 and 2 * bias, offset to be positive, against an anchor whose
    components' sizes add up to `weight` at most."""
    return 4 * max(1, -(-(4 * bias * weight + 1).bit_length() // 32))


def packed(x: np.ndarray, bias: int, width: int) -> list[int]:
    """For each component one wide integer, whose field j holds the biased component of row j."""
    u = (x.astype(np.uint64) + np.uint64(bias)).T  # wraps: x + bias lies between 0 and 2 * bias
    fields = np.zeros((*u.shape, width // 4), dtype="<u4")
    fields[:, :, 0] = u & np.uint64(0xFFFFFFFF)
    if width > 4:
        fields[:, :, 1] = u >> np.uint64(32)
    return [int.from_bytes(f.tobytes(), "little") for f in fields]


def exact_scores(anchor: list[int], words: list[int], n: int, bias: int, width: int) -> np.ndarray:
    """Inner products of an anchor with the n packed rows: one multiplication a component, then the fields are taken apart. An offset keeps every
    field positive, so that none borrows from the next."""
    anchor = anchor[: len(words)]
    offset = 2 * bias * sum(map(abs, anchor))
    total = int.from_bytes(offset.to_bytes(width, "little") * n, "little")
    for a, w in zip(anchor, words):
        if a:
            total += a * w
    less = offset + bias * sum(anchor)
    raw = total.to_bytes(n * width, "little")
    if width <= 8 and offset < 1 << 62:
        return np.frombuffer(raw, dtype=f"<u{width}").astype(np.int64) - less
    parts = [int.from_bytes(raw[i : i + width], "little") - less for i in range(0, len(raw), width)]
    if not all(p in LONG for p in parts):
        raise OverflowError("a score is too large for a long")
    return np.array(parts, dtype=np.int64)


def bias_of(x: np.ndarray) -> int:
    """What makes every component positive or 0."""
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


def weight_of(x: np.ndarray) -> int:
    """At least the largest sum of component sizes of a row."""
    return int(np.abs(x.astype(np.float64)).sum(axis=1).max(initial=0) * (1 + 1e-9)) + 1


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller ids."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def positives(rows: DataFrame, anchors: DataFrame, n_pos: int) -> DataFrame:
    """(anchor_id, anchor, pos, positive_id, positive_score): each anchor's first n_pos rows of its label.

    Labels are cut into parts of some thousand rows, their anchors into blocks; each block meets each part once, so no label, however large,
    lands in one task."""
    sizes = rows.groupBy("label").agg(F.count("*").alias("n")).join(anchors.groupBy("label").agg(F.count("*").alias("m")), "label")
    sizes = sizes.select("label", F.ceil(F.col("n") / FIELDS).alias("parts"), F.ceil(F.col("m") / ANCHORS).alias("blocks"))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = rows.join(sizes, "label").withColumn("part", deal("parts")).withColumn("block", upto("blocks"))
    asking = anchors.join(sizes, "label").withColumn("block", deal("blocks")).withColumn("part", upto("parts"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, scores = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            (own, at), (other, _) = rows_of(left), rows_of(right)
            names, x = left["anchor"].to_numpy()[at], other[:, 2:]
            bias, width = bias_of(x), field_bytes(bias_of(x), weight_of(own[:, 2:]))
            words = [(i, packed(x[i : i + FIELDS], bias, width)) for i in range(0, len(x), FIELDS)]
            for row, name in zip(own, names, strict=True):
                anchor = row[2:].tolist()
                found = np.concatenate([exact_scores(anchor, w, min(FIELDS, len(x) - i), bias, width) for i, w in words])
                among = np.flatnonzero(other[:, 0] != row[0])
                among = among[best(found[among], other[among, 0], n_pos)]
                ids.append(np.stack([np.full(len(among), row[0]), np.full(len(among), name), other[among, 0]], axis=1))
                scores.append(found[among])
        table = np.concatenate(ids)
        return pa.table({"anchor_id": table[:, 0], "anchor": table[:, 1], "positive_id": table[:, 2], "positive_score": np.concatenate(scores)})

    key = ["label", "part", "block"]
    found = asking.select(*key, "vec_id", "anchor", "v").groupBy(*key).cogroup(held.select(*key, "vec_id", "v").groupBy(*key))
    found = found.applyInArrow(run, "anchor_id long, anchor long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id", "anchor").orderBy(F.col("positive_score").desc(), "positive_id")
    return found.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= n_pos)


def packed_blocks(rows: DataFrame, blocks: int, weight: int) -> DataFrame:
    """(block, ids, labels, bias, width, words): rows dealt by hash to blocks of about FIELDS, each as a wide integer a component."""

    def run(table: pa.Table) -> pa.Table:
        own, _ = rows_of(table)
        x = own[:, 2:]
        bias = bias_of(x)
        width = field_bytes(bias, weight)
        words = b"".join(w.to_bytes(width * len(x), "little") for w in packed(x, bias, width))
        one = {"block": table["block"][0].as_py(), "ids": own[:, 0].tobytes(), "labels": own[:, 1].tobytes(), "bias": bias, "width": width, "words": words}
        return pa.table({k: [v] for k, v in one.items()}, schema=pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("bias", pa.int64()), ("width", pa.int32()), ("words", pa.binary())]))

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(run, "block long, ids binary, labels binary, bias long, width int, words binary")


def hard_negatives(
    vectors: DataFrame,
    anchors: str,
    scale: int = 256,
    relabel: int = 7,
    n_pos: int = 5,
    n_neg: int = 10,
    floor: int = 30,
    ceiling: int = 90,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row where `anchors` (SQL over vec_id) holds and each of its
    first n_pos rows of the same label, the first n_neg rows of other labels with floor * positive_score <= 100 * negative_score <=
    ceiling * positive_score. Scores are exact inner products of whole components; ties go to smaller ids.

    Candidates are packed: their components, made positive by a bias, lie in separate fields of one wide integer a component, which a whole
    block of anchors meets by one multiplication each. Blocks of anchors meet blocks of candidates; what a task holds is bounded by ANCHORS, BLOCKS and FIELDS.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part; shorter vectors go on with zeros. Repeated rows count
    once; rows of one id with different vectors or labels count each, as candidates and as anchors, but never for their own id. An empty table gives no
    rows; other columns are left aside. A component of 2^62 or more, or a score beyond a long, is an error.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    rows = scratch.keep(whole_vectors(vectors, scale, relabel, id_col, vector_col, label_col), "rows")
    asking = rows.filter(anchors).dropDuplicates(["vec_id", "label", "v"]).withColumn("anchor", F.xxhash64("vec_id", "label", "v"))
    asking = scratch.keep(asking, "anchors")
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    m, weight = asking.agg(F.count("*"), F.max(size)).first()
    n = rows.count()
    taken = scratch.keep(positives(rows, asking, n_pos), "positives")
    na, nb = max(1, -(-m // ANCHORS)), max(1, -(-n // FIELDS))
    groups = max(-(-nb // BLOCKS), min(nb, -(-2 * shuffle_partitions(spark) // na)))
    blocks = scratch.keep(packed_blocks(rows, nb, int((weight or 0) * (1 + 1e-9)) + 1), "packed")
    wanted = taken.groupBy("anchor_id", "anchor").agg(F.collect_list(F.struct("pos", "positive_id", "positive_score")).alias("wanted"))
    asks = asking.join(wanted, (asking.vec_id == wanted.anchor_id) & (asking.anchor == wanted.anchor)).select(asking.anchor, "vec_id", "label", "v", "wanted")
    upto = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    left = asks.withColumn("ablock", F.pmod("anchor", F.lit(na))).withColumn("group", upto(groups))
    right = blocks.withColumn("group", F.pmod("block", F.lit(groups))).withColumn("ablock", upto(na))

    def run(own: pa.Table, held: pa.Table) -> pa.Table:
        found = []
        parts = []
        for b in held.to_pylist():
            ids, raw = np.frombuffer(b["ids"], np.int64), b["words"]
            step = b["width"] * len(ids)
            words = [int.from_bytes(raw[i : i + step], "little") for i in range(0, len(raw), step)]
            parts.append((ids, np.frombuffer(b["labels"], np.int64), words, b["bias"], b["width"]))
        for a in own.to_pylist() if parts else []:
            scores = np.concatenate([exact_scores(a["v"], words, len(ids), bias, width) for ids, _, words, bias, width in parts])
            ids, labels = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            other = labels != a["label"]
            for p in a["wanted"]:
                least, most = -(-floor * p["positive_score"] // 100), ceiling * p["positive_score"] // 100
                at = np.flatnonzero(other & (scores >= least) & (scores <= most))
                at = at[best(scores[at], ids[at], n_neg)]
                fixed = [a["vec_id"], a["anchor"], p["pos"], p["positive_id"], p["positive_score"]]
                found.append(np.concatenate([np.tile(np.array(fixed, np.int64), (len(at), 1)), ids[at][:, None], scores[at][:, None]], axis=1))
        table = np.concatenate(found) if found else np.zeros((0, 7), np.int64)
        return pa.table({k: table[:, i] for i, k in enumerate(names)})

    names = ["anchor_id", "anchor", "pos", "positive_id", "positive_score", "negative_id", "negative_score"]
    met = left.groupBy("ablock", "group").cogroup(right.groupBy("ablock", "group")).applyInArrow(run, ", ".join(f"{k} long" for k in names))
    order = Window.partitionBy("anchor_id", "anchor", "pos").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_neg)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
