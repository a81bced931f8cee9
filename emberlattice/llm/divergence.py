"""Source divergence audit: how far the word use of a language's sources lies apart, over run-length columns of counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlattice.scratch import Scratch, small_batches

#: Every byte that belongs to no term becomes a space; only A-Z are lower-cased. Bytes of non-ASCII characters stay.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
UNIT = 1_000_000_000
#: Terms that a task tallies before it hands them on.
TALLY = 400_000
#: Terms of one shard of the vocabulary and cells of its columns, at most; sources of one block.
SHARD_TERMS, SHARD_CELLS, SOURCES = 4096, 1 << 20, 256


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split() if text else []


def tallies(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, summed up in tasks as far as TALLY goes."""

    def emit(counts: dict, found: dict) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], []]
        for key, c in counts.items():
            d = found[key]
            for col, values in zip(cols, ([key[0]] * len(c), [key[1]] * len(c), list(c), list(c.values()), list(map(d.__getitem__, c))), strict=True):
                col += values
        types = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
        arrays[2] = arrays[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}
        found: dict[tuple, Counter] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = terms(text.as_py())
                if not words:
                    continue
                key = (lang, source)
                if key not in counts:
                    counts[key], found[key] = Counter(), Counter()
                c = counts[key]
                size -= len(c)
                c.update(words)
                size += len(c)
                found[key].update(set(words))
                if size >= TALLY:
                    yield emit(counts, found)
                    counts, found, size = {}, {}, 0
        if counts:
            yield emit(counts, found)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the terms that at least min_docs documents of their language hold; first marks one row a term. One
    shuffle by language and term serves the counts of sources and of languages."""
    met = tallies(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    met = met.withColumn("lang_docs", F.sum("docs").over(term)).filter(F.col("lang_docs") >= min_docs)
    met = met.withColumn("lang_n", F.sum("n").over(term)).withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
    return met.select("lang", "source", "term", "n", "lang_n", "first")


def share(n: Column, total: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / total), exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(n + 1), wide(total)) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shares_of(n: np.ndarray, total: int) -> np.ndarray:
    if len(n) and int(n.max()) >= 9_000_000_000:
        return np.array([1 + UNIT * (int(x) + 1) // total for x in n], dtype=np.int64)
    return 1 + UNIT * (n + 1) // total


def runs_of(column: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal counts start, and each run's share."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1])
    return starts, shares_of(column[starts], total)


def run_divergences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int) -> tuple[int, int]:
    """Sums of f of a against b and of b against a over two run-length columns: each stretch in which neither changes counts by its length."""
    (at, p), (bt, q) = a, b
    bounds = np.unique(np.concatenate([at, bt]))
    length = np.diff(bounds, append=size)
    p, q = p[np.searchsorted(at, bounds, "right") - 1], q[np.searchsorted(bt, bounds, "right") - 1]
    square = (p - q) * (p - q)
    return int((square // q * length).sum()), int((square // p * length).sum())


def pair_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value, present): for each ordered pair of sources of a language the sum of f over the kept terms that a source of their two blocks
    holds, and the number of these terms.

    The vocabulary is dealt to shards, sources to blocks; a task has one shard's columns of two blocks. It orders the terms by their counts, the largest
    source's first, so that equal counts stand together, and keeps each column as runs."""
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    both = F.transform(upto("blocks"), lambda x: F.struct(F.least(F.col("block"), x), F.greatest(F.col("block"), x)))
    met = F.explode(both.cast("array<struct<low:bigint,high:bigint>>")).alias("met")
    key = ["lang", "shard", "low", "high"]
    left = counts.select("lang", F.pmod(F.xxhash64("term"), "shards").alias("shard"), "at", "term", "n", met).select(*key[:2], "met.*", "at", "term", "n")
    right = groups.select("lang", F.explode(upto("shards")).alias("shard"), "at", "block", (F.col("total") + F.col("kept")).alias("total"), met).select(*key[:2], "met.*", "at", "block", "total")

    def run(name: tuple, cells: pa.Table, sources: pa.Table) -> pa.Table:
        lang, low, high = name[0].as_py(), name[2].as_py(), name[3].as_py()
        order = np.argsort(sources["at"].to_numpy())
        at, block, total = (sources[c].to_numpy()[order] for c in ("at", "block", "total"))
        term = cells["term"].combine_chunks().dictionary_encode()
        size = len(term.dictionary)
        columns = np.zeros((len(at), size), dtype=np.int64)
        columns[np.searchsorted(at, cells["at"].to_numpy()), term.indices.to_numpy()] = cells["n"].to_numpy()
        columns = columns[:, np.lexsort(columns[::-1])] if size else columns
        runs = [runs_of(c, int(t)) for c, t in zip(columns, total, strict=True)] if size else []
        out = []
        for i in range(len(at)):
            for j in range(i + 1, len(at)):
                if low == high or block[i] != block[j]:
                    there, back = run_divergences(runs[i], runs[j], size) if size else (0, 0)
                    out += [(at[i], at[j], there), (at[j], at[i], back)]
        a, b, value = (np.array([x[k] for x in out], dtype=np.int64) for k in range(3))
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "a": a, "b": b, "value": value, "present": np.full(len(out), size, dtype=np.int64)})

    sums = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "lang string, a long, b long, value long, present long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("present").alias("present"))


def audit(
    docs: DataFrame, min_docs: int = 3, most: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language, part `pair` ranks all other sources by how far its shares of the kept terms
    lie from theirs, part `term` its own terms (up to `most`) that exceed the language's share, by how much.

    A language keeps the terms (runs of letters, A-Z lower-cased) that at least min_docs of its documents hold. A share is 1 + floor(10^9 * (count + 1) /
    (all counts + number of kept terms)), a distance floor((p - q)^2 / q); all arithmetic is exact. Pairs are summed over run-length columns of shards of
    the vocabulary. A null text, lang or source reads as ''. A source without terms, or a language that keeps none, has its pairs all the same
    (value 0 where nothing is kept); ties go to the smaller item by UTF-8; repeated rows count as documents of their own; an empty table gives no
    rows; other columns are left aside. Ids aren't looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "divergence")
    own = docs.select(*(F.coalesce(docs[c], F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    kept = scratch.keep(kept_terms(own, min_docs), "kept")
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("kept"), F.sum(F.when(F.col("first"), F.col("lang_n")).otherwise(0)).alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    lang = Window.partitionBy("lang")
    groups = groups.withColumn("at", (F.row_number().over(lang.orderBy(F.col("total").desc(), "source")) - 1).cast("long")).withColumn("sources", F.count("*").over(lang))
    size = F.least(F.lit(SHARD_TERMS), F.greatest(F.lit(SHARD_CELLS) / F.least("sources", F.lit(2 * SOURCES)), F.lit(1)))
    groups = groups.withColumns(
        {"shards": F.greatest(F.ceil(F.col("kept") / size), F.lit(1)).cast("long"), "blocks": F.ceil(F.col("sources") / SOURCES).cast("long"), "block": F.floor(F.col("at") / SOURCES).cast("long")}
    )
    groups = scratch.keep(groups, "groups")
    counts = kept.join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total") + F.col("kept")), share(F.col("lang_n"), F.col("lang_total") + F.col("kept"))
    over = counts.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    over = over.select("lang", "source", F.lit("term").alias("part"), "item", divergence(F.col("p"), F.col("q")).alias("value"))
    sums = pair_sums(counts, groups.toDF(*groups.columns))
    one, other = (groups.select("lang", F.col("at").alias(k), F.col("source").alias(f"{k}_source"), F.col("total").alias(f"{k}_total"), *more) for k, more in (("a", ["kept"]), ("b", [])))
    named = sums.join(one, ["lang", "a"]).join(other, ["lang", "b"])
    none = divergence(share(F.lit(0), F.col("a_total") + F.col("kept")), share(F.lit(0), F.col("b_total") + F.col("kept")))
    rest = F.when(F.col("kept") > F.col("present"), (F.col("kept") - F.col("present")) * none).otherwise(0)  # the run of terms that neither block holds
    pairs = named.select("lang", F.col("a_source").alias("source"), F.lit("pair").alias("part"), F.col("b_source").alias("item"), (F.col("value") + rest).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).union(over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
