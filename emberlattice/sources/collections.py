"""Feature collections of any size in one file: many tasks read a file's stretches, cut at closing braces, and features that straddle them are joined again."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlattice.scratch import small_batches

STRING_OR_BRACKET = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*("?)|[{}\[\]]', re.S)
REST_OF_STRING = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*("?)', re.S)
KEY = ["path", "start"]


class Nesting:
    """Where in JSON a reader is: within a string or not, and how many braces and brackets are open."""

    def __init__(self, quoted: bool, braces: int, brackets: int):
        self.quoted, self.braces, self.brackets = quoted, braces, brackets

    def walk(self, text: str) -> Iterator[tuple[str, int]]:
        """Each brace of the text that isn't in a string, with its place; the nesting is that before an opening and after a closing one."""
        at = 0
        if self.quoted:
            rest = REST_OF_STRING.match(text)
            at, self.quoted = rest.end(), not rest.group(1)
        for m in STRING_OR_BRACKET.finditer(text, at):
            c = text[m.start()]
            if c == '"':
                self.quoted = not m.group(1)
            elif c == "{":
                yield c, m.start()
                self.braces += 1
            elif c == "}":
                self.braces -= 1
                yield c, m.start()
            else:
                self.brackets += 1 if c == "[" else -1


def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], str]]:
    """Runs of pieces of one stretch, each with its closing brace again."""
    for batch in batches:
        for key, rows in groupby(zip(batch["path"], batch["start"], batch["value"], strict=True), key=lambda r: (r[0], r[1])):
            yield (key[0], int(key[1])), "".join(r[2] + "}" for r in rows)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, value): text up to each closing brace, in order; start is that of the stretch which one task reads."""
    own = spark.read.option("lineSep", "}").text(path)
    return own.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def starts(own: DataFrame) -> dict[tuple[str, int], tuple[bool, int, int, int]]:
    """What each stretch starts with: within a string, open braces, open brackets, features begun before it. One row a stretch, as in Spark's own list of what its
    tasks read. Raises if a file ends within something.

    A first pass counts quotes that aren't escaped; with these known, a second one counts brackets, and objects begun at each depth.
    """
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    plain = F.regexp_replace("value", r"\\.", "")
    quotes = own.groupBy(*KEY).agg(F.sum(F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))).alias("quotes"))
    quoted = {(r["path"], r["start"]): bool(r["odd"]) for r in quotes.select(*KEY, (sum_before("quotes") % 2).alias("odd")).collect()}
    known = own.sparkSession.sparkContext.broadcast(quoted)

    def shape(batches):
        found = {}
        for key, text in stretches(batches):
            at, begun = found.setdefault(key, (Nesting(known.value[key], 0, 0), {}))
            for c, _ in at.walk(text):
                if c == "{":
                    depth = at.braces, at.brackets
                    begun[depth] = begun.get(depth, 0) + 1
        for key, (at, begun) in found.items():
            yield pd.DataFrame([(*key, at.quoted, at.braces, at.brackets, [{"b": b, "k": k, "n": n} for (b, k), n in begun.items()])], columns=[*KEY, "quoted", "b", "k", "begun"])

    shapes = own.mapInPandas(shape, "path string, start long, quoted boolean, b long, k long, begun array<struct<b:long,k:long,n:long>>")
    deep = shapes.select("*", sum_before("b").alias("b0"), sum_before("k").alias("k0"))
    mine = F.filter("begun", lambda s: (s["b"] + F.col("b0") == 1) & (s["k"] + F.col("k0") == 1))
    deep = deep.withColumn("n", F.coalesce(F.get(mine, F.lit(0))["n"], F.lit(0)))
    rows = deep.select(*KEY, "quoted", (F.col("b0") + F.col("b")).alias("b1"), (F.col("k0") + F.col("k")).alias("k1"), "b0", "k0", sum_before("n").alias("n0")).collect()
    for last in {r["path"]: r for r in sorted(rows, key=lambda r: r["start"])}.values():
        if last["quoted"] or last["b1"] > 0 or last["k1"]:
            raise ValueError(f"{last['path']} isn't whole")
    return {(r["path"], r["start"]): (quoted[r["path"], r["start"]], r["b0"], r["k0"], r["n0"]) for r in rows}


def feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, text): the objects in the lists of a file's outermost objects, numbered in their order from 0 in each file.

    Files are read by Spark's text source, so by any file system it knows and in as many tasks as they have stretches (`spark.sql.files.maxPartitionBytes`). Text
    isn't shuffled but for the two ends of a stretch. An empty file has no features; one that ends within an object, list or string raises ValueError.
    """
    small_batches(spark)
    own = pieces(spark, path)
    known = spark.sparkContext.broadcast(starts(own))

    def cut(batches):
        now = at = None
        number = 0
        held: list[str] | None = None  # the parts of the object that is being read
        for key, text in stretches(batches):
            if key != now:
                if held:
                    yield now, number - 1, False, "".join(held)
                now, (quoted, braces, brackets, number) = key, known.value[key]
                at = Nesting(quoted, braces, brackets)
                held = [] if number and braces > 1 and brackets else None
                begun_here = False
                inner = held is not None
            since = 0
            for c, place in at.walk(text):
                if at.braces == 1 and at.brackets == 1:
                    if c == "{":
                        held, since, begun_here, inner = [], place, True, True
                        number += 1
                    elif inner:
                        held.append(text[since : place + 1])
                        yield now, number - 1, begun_here, "".join(held)
                        held, inner = None, False
                elif c == "}" and at.braces == 1:  # the end of another member
                    held, inner = None, False
            if inner:
                held.append(text[since:])
        if held:
            yield now, number - 1, False, "".join(held)

    def rows(batches):
        for some in chunks(cut(batches)):
            yield pd.DataFrame([(k[0], k[1], n, whole, text) for k, n, whole, text in some], columns=[*KEY, "n", "whole", "text"])

    found = own.mapInPandas(rows, "path string, start long, n long, whole boolean, text string")
    ends = found.filter("not whole").groupBy("path", "n").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("parts"))
    return found.filter("whole").select("path", "n", "text").unionByName(ends.select("path", "n", F.array_join("parts.text", "").alias("text")))


def chunks(rows: Iterator[tuple], most: int = 4 << 20) -> Iterator[list[tuple]]:
    """Lists of rows that end once their texts reach a size."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[-1])
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some
