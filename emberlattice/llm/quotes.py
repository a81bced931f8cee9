"""Quotation linking: quoted passages of messages are traced to the messages they come from, and conversations put in reply order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
ATTRIBUTION = re.compile(r"^\s*(on\b.*\bwrote|.{1,80}\b(wrote|writes|said))\s*:\s*$", re.I)
WORDS = re.compile(r"\w+")


def normal_hash(text: str) -> int | None:
    """Hash of a passage by its words in lower case, signed 64 bits; None without words."""
    words = WORDS.findall(text.lower())
    return xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63) if words else None


def parsed(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The message's own lines, and its quoted passages (level, text): runs of lines of one level without their marks. A line that
    only names whom the next line quotes goes."""
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    previous = 0
    for line in text.split("\n"):
        found = MARKS.match(line)
        level = found.group(1).count(">") if found else 0
        if level:
            if previous == 0:
                while own and not own[-1].strip():
                    own.pop()
                if own and ATTRIBUTION.match(own[-1]):
                    own.pop()
            if level != previous:
                quotes.append((level, []))
            quotes[-1][1].append(line[found.end() :])
        else:
            own.append(line)
        previous = level
    return "\n".join(own).strip() if quotes else text, [(n, "\n".join(x)) for n, x in quotes]


def outline(text: str) -> list[list[int]]:
    """Hashes of each paragraph with words: of the whole of it, then of its lines."""
    parts = [[normal_hash(p), *map(normal_hash, p.split("\n"))] for p in re.split(r"\n\s*\n", text)]
    return [[h for h in p if h is not None] for p in parts if p[0] is not None]


def holds(said: list[list[int]], units: list[list[int]]) -> bool:
    """Whether a message's outline holds a quote's paragraphs in their order, each as a paragraph or by all its lines in their order; what was
    left out between them doesn't matter. The earliest end for each paragraph leaves most to the next ones."""
    lines, starts = [], {}
    for p in said:
        starts.setdefault(p[0], []).append((len(lines), len(lines) + len(p) - 1))
        lines += p[1:]
    at = 0
    for p in units:
        ends = [b for a, b in starts.get(p[0], ()) if a >= at][:1]
        n = at
        for h in p[1:]:
            while n < len(lines) and lines[n] != h:
                n += 1
            n += 1
        if n <= len(lines):
            ends.append(n)
        if not ends:
            return False
        at = min(ends)
    return True


def reply_order(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", stored=lambda df: df
) -> DataFrame:
    """Messages without their quotes, each with its place in the reply order of its conversation.

    A quoted passage is traced to the latest earlier message of the conversation whose own text, a paragraph or a line of it has
    the same words, or that holds all paragraphs of the passage in their order, each whole or by its lines. A message replies to the latest message that its shallowest traced level of quotes leads to. Replies follow their parent depth first,
    siblings and messages without a parent by turn. Origins are found by sorting passages of one conversation and hash by turn,
    so that a common passage makes no pairs; places are counted by range partitions, so that a large conversation is no one task's.

    Returns conv_col, turn_col, role_col, position (from 0), parent_turn, depth, n_quotes, n_linked and text_col (without quotes). Null texts stay null and
    quote nothing; rows with a null conversation or turn link with nothing, a null turn stands last in its conversation; repeated rows
    each have a place, in an order by turn, role and text; an empty table gives no rows. Other columns are never read.
    """
    source = messages.select(
        messages[conv_col].alias("conv"), messages[turn_col].cast("long").alias("turn"), messages[role_col].cast("string").alias("role"), messages[text_col].alias("text")
    )
    kind = source.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, turn long, role string, own string, quotes array<struct<level:int,hash:long,units:array<array<long>>>>, whole long, said array<array<long>>"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.list_(pa.int64()))
        quote = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("units", lists)]))
        for batch in batches:
            owns, quotes, wholes, said = [], [], [], []
            for text in batch.column(3):
                text = text.as_py()
                own, q = parsed(text) if text is not None else (None, [])
                owns.append(own)
                quotes.append([{"level": n, "hash": normal_hash(x), "units": outline(x)} for n, x in q])
                wholes.append(normal_hash(own) if own else None)
                said.append(outline(own) if own else [])
            cols = [*batch.columns[:3], pa.array(owns, pa.string()), pa.array(quotes, quote), pa.array(wholes, pa.int64()), pa.array(said, lists)]
            yield pa.RecordBatch.from_arrays(cols, names=["conv", "turn", "role", "own", "quotes", "whole", "said"])

    rows = stored(source.mapInArrow(parse, schema).withColumn("key", F.xxhash64("conv", "turn", "role", "own", "quotes")))
    placed = rows.filter("conv is not null and turn is not null")
    traced = _traced(placed, kind, stored)
    parents = traced.groupBy("conv", "turn", "key").agg(
        F.max(F.struct(-F.col("level"), "origin"))["origin"].alias("parent"), F.count("*").alias("n_linked")
    )
    linked = stored(rows.join(parents, ["conv", "turn", "key"], "left"))
    tree = _paths(linked.filter("parent is not null").select("conv", "turn", F.col("parent")).groupBy("conv", "turn").agg(F.max("parent").alias("parent")), stored)
    full = linked.join(tree, ["conv", "turn"], "left").withColumn("path", F.coalesce("path", F.array("turn")))
    spread = _positions(full.select("conv", "turn", "role", "own", "quotes", "parent", "n_linked", "path"), stored)
    return spread.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.col("role").alias(role_col),
        F.when(F.col("conv").isNotNull(), F.col("position")).alias("position"),
        F.col("parent").alias("parent_turn"),
        (F.size("path") - 1).cast("long").alias("depth"),
        F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("own").alias(text_col),
    )


def _traced(placed: DataFrame, kind: str, stored) -> DataFrame:
    """(conv, turn, key, at, level, origin): the quotes that have an origin.

    A round finds, for each piece of a quote, the latest turn before the bound that says it; no later turn than the least of
    these can hold the quote. If that turn's message doesn't hold the whole of it, it is the next round's bound.
    """
    me = ["conv", "turn", "key", "at"]
    each = placed.filter("size(quotes) > 0").select("conv", "turn", "key", F.posexplode("quotes").alias("at", "q")).select(*me, "q.level", "q.hash", "q.units")
    asking = stored(each.filter("hash is not null").distinct().withColumn("bound", F.col("turn")))
    traced = asking.select(*me, "level", F.col("bound").alias("origin"))
    if asking.isEmpty():
        return traced
    sought = asking.select("conv", F.explode(F.concat(F.array("hash"), F.flatten("units"))).alias("hash")).distinct()
    told = placed.select("conv", "turn", F.explode(F.concat(F.array("whole"), F.flatten("said"))).alias("hash")).distinct()
    told = stored(told.join(sought, ["conv", "hash"], "left_semi").withColumn("origin", F.col("turn")))
    earlier = Window.partitionBy("conv", "hash").orderBy("bound").rangeBetween(Window.unboundedPreceding, -1)
    schema = f"conv {kind}, turn long, key long, at int, ok boolean"

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [holds(said or [], units) for said, units in zip(batch.column(5).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ok, pa.bool_())], names=[*me, "ok"])

    done = None
    while True:
        unit = asking.select(*me, "bound", F.lit(-1).alias("u"), F.array("hash").alias("unit")).unionByName(asking.select(*me, "bound", F.posexplode("units").alias("u", "unit")))
        piece = unit.select(*me, "bound", "u", F.posexplode("unit").alias("line", "hash"))
        both = piece.withColumn("origin", F.lit(None).cast("long")).unionByName(told.select("conv", "hash", F.col("turn").alias("bound"), "origin"), allowMissingColumns=True)
        seen = both.withColumn("origin", F.max("origin").over(earlier)).filter("key is not null")
        lined = F.when(F.count(F.when(F.col("line") > 0, F.col("origin"))) == F.count_if(F.col("line") > 0), F.min(F.when(F.col("line") > 0, F.col("origin"))))
        units = seen.groupBy(*me, "u").agg(F.greatest(F.max(F.when(F.col("line") == 0, F.col("origin"))), lined).alias("origin"))
        inner = F.when(F.count(F.when(F.col("u") >= 0, F.col("origin"))) == F.count_if(F.col("u") >= 0), F.min(F.when(F.col("u") >= 0, F.col("origin"))))
        best = units.groupBy(*me).agg(F.max(F.when(F.col("u") < 0, F.col("origin"))).alias("full"), inner.alias("inner"))
        best = best.withColumn("origin", F.greatest("full", "inner")).filter("origin is not null")
        best = stored(asking.drop("bound").join(best, me).withColumn("sure", F.coalesce(F.col("full") == F.col("origin"), F.lit(False))))
        unsure = best.filter("not sure").select(*me, "units", "origin")
        there = unsure.join(placed.select("conv", F.col("turn").alias("origin"), "said"), ["conv", "origin"]).select(*me, "units", "said")
        good = there.mapInArrow(check, schema).filter("ok").select(*me).distinct().withColumn("ok", F.lit(True))
        judged = stored(best.join(good, me, "left").withColumn("ok", F.col("sure") | F.coalesce("ok", F.lit(False))))
        new = judged.filter("ok").select(*me, "level", "origin")
        done = new if done is None else done.unionByName(new)
        asking = judged.filter("not ok").select(*me, "level", "hash", "units", F.col("origin").alias("bound"))
        if asking.isEmpty():
            return done


def _paths(edges: DataFrame, stored) -> DataFrame:
    """(conv, turn, path): turns from the thread's first message down to each reply; each round doubles the distance looked up."""
    state = stored(edges.select("conv", "turn", F.col("parent").alias("top"), F.array("turn").alias("path"), F.lit(False).alias("done")))
    while not state.filter("not done").isEmpty():
        above = state.select("conv", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("path").alias("upper"), F.col("done").alias("over"))
        joined = state.join(above, ["conv", "top"], "left")
        state = stored(
            joined.select(
                "conv",
                "turn",
                F.when(F.col("done") | F.col("next").isNull(), F.col("top")).otherwise(F.col("next")).alias("top"),
                F.when(F.col("done"), F.col("path"))
                .when(F.col("next").isNull(), F.concat(F.array("top"), "path"))
                .otherwise(F.concat("upper", "path"))
                .alias("path"),
                (F.col("done") | F.col("next").isNull() | F.col("over")).alias("done"),
            )
        )
    return state.select("conv", "turn", "path")


def _positions(rows: DataFrame, stored) -> DataFrame:
    """Adds the place of each row in its conversation's order: range partitions number their rows, and each adds what
    the partitions before it hold of the conversation."""
    order = ["conv", "last", "path", "turn", "role", "own"]
    ranged = rows.withColumn("last", F.col("turn").isNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, n = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            local = []
            for value in batch.column(0).to_pylist():
                n = n + 1 if value == conv else 0
                conv = value
                local.append(n)
            cols = [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(local, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "part", "local"])

    numbered = stored(ranged.mapInArrow(number, f"{kinds}, part int, local long"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("conv", "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    own = counts.select(F.col("conv").alias("c"), F.col("part").alias("p"), "before")
    return numbered.join(own, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).withColumn("position", F.col("local") + F.col("before")).drop("c", "p")
