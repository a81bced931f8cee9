"""Connected components: of links in general, and of hot cells on a lattice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlattice.scratch import Scratch, dealt, written


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every end of the links (a, b); the component is its smallest id.

    Rounds of large and small stars: every node links its larger neighbours to its smallest one, then all to the smallest, until only
    stars are left. Each round ends as a table in the shared folder, which replaces the one before; their number grows with the
    logarithm of the longest chain.
    """
    scratch = Scratch(links.sparkSession, "links")
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "round-0")
    for i in range(1, most_rounds + 1):
        if _are_stars(edges):
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(down.select("a", F.col("low").alias("b")))
        edges = scratch.keep(small.filter("a <> b").distinct(), f"round-{i}")
        scratch.drop(f"round-{i - 1}")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether each larger end has one link and is no smaller end of another."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def neighbours(cells: DataFrame, connectivity: int = 8, col: str = "cx", row: str = "cy", keys=("run_id",)) -> DataFrame:
    """Pairs of adjacent cells: (keys, col, row, to_col, to_row) for each cell and each existing neighbour (4 or 8)."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0) and (connectivity != 4 or not i or not j)]
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps))
    shifted = cells.select(*keys, col, row).distinct().withColumn("o", F.explode(offsets))
    shifted = shifted.select(*keys, F.col(col), F.col(row), (F.col(col) + F.col("o.i")).alias("to_col"), (F.col(row) + F.col("o.j")).alias("to_row"))
    other = cells.select(*keys, F.col(col).alias("to_col"), F.col(row).alias("to_row")).distinct()
    return dealt(shifted).join(dealt(other), [*keys, "to_col", "to_row"])


def lattice_components(cells: DataFrame, connectivity: int = 8, col: str = "cx", row: str = "cy", keys=("run_id",)) -> DataFrame:
    """(keys, col, row, component number) of the given hot cells, numbered in scan order: rows from the first, then columns.

    Each row's consecutive cells collapse into a run; runs of neighbouring rows that touch (overlap, or within one cell for 8
    neighbours) are linked; components of runs are found by stars. Cells per run vanish before the iteration. Runs and components
    are joined by keys and never broadcast, as there are more of them the more cells there are; the runs' numbers end as a table.
    """
    own = cells.select(*keys, F.col(col).cast("long").alias("c"), F.col(row).cast("long").alias("r")).distinct()
    along = Window.partitionBy(*keys, "r").orderBy("c")
    islands = own.withColumn("i", F.col("c") - F.row_number().over(along))
    runs = islands.groupBy(*keys, "r", "i").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    key = F.struct(*keys, "r", "lo")
    runs = written(runs.select(*keys, "r", "lo", "hi", key.alias("run")), "runs")
    reach = 0 if connectivity == 4 else 1
    below = runs.select(*keys, (F.col("r") - 1).alias("r"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("run").alias("b"))
    # within a row the runs are disjoint, so a block of columns keeps the range test to nearby runs
    block = 64
    blocks = lambda lo, hi: F.explode(F.sequence(F.floor(lo / block), F.floor(hi / block)))
    left = runs.withColumn("blk", blocks(F.col("lo") - reach, F.col("hi") + reach))
    right = below.withColumn("blk", blocks(F.col("lo2"), F.col("hi2")))
    touching = dealt(left).join(dealt(right), [*keys, "r", "blk"]).filter((F.col("lo2") <= F.col("hi") + reach) & (F.col("hi2") >= F.col("lo") - reach))
    found = connected(touching.select(F.col("run").alias("a"), "b").distinct())
    labelled = dealt(runs).join(dealt(found.withColumnRenamed("id", "run")), "run", "left").withColumn("component", F.coalesce("component", "run"))
    heads = labelled.select(*keys, "component").distinct()
    number = numbered(heads, keys, [F.col("component.r"), F.col("component.lo")])
    named = written(dealt(labelled).join(dealt(number), [*keys, "component"]).select(*keys, "r", "lo", "hi", "number"), "components")
    cells_of = named.select(*keys, "r", F.explode(F.sequence("lo", "hi")).alias("c"), "number")
    return cells_of.select(*keys, F.col("c").cast("int").alias(col), F.col("r").cast("int").alias(row), "number")


def numbered(df: DataFrame, keys, order) -> DataFrame:
    """Adds `number` from 1 by the order within the keys, without one task for a large key: range partitions number their rows, and each
    adds the counts of those before it."""
    from pyspark.sql.functions import spark_partition_id

    cols = [F.col(k) for k in keys]
    ranged = written(df.repartitionByRange(*cols, *order).withColumn("part", spark_partition_id()), "ranged")
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*keys, "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    local = Window.partitionBy(*keys, "part").orderBy(*order)
    return (
        dealt(ranged.withColumn("local", F.row_number().over(local))).join(dealt(counts), [*keys, "part"]).withColumn("number", F.col("local") + F.col("before")).drop("local", "before", "part")
    )
