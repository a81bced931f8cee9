"""The k nearest points of each point, over a quadtree that is split by counts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlattice.scratch import Scratch, dealt

#: Different positions in a leaf, at most (more only where they lie closer than the finest cells).
LEAF = 32
#: Cells start with about SHARE positions each and are halved up to DEPTH times.
SHARE, DEPTH = 4, 20
#: Points look HALO cells around; tiles are 2^TILE cells wide; so many pairs are held at a time.
HALO, TILE, PAIRS = 2, 5, 2_000_000


def cell(c: Column, e: Column | int) -> Column:
    """The coordinate of the cell of exponent e (its side is the start's times 2^e) that holds a cell of the finest exponent."""
    return F.call_function("shiftright", c, (F.lit(e) if isinstance(e, int) else e) + DEPTH)


def near2(v: str, low: Column, side: Column) -> Column:
    """Distance on one axis from v to the stretch low .. low + side, 0 within."""
    return F.greatest(low - F.col(v), F.lit(0.0), F.col(v) - low - side)


def far2(v: str, low: Column, side: Column) -> Column:
    return F.greatest(F.col(v) - low, low + side - F.col(v))


def stacked(points: DataFrame, keys: list[str], k: int, scratch: Scratch) -> tuple[DataFrame, bool]:
    """Points (keys, id, x, y, v) with m, the number of points of their position, and place among them by id; of a position only the first k stay, as no
    search wants more of it. And whether any position has more than one."""
    many = scratch.keep(points.groupBy(*keys, "x", "y").agg(F.count("*").alias("m")).filter(F.col("m") > 1), "many")
    here = Window.partitionBy(*keys, "x", "y").orderBy("id")
    first = points.join(many, [*keys, "x", "y"]).withColumn("place", F.row_number().over(here)).filter(F.col("place") <= k)
    alone = points.join(many, [*keys, "x", "y"], "left_anti").withColumns({"m": F.lit(1).cast("long"), "place": F.lit(1)})
    return alone.unionByName(first), not many.isEmpty()


def placed(points: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Adds want (how many neighbours there are to find), side (of a cell of exponent 0), lo_x and lo_y, tallest (the exponent of a cell that holds the whole run)
    and fx, fy (the finest cell)."""
    of = points.groupBy(*keys).agg(F.count("*").alias("n"), *(f(c).alias(f"{name}_{c}") for c in ("x", "y") for name, f in (("lo", F.min), ("hi", F.max))))
    w, h = F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y")
    long, short = F.greatest(w, h), F.least(w, h)
    share = SHARE / F.col("n")
    # cells of a flat run are strips of its length; none is finer than doubles can tell apart
    side = F.when(long <= 0, F.lit(1.0)).otherwise(F.greatest(F.sqrt(long * short * share), long * share, long * 1e-9, F.greatest(F.abs("hi_x"), F.abs("hi_y"), F.abs("lo_x"), F.abs("lo_y")) * 1e-8))
    tallest = F.greatest(F.ceil(F.log2(long / F.col("side"))) + 1, F.lit(0)).cast("int")
    of = of.withColumn("side", side).withColumn("tallest", F.when(long <= 0, F.lit(0)).otherwise(tallest))
    of = of.select(*keys, F.least("n", F.lit(k)).cast("int").alias("want"), "side", "tallest", "lo_x", "lo_y")
    fine = lambda c: F.floor((F.col(c) - F.col(f"lo_{c}")) / F.col("side") * float(1 << DEPTH)).cast("long")
    return points.join(F.broadcast(of), list(keys)).withColumns({"fx": fine("x"), "fy": fine("y")})


def leaves(spots: DataFrame, keys: list[str], most: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The points with their leaves' exponent e, cx and cy, and the crowded cells of exponent 0. A cell with more than `most` positions is split, so only crowded ones go on."""
    done, now, e, crowded = [], spots, 0, None
    while True:
        here = now.withColumns({"e": F.lit(e), "cx": cell(F.col("fx"), e), "cy": cell(F.col("fy"), e)})
        if e == -DEPTH:
            done.append(here)
            break
        over = here.filter("place = 1").groupBy(*keys, "cx", "cy").agg(F.count("*").alias("here")).filter(F.col("here") > most).drop("here")
        over = scratch.keep(over, f"crowded{e}")
        done.append(here.join(over, [*keys, "cx", "cy"], "left_anti"))
        crowded = over if e == 0 else crowded
        if over.isEmpty():
            break
        now = scratch.keep(here.join(over, [*keys, "cx", "cy"], "left_semi").drop("e", "cx", "cy"), f"level{e}")
        e -= 1
    return reduce(DataFrame.unionByName, done), crowded


def settled(spots: DataFrame, crowded: DataFrame, keys: list[str], sums: bool = False) -> DataFrame:
    """(keys, id, x, y, m, best) of the positions in leaves of exponent 0. best: (near, d2, v) in order, or sums of v's fields, where the cells around answer: none
    within HALO is crowded, and what is wanted lies within what these cover; else null.

    Cells are dealt to tiles with those around them, so a point is shuffled about once; a tile holds at most LEAF positions a cell."""
    round_ = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-HALO, HALO + 1) for j in range(-HALO, HALO + 1)))).alias("o")
    beside = crowded.select(*keys, "cx", "cy", round_).select(*keys, (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy")).distinct().withColumn("beside", F.lit(True))
    within = lambda c: F.pmod(F.col(c) - F.col(f"lo_{c}"), F.col("side"))
    covers = F.col("side") * (HALO * (1 - 1e-9)) + F.least(within("x"), F.col("side") - within("x"), within("y"), F.col("side") - within("y"))
    number = lambda c, d=0: F.call_function("shiftright", F.col(c) + d, F.lit(TILE))
    tiles = lambda c: F.explode(F.sequence(number(c, -HALO), number(c, HALO)))
    own = spots.filter("e = 0").join(beside, [*keys, "cx", "cy"], "left").withColumn("tx", tiles("cx")).withColumn("ty", tiles("cy"))
    home = (F.col("place") == 1) & (F.col("tx") == number("cx")) & (F.col("ty") == number("cy"))
    own = own.select(*keys, "tx", "ty", "id", "x", "y", "m", "v", "want", "cx", "cy", covers.alias("covers"), home.alias("home"), (home & F.col("beside").isNull()).alias("asks"))
    of = {f.name: f.dataType for f in own.schema}
    best = of["v"] if sums else T.ArrayType(T.StructType([T.StructField("near", of["id"]), T.StructField("d2", T.DoubleType()), T.StructField("v", of["v"])]))
    schema = T.StructType([*(T.StructField(n, of[n]) for n in (*keys, "id", "x", "y", "m")), T.StructField("best", best)])
    return own.groupBy(*keys, "tx", "ty").applyInArrow(lambda table: nearest_in_tile(table, [*keys, "id", "x", "y", "m"], sums), schema)


def nearest_in_tile(table: pa.Table, names: list[str], sums: bool = False) -> pa.Table:
    """Answers of a tile's askers, and a row without one for the rest that is at home there; blocks of 4 x 4 cells meet the cells around them, a few million pairs at a time."""
    x, y, cx, cy, covers, asks = (table[n].to_numpy() for n in ("x", "y", "cx", "cy", "covers", "asks"))
    rank, want = pc.rank(table["id"].combine_chunks()).to_numpy(), table["want"][0].as_py()
    asking = np.flatnonzero(asks)
    blocks = np.unique(np.stack([cx[asking] >> 2, cy[asking] >> 2], axis=1), axis=0)
    who, near, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for bx, by in blocks * 4:
        held = np.flatnonzero((cx >= bx - HALO) & (cx <= bx + 3 + HALO) & (cy >= by - HALO) & (cy <= by + 3 + HALO))
        if len(held) < want:
            continue
        mine = asking[(cx[asking] >> 2 == bx >> 2) & (cy[asking] >> 2 == by >> 2)]
        step = max(1, PAIRS // len(held))
        for a in (mine[i : i + step] for i in range(0, len(mine), step)):
            ex, ey = x[held] - x[a, None], y[held] - y[a, None]
            d2 = ex * ex + ey * ey
            last = np.partition(d2, want - 1, axis=1)[:, want - 1]
            ok = np.sqrt(last) <= covers[a]
            a, d2 = a[ok], d2[ok]
            row, col = np.nonzero(d2 <= last[ok, None])
            d = d2[row, col]
            order = np.lexsort((rank[held[col]], d, row))
            row, col, d = row[order], col[order], d[order]
            first = np.arange(len(row)) - np.searchsorted(row, np.arange(len(a)))[row] < want
            who.append(a)
            near.append(held[col[first]])
            far.append(d[first])
    who, near = np.concatenate(who), np.concatenate(near)
    if sums:
        best = summed(table["v"].combine_chunks(), near.reshape(len(who), want))
    else:
        pick = lambda n: table[n].take(pa.array(near)).combine_chunks()
        rows = pa.StructArray.from_arrays([pick("id"), pa.array(np.concatenate(far)), pick("v")], ["near", "d2", "v"])
        best = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1, dtype=np.int32) * want), rows)
    rest = np.setdiff1d(np.flatnonzero(table["home"].to_numpy()), who)
    best = pa.concat_arrays([best, pa.nulls(len(rest), best.type)])
    return pa.table([*(table[n].take(pa.array(np.concatenate([who, rest]))) for n in names), best], names=[*names, "best"])


def summed(v: pa.StructArray, near: np.ndarray) -> pa.StructArray:
    """Each field's sum over the places in a row of near, added up in their order; what is missing is left out, and nothing but that has no sum."""
    out = []
    for field in v.flatten():
        there, value = field.is_valid().to_numpy(zero_copy_only=False), field.fill_null(0.0).to_numpy(zero_copy_only=False)
        total, found = np.zeros(len(near)), np.zeros(len(near), bool)
        for place in near.T:
            total += value[place]
            found |= there[place]
        out.append(pa.array(total, mask=~found))
    return pa.StructArray.from_arrays(out, [f.name for f in v.type])


def cells_above(own: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, e, cx, cy, points): every cell above a leaf, with how many points it holds."""
    up = F.explode(F.sequence(F.col("e") + 1, F.col("tallest"))).alias("up")
    lift = lambda c: F.call_function("shiftright", F.col(c), F.col("up") - F.col("e"))
    above = own.filter(F.col("e") < F.col("tallest")).select(*keys, "e", "cx", "cy", "points", up)
    return above.groupBy(*keys, F.col("up").alias("e"), lift("cx").alias("cx"), lift("cy").alias("cy")).agg(F.sum("points").alias("points"))


def first_radius(asking: DataFrame, spots: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
    """Positions that ask (with their leaf) with r2, within which all they want lies, and e, the exponent at which their search starts.

    A leaf with enough points gives the distance of its last wanted one; else the smallest cell above that has enough, its farthest corner."""
    held = spots.select(*keys, "e", "cx", "cy", F.col("x").alias("px"), F.col("y").alias("py"))
    ex, ey = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    own = [*keys, "e", "cx", "cy", "x", "y", "want", "side", "lo_x", "lo_y", "tallest"]
    asking = asking.select(*own).join(held, [*keys, "e", "cx", "cy"]).groupBy(*own).agg(F.get(F.sort_array(F.collect_list(ex * ex + ey * ey)), F.first("want") - 1).alias("r2"))
    # in a crowd the search starts at the smallest cell that holds the whole circle
    fine = lambda c, f: F.greatest(F.floor((f(F.col(c), F.sqrt("r2") + F.col("side") * 1e-9) - F.col(f"lo_{c}")) / F.col("side") * float(1 << DEPTH)).cast("long"), F.lit(0).cast("long"))
    bits = lambda c: F.length(F.bin(fine(c, lambda a, b: a - b).bitwiseXOR(fine(c, lambda a, b: a + b)))) - DEPTH
    start = lambda e: F.when(F.col(e) < 0, F.least(F.lit(0), F.greatest(F.col(e), bits("x"), bits("y")))).otherwise(F.col(e))
    some = asking.filter("r2 is not null").withColumn("e", start("e")).drop("cx", "cy", "tallest")
    lift = lambda c: F.call_function("shiftright", F.col(c), F.col("up") - F.col("e"))
    few = asking.filter("r2 is null and e < tallest").withColumn("up", F.explode(F.sequence(F.col("e") + 1, F.col("tallest"))))
    few = few.withColumns({"cx": lift("cx"), "cy": lift("cy")}).drop("e", "tallest", "r2")
    enough = few.join(above.withColumnRenamed("e", "up"), [*keys, "up", "cx", "cy"]).filter("points >= want")
    rest = [c for c in enough.columns if c not in (*keys, "x", "y")]
    lowest = enough.groupBy(*keys, "x", "y").agg(F.min_by(F.struct(*rest), "up").alias("s")).select(*keys, "x", "y", "s.*")
    corner = F.pow(far2("x", low("x", "up"), side("up")), F.lit(2.0)) + F.pow(far2("y", low("y", "up"), side("up")), F.lit(2.0))
    return some.unionByName(lowest.withColumn("r2", corner).withColumn("e", start("up")).drop("up", "cx", "cy", "points"))


def side(e: str) -> Column:
    return F.col("side") * F.pow(F.lit(2.0), F.col(e))


def low(axis: str, e: str) -> Column:
    return F.col(f"lo_{axis}") + F.col(f"c{axis}") * side(e)


def search(asking: DataFrame, spots: DataFrame, above: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """(keys, x, y, want, d2, near, v): the points of opened leaves within each asker's radius.

    Askers meet the cells that their circle touches. Leaves are opened; of a cell that is split further, whose points are enough, the farthest
    corner bounds the radius, and only its quarters that the least radius still touches are asked for in the next round."""
    ask = [*keys, "x", "y", "want", "side", "lo_x", "lo_y", "r2"]
    wider = F.sqrt("r2") + F.col("side") * 1e-9
    reach = lambda f, c: F.greatest(F.floor((f(F.col(c), wider) - F.col(f"lo_{c}")) / side("e")).cast("long"), F.lit(0).cast("long"))
    span = lambda c: F.explode(F.sequence(reach(lambda a, b: a - b, c), reach(lambda a, b: a + b, c)))
    dx, dy = near2("x", low("x", "e"), side("e")), near2("y", low("y", "e"), side("e"))
    touched = dx * dx + dy * dy <= wider * wider
    held = spots.select(*keys, "e", "cx", "cy", F.col("x").alias("px"), F.col("y").alias("py"), F.col("id").alias("near"), "v")
    ex, ey = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    front = scratch.keep(asking.select(*ask, "e", span("x").alias("cx")).withColumn("cy", span("y")).filter(touched), "front0")
    found, k = [], 0
    while True:
        met = front.join(held, [*keys, "e", "cx", "cy"]).withColumn("d2", ex * ex + ey * ey).filter("d2 <= r2")
        found.append(met.select(*keys, "x", "y", "want", "d2", "near", "v"))
        split = scratch.keep(front.join(above, [*keys, "e", "cx", "cy"]), f"split{k}")
        if split.isEmpty():
            break
        fx, fy = far2("x", low("x", "e"), side("e")), far2("y", low("y", "e"), side("e"))
        bound = F.min(F.when(F.col("points") >= F.col("want"), F.least("r2", fx * fx + fy * fy)).otherwise(F.col("r2"))).over(Window.partitionBy(*keys, "x", "y"))
        quarter = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))).alias("q")
        down = split.withColumn("r2", bound).select(*ask, (F.col("e") - 1).alias("e"), "cx", "cy", quarter)
        down = down.select(*ask, "e", (F.col("cx") * 2 + F.col("q.i")).alias("cx"), (F.col("cy") * 2 + F.col("q.j")).alias("cy"))
        k += 1
        front = scratch.keep(down.filter(touched), f"front{k}")
    return reduce(DataFrame.unionByName, found)


def added(v: Column, field: str) -> Column:
    """The sum of a field over an array of structs in its order, as SQL's sum has it."""
    there = F.filter(F.transform(v, lambda b: b["v"][field]), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x))


def nearest(points: DataFrame, k: int, x: str, y: str, id_col: str, values, keys, sums: bool) -> tuple[DataFrame, list[str]]:
    """(key_0 .., id, best) of each point, and the names of the keys: best is the array (near, d2, v) of its nearest points, or the sums of their values."""
    scratch = Scratch(points.sparkSession, "neighbours")
    inner = [f"key_{i}" for i in range(len(keys))]  # whatever the columns' names, none clashes
    finite = lambda c: F.abs(F.col(c).cast("double")) < float("inf")
    value = F.struct(*((F.col(v).cast("double") if sums else F.col(v)).alias(f"v{i}") for i, v in enumerate(values))) if values else F.struct(F.lit(None).cast("int").alias("v0"))
    own = points.filter(finite(x) & finite(y) & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    own = own.select(*(F.col(c).alias(n) for c, n in zip(keys, inner)), F.col(id_col).alias("id"), (F.col(x).cast("double") + 0.0).alias("x"), (F.col(y).cast("double") + 0.0).alias("y"), value.alias("v")).dropna(subset=inner)
    own = scratch.keep(placed(own, inner, k), "placed")
    firsts, piled = stacked(own, inner, k, scratch)
    spots, crowded = leaves(firsts, inner, max(LEAF, k), scratch)
    spots = scratch.keep(spots, "spots")
    answers = scratch.keep(settled(spots, crowded, inner, sums), "settled")

    def of_points(places: DataFrame, *rest: str) -> DataFrame:
        """Places' rows for each of their points."""
        out = places.filter("m = 1").select(*inner, "id", *rest) if piled else places.select(*inner, "id", *rest)
        several = places.filter("m > 1").select(*inner, "x", "y", *(c for c in rest if c not in ("x", "y")))
        return out.unionByName(own.select(*inner, "id", "x", "y").join(several, [*inner, "x", "y"]).select(*inner, "id", *rest)) if piled else out

    best = of_points(answers.filter("best is not null"), "best")
    # leaves below the cells of exponent 0 weren't asked for
    left = answers.filter("best is null").drop("best").unionByName(spots.filter("place = 1 and e < 0").select(*inner, "id", "x", "y", "m"))
    left = scratch.keep(of_points(left, "x", "y"), "unsettled")
    if not left.isEmpty():
        filled = spots.filter("place = 1").groupBy(*inner, "e", "cx", "cy", "tallest").agg(F.sum("m").alias("points"))
        above = scratch.keep(cells_above(filled, inner), "above")
        asking = spots.filter("place = 1").join(left.select(*inner, "x", "y").distinct(), [*inner, "x", "y"])
        found = search(first_radius(asking, spots, above, inner), spots, above, inner, scratch)
        near = found.groupBy(*inner, "x", "y", "want").agg(F.collect_list(F.struct("d2", "near", "v")).alias("best"))
        near = near.select(*inner, "x", "y", F.slice(F.sort_array("best"), 1, F.col("want")).alias("best"))
        pick = F.transform("best", lambda b: F.struct(b["near"].alias("near"), b["d2"].alias("d2"), b["v"].alias("v")))
        if sums:
            pick = F.struct(*(added(F.col("best"), f"v{i}").alias(f"v{i}") for i in range(len(values))))
        best = best.unionByName(left.join(near, [*inner, "x", "y"]).select(*inner, "id", pick.alias("best")))
    else:  # the answers alone are read, and points where several share a place
        scratch.drop("spots", *(() if piled else ("placed",)))
    return best, inner


def k_nearest(points: DataFrame, k: int, x: str = "utm_x_m", y: str = "utm_y_m", id_col: str = "point_id", values=(), keys=("run_id",)) -> DataFrame:
    """The min(n, k) points nearest to each point, itself among them, by planar distance; ties go to smaller ids.

    Equal positions are one, with a multiplicity and their first k points, as all of them have the same neighbours. Positions fill a quadtree whose cells
    are split until none holds more than LEAF of them, so neither a crowded place nor an empty stretch makes a task that others don't: a search opens
    leaves and cells that its radius touches, and the radius comes from counts.
    Returns keys, id_col, near (id), d2 (squared distance), rank and the near point's values. Rows with a missing coordinate or key, or one that isn't finite, take
    no part; an empty table gives no rows.
    """
    best, inner = nearest(points, k, x, y, id_col, values, keys, sums=False)
    rows = best.select(*inner, "id", F.posexplode("best").alias("at", "b")).select(*inner, "id", "b.near", "b.d2", (F.col("at") + 1).alias("rank"), "b.v")
    return rows.select(
        *(F.col(n).alias(c) for c, n in zip(keys, inner)), F.col("id").alias(id_col), "near", "d2", "rank", *(F.col(f"v.v{i}").alias(v) for i, v in enumerate(values))
    )


def nearest_sums(points: DataFrame, k: int, values, x: str = "utm_x_m", y: str = "utm_y_m", id_col: str = "point_id", keys=("run_id",)) -> DataFrame:
    """(keys, id_col, a column for each of values): sums over the points that k_nearest finds, in their order and without missing values. The neighbours
    themselves are neither written nor shuffled."""
    best, inner = nearest(points, k, x, y, id_col, values, keys, sums=True)
    return best.select(*(F.col(n).alias(c) for c, n in zip(keys, inner)), F.col("id").alias(id_col), *(F.col(f"best.v{i}").alias(v) for i, v in enumerate(values)))
