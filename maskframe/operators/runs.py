"""Masks as runs of pixels in a row (keys, y, x1, x2): filling of polygons, unions, shares, components of any size.

A run stands for x1 to x2, both included. Runs, unions, shares and links are windows and equi-joins on (keys, row), so one mask may be
spread over tasks. Polygons, which come as one row each, are filled in their task; links are contracted in pieces of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled
from .pixels import KEYS


def runs(pixels: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The runs of a mask; repeated pixels count once."""
    p = pixels.select(*keys, "y", "x").distinct()
    gap = F.col("x") - F.row_number().over(Window.partitionBy(*keys, "y").orderBy("x"))
    return p.withColumn("__gap", gap).groupBy(*keys, "y", "__gap").agg(F.min("x").alias("x1"), F.max("x").alias("x2")).drop("__gap")


def pixels_of(runs_: DataFrame, keys: list[str] = KEYS, more: tuple[str, ...] = ()) -> DataFrame:
    return runs_.select(*keys, *more, F.explode(F.sequence("x1", "x2")).alias("x"), "y")


def united(runs_: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Runs that overlap or touch become one."""
    row = Window.partitionBy(*keys, "y").orderBy("x1", "x2")
    reach = F.max("x2").over(row.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach + 1 >= F.col("x1"), 0).otherwise(1)
    numbered = runs_.withColumn("__begins", begins).withColumn("__run", F.sum("__begins").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "y", "__run").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2")).drop("__run")


def area(runs_: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Pixels of each mask; runs must not overlap."""
    return runs_.groupBy(*keys).agg(F.sum(F.col("x2") - F.col("x1") + 1).alias("area"))


#: Points of a border that are worked on at once.
POINTS = 1 << 18


def filled(polygons: DataFrame, keys: list[str] = KEYS, polygon: str = "polygon", outline: bool = False) -> DataFrame:
    """Runs of closed polygons (arrays of structs x, y, in order) by the even-odd rule.

    Corners are truncated to whole numbers. Each edge gives its crossing with every row from its lower end up to, not with,
    its upper end; a row's crossings in order bound runs in pairs. Corners and level edges are added, so all points of the
    border count. With outline, edges are also drawn as lines one pixel wide (the other coordinate rounded half up), as
    drawing libraries do. Polygons without corners give nothing, and one or two corners a point or a line.

    Only corners are shuffled, to gather the polygons of equal keys; these are one mask. A task then fills some masks at a time.
    """

    def fill(p: pa.Array) -> pa.Array:
        k, y, x1, x2 = runs_of(p, outline)
        return in_lists(k, len(p), y=y, x1=x1, x2=x2)

    made = F.arrow_udf(fill, "array<struct<y: int, x1: int, x2: int>>")
    return gathered([polygons], keys, polygon).select(*keys, F.inline(made("p0")))


def covered_rows(polygons: DataFrame, keys: list[str] = KEYS, polygon: str = "polygon", outline: bool = False) -> DataFrame:
    """(keys, y, first_x, last_x, pixels): the rows of filled() masks, made with the runs."""

    def fill(p: pa.Array) -> pa.Array:
        k, y, x1, x2 = runs_of(p, outline)
        first = np.flatnonzero(changes(k, y))
        n = np.add.reduceat(x2 - x1 + 1, first) if len(first) else first
        return in_lists(k[first], len(p), y=y[first], first_x=x1[first], last_x=x2[np.append(first, len(k))[1:] - 1], pixels=n)

    made = F.arrow_udf(fill, "array<struct<y: int, first_x: int, last_x: int, pixels: bigint>>")
    return gathered([polygons], keys, polygon).select(*keys, F.inline(made("p0")))


def gathered(sides: list[DataFrame], keys: list[str], polygon: str) -> DataFrame:
    """(keys, p0, p1, ...): for each side the polygons of equal keys that have corners, as arrays of corners."""
    p = F.transform(F.filter(polygon, lambda c: c["x"].isNotNull() & c["y"].isNotNull()), lambda c: F.struct(c["x"].cast("int").alias("x"), c["y"].cast("int").alias("y")))
    out = None
    for i, side in enumerate(sides):
        one = side.select(*keys, p.alias("p")).filter(F.size("p") > 0)
        one = one.select(*keys, *(F.when(F.lit(i == j), F.col("p")).alias(f"p{j}") for j in range(len(sides))))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*keys).agg(*(F.collect_list(f"p{j}").alias(f"p{j}") for j in range(len(sides))))


Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def runs_of(p: pa.Array, outline: bool) -> Runs:
    """(mask, y, x1, x2) in order, from an array of masks, each a list of polygons."""
    mask = np.repeat(np.arange(len(p)), pc.list_value_length(p).to_numpy())
    size = pc.list_value_length(p.flatten()).to_numpy()
    ax, ay = (c.to_numpy().astype(np.int64) for c in p.flatten().flatten().flatten())
    after, ends = np.arange(1, len(ax) + 1), np.cumsum(size)
    after[ends - 1] = ends - size
    k, bx, by = np.repeat(mask, size), ax[after], ay[after]
    work = np.cumsum(np.bincount(k, np.abs(by - ay) + (np.abs(bx - ax) if outline else 0) + 3, len(p)))
    cuts = np.searchsorted(k, np.flatnonzero(np.diff(work // POINTS)) + 1)
    parts = [filling(*x, outline) for x in zip(*(np.split(v, cuts) for v in (k, ax, ay, bx, by)), strict=True)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def filling(k: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, outline: bool) -> Runs:
    """The runs of masks k from their edges."""
    low, left = np.minimum(ay, by), np.minimum(ax, bx)
    of, y = stretched(np.where(ay != by, low, 0), np.abs(by - ay))
    at = ax[of] + (y - ay[of]) * (bx - ax)[of] / (by - ay)[of]
    order = np.lexsort((at, y, k[of]))  # each row of a mask has an even number of crossings
    begin, end = np.ceil(at[order][::2]).astype(np.int64), np.floor(at[order][1::2]).astype(np.int64)
    real, level = begin <= end, ay == by
    parts = [(k[of][order][::2][real], y[order][::2][real], begin[real], end[real])]
    parts += [(k[level], ay[level], left[level], np.maximum(ax, bx)[level]), (k, ay, ax, ax)]
    if outline:
        flat = np.abs(bx - ax) >= np.abs(by - ay)
        near = lambda t, i, a, b, c, d: np.floor(c[i] + (t - a[i]) * (d - c)[i] / (b - a)[i] + 0.5).astype(np.int64)
        i, x = stretched(left, np.where(flat & (ax != bx), np.abs(bx - ax) + 1, 0))
        parts.append((k[i], near(x, i, ax, bx, ay, by), x, x))
        i, y = stretched(low, np.where(flat, 0, np.abs(by - ay) + 1))
        x = near(y, i, ay, by, ax, bx)
        parts.append((k[i], y, x, x))
    return joined(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def stretched(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers first[i], ... n[i] of them, and i beside them."""
    of = np.repeat(np.arange(len(n)), n)
    return of, first[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]


def joined(k: np.ndarray, y: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> Runs:
    """united() of runs of masks k."""
    order = np.lexsort((x1, y, k))
    k, y, x1, x2 = k[order], y[order], x1[order], x2[order]
    new = changes(k, y)
    base = np.cumsum(new) * (np.ptp(x2) + 1 if len(x2) else 0)
    reach = np.maximum.accumulate(x2 + base) - base  # the largest end so far in the row
    begins = new.copy()
    begins[1:] |= reach[:-1] + 1 < x1[1:]
    first = np.flatnonzero(begins)
    return k[first], y[first], x1[first], reach[np.append(first, len(k))[1:] - 1]


def changes(k: np.ndarray, y: np.ndarray) -> np.ndarray:
    """True where a row of a mask begins."""
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (y[1:] != y[:-1])
    return new


def in_lists(k: np.ndarray, n: int, **columns: np.ndarray) -> pa.Array:
    """n lists of structs, k in order being the list of each; whole numbers, pixels as long."""
    fields = [pa.array(v.astype(np.int64 if name == "pixels" else np.int32)) for name, v in columns.items()]
    offsets = np.searchsorted(k, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, list(columns)))


def shares(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, shared, total, iou) of masks as runs that do not overlap in themselves. Ends of runs are swept in order, so no
    pixel is made. Masks that only one side has share nothing."""

    def ends(r: DataFrame, side: int) -> DataFrame:
        step = lambda x, d: F.struct(x.alias("x"), F.lit(d if side == 0 else 0).alias("da"), F.lit(d if side else 0).alias("db"))
        return r.select(*keys, "y", F.inline(F.array(step(F.col("x1"), 1), step(F.col("x2") + 1, -1))))

    at = ends(a, 0).unionByName(ends(b, 1)).groupBy(*keys, "y", "x").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    row = Window.partitionBy(*keys, "y").orderBy("x")
    upto = row.rowsBetween(Window.unboundedPreceding, 0)
    swept = at.select(*keys, (F.lead("x").over(row) - F.col("x")).alias("n"), (F.sum("da").over(upto) > 0).alias("in_a"), (F.sum("db").over(upto) > 0).alias("in_b"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    g = swept.groupBy(*keys).agg(total(F.col("in_a") & F.col("in_b")).alias("shared"), total(F.col("in_a") | F.col("in_b")).alias("total"))
    return g.withColumn("iou", F.when(F.col("total") > 0, F.col("shared") / F.col("total")).otherwise(0.0))


def polygon_iou(a: DataFrame, b: DataFrame, keys: list[str], polygon: str = "polygon", outline: bool = False) -> DataFrame:
    """shares() of polygons with equal keys, without a shuffle of their runs."""

    def swept(p: pa.Array, q: pa.Array) -> pa.Array:
        sides = runs_of(p, outline), runs_of(q, outline)
        k, y, x1, x2 = (np.concatenate(v) for v in zip(*sides, strict=True))
        area = np.bincount(k, x2 - x1 + 1, len(p)).astype(np.int64)
        k, y, x = np.tile(k, 2), np.tile(y, 2), np.append(x1, x2 + 1)
        inside = np.repeat([1, -1], len(x1))
        order = np.lexsort((x, y, k))
        both = np.cumsum(inside[order])[:-1] == 2  # the runs of one side do not overlap
        shared = np.bincount(k[order][:-1][both], np.diff(x[order])[both], len(p)).astype(np.int64)
        return pa.StructArray.from_arrays([pa.array(shared), pa.array(area - shared)], ["shared", "total"])

    made = F.arrow_udf(swept, "struct<shared: bigint, total: bigint>")
    g = gathered([a, b], keys, polygon).select(*keys, made("p0", "p1").alias("s")).select(*keys, "s.*")
    return g.withColumn("iou", F.when(F.col("total") > 0, F.col("shared") / F.col("total")).otherwise(0.0))


# components


def node(y: Column, x: Column) -> Column:
    """The number of a pixel: smaller in upper rows, then to the left."""
    return y.cast("long") * 2**31 + x


def links(runs_: DataFrame, keys: list[str], radius2: int = 2) -> DataFrame:
    """(keys, a, b): enough pairs of touching runs to connect each component; pixels at squared distance up to radius2 touch.

    Of two runs in different rows, one starts last; the run of the other row that started before it, as late as possible, is
    the only one it need be linked with: what ended earlier and still touches it touches that run, too. So each run of a pair of
    rows makes one link at most, and no run meets all runs of a row.
    """
    numbered = runs_.select(*keys, "y", "x1", "x2", node(F.col("y"), F.col("x1")).alias("id"))
    out = None
    for dy in range(math.isqrt(radius2) + 1):
        reach = math.isqrt(radius2 - dy * dy)
        if dy == 0:
            if reach < 2:
                continue
            before = F.lag(F.struct("id", "x2")).over(Window.partitionBy(*keys, "y").orderBy("x1"))
            near = numbered.withColumn("o", before)
        else:
            both = numbered.withColumn("row", F.col("y")).withColumn("side", F.lit(0)).unionByName(numbered.withColumn("row", F.col("y") - dy).withColumn("side", F.lit(1)))
            upto = Window.partitionBy(*keys, "row").orderBy("x1", "side").rowsBetween(Window.unboundedPreceding, 0)
            last = lambda s, w=upto: F.last(F.when(F.col("side") == s, F.struct("id", "x2")), ignorenulls=True).over(w)
            near = both.withColumn("o", F.when(F.col("side") == 0, last(1)).otherwise(last(0)))
        found = near.filter(F.col("o.x2") + reach >= F.col("x1")).select(*keys, F.col("id").alias("a"), F.col("o.id").alias("b"))
        out = found if out is None else out.unionByName(found)
    return out


#: Edges that a task contracts at once.
EDGES = 1 << 18


def contracted(edges: DataFrame, keys: list[str], most: int = EDGES) -> DataFrame:
    """(keys, a, b, open): each node a of edges (keys, a, b) with b, the smallest node that it reaches by edges seen together.
    A mask's edges come one after another in one task, which holds up to about `most`; only a mask with more is open, its b not final."""
    names = [*keys, "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, carried = [], 0, False
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                size += batch.num_rows
                if size < most:
                    continue
            if not size:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            new = np.zeros(size, dtype=bool)
            for c in keys:
                codes = t.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            mask, last = np.cumsum(new), size
            if batch is not None:
                last = int(np.flatnonzero(new)[-1]) if new.any() else size - 1  # one edge stays, to tell if its mask goes on
            cut = batch is not None and not new.any()
            if last:
                row, a, b = least(mask[:last], t.column("a").to_numpy()[:last], t.column("b").to_numpy()[:last])
                still = (mask[row] == 0) & (carried or cut)
                out = [t.column(c).combine_chunks().take(pa.array(row)) for c in keys]
                yield pa.RecordBatch.from_arrays([*out, pa.array(a), pa.array(b), pa.array(still)], names=[*names, "open"])
            carried = cut or (carried and not new[: last + 1].any())
            held = t.slice(last).to_batches()
            size -= last

    d = edges.select(*names)
    return settled(d.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, d.schema.add("open", "boolean")))


def least(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node of edges a, b of masks in order: a row of its mask, the node, and the smallest node that it reaches."""
    rows = np.tile(np.arange(len(a)), 2)
    ids = np.append(a, b)
    order = np.lexsort((ids, mask[rows]))
    new = changes(mask[rows][order], ids[order])
    at = np.empty(len(ids), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    u, v, up = at[: len(a)], at[len(a) :], np.arange(new.sum())
    while True:
        low, high = np.minimum(up[u], up[v]), np.maximum(up[u], up[v])
        if (low == high).all():
            break
        np.minimum.at(up, high, low)
        while (up[up] != up).any():
            up = up[up]
    first = order[new]
    return rows[first], ids[first], ids[first][up]


def smallest_reachable(edges: DataFrame, keys: list[str], most_rounds: int = 60, most: int = EDGES) -> DataFrame:
    """(keys, id, comp): for each node of edges (keys, a, b) the smallest node that it reaches.

    Masks of up to `most` edges are contracted in their tasks. Of larger ones, large and small stars alternate: a node's larger
    neighbours go to its smallest one, then so do its smaller ones. Rounds grow with the logarithm of a component's length; each is
    settled in the shared folder. More than most_rounds is an error.
    """
    pair = lambda d: d.filter("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    whole = contracted(edges, keys, most)
    named = whole.filter("not open").select(*keys, F.col("a").alias("id"), F.col("b").alias("comp"))
    if whole.filter("open").isEmpty():
        return named
    now, seen = settled(pair(whole.filter("open"))), None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = large.join(least, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(*keys, "a", F.col("m").alias("b")))
        now = settled(pair(small))
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            ends = now.select(*keys, F.col("b").alias("id"), F.col("b").alias("comp")).distinct()
            return named.unionByName(now.select(*keys, F.col("a").alias("id"), F.col("b").alias("comp"))).unionByName(ends)
        seen = mark
    raise RuntimeError("components did not settle")


def components(runs_: DataFrame, keys: list[str] = KEYS, radius2: int = 2) -> DataFrame:
    """Runs with comp, the number of their component's first pixel. Equal to pixels.labelled(), for masks of any size."""
    r = settled(runs_.select(*keys, "y", "x1", "x2"))
    named = smallest_reachable(links(r, keys, radius2), keys)
    r = r.withColumn("id", node(F.col("y"), F.col("x1")))
    return r.join(named, [*keys, "id"], "left").withColumn("comp", F.coalesce("comp", "id")).drop("id")


def component_sizes(runs_: DataFrame, keys: list[str] = KEYS, radius2: int = 2) -> DataFrame:
    """(keys, comp, area, cx, cy), as pixels.component_sizes(), from the runs' lengths and ends."""
    n = F.col("x2") - F.col("x1") + 1
    g = components(runs_, keys, radius2).groupBy(*keys, "comp").agg(F.sum(n).alias("area"), F.sum(n * (F.col("x1") + F.col("x2")) / 2).alias("sx"), F.sum(n * F.col("y")).alias("sy"))
    return g.select(*keys, "comp", "area", (F.col("sx") / F.col("area")).alias("cx"), (F.col("sy") / F.col("area")).alias("cy"))
