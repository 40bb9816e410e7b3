"""Sparse and graph forms of voxel grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def coo(cells: DataFrame) -> DataFrame:
    """Occupied coordinates as ``x, y, z`` (k, j, i) with feature 1."""
    return cells.select("object_id", F.col("k").alias("x"), F.col("j").alias("y"), F.col("i").alias("z"), F.lit(1.0).alias("feature"))


#: Cells along k that one word of a row's bit mask holds.
WORD = 62


def words(cells: DataFrame) -> DataFrame:
    """``object_id, i, j, w, mask``: the occupied cells of every row along k as bits of words; a cell counts once."""
    bit = F.expr(f"shiftleft(1L, int(pmod(k, {WORD})))")
    return cells.groupBy("object_id", "i", "j", F.expr(f"int((k - pmod(k, {WORD})) div {WORD})").alias("w")).agg(F.bit_or(bit).alias("mask"))


def numbered(rows: DataFrame, order: list[str], count: Column, out: str = "first") -> DataFrame:
    """``rows`` with ``out``: how many of ``count`` lie before a row in ``order``, within its object.

    A window over words, never over cells; where objects were dealt to tasks, it needs no exchange.
    """
    before = Window.partitionBy("object_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.sum(count.cast("long")).over(before), F.lit(0).cast("long")))


def _rows(cells: DataFrame) -> DataFrame:
    """``object_id, i, j, w, mask, first``: words of the rows along k as bits, and the number of the first node in each."""
    return numbered(words(cells), ["i", "j", "w"], F.bit_count("mask"))


def _nth(first: str, mask: str, bit: str) -> str:
    """The number of the node at a bit of a word."""
    return f"{first} + bit_count({mask} & (shiftleft(1L, {bit}) - 1L))"


def with_bits(rows: DataFrame, mask: str) -> DataFrame:
    """``rows`` once for each bit ``b`` of ``mask`` that is set."""
    upto = F.expr(f"sequence(0, length(bin({mask})) - 1)")
    return rows.where(f"{mask} <> 0").withColumn("b", F.explode(upto)).where(f"shiftrightunsigned({mask}, b) & 1L = 1L")


def nodes(cells: DataFrame) -> DataFrame:
    """``coo`` with ``node_id``: row-major numbers from 0 within each grid; a cell counts once."""
    each = with_bits(_rows(cells), "mask")
    return each.select(
        "object_id", F.expr(f"w * {WORD} + b").alias("x"), F.col("j").alias("y"), F.col("i").alias("z"), F.lit(1.0).alias("feature"), F.expr(_nth("first", "mask", "b")).alias("node_id")
    )


def offsets(connectivity: int) -> list[tuple[int, int, int]]:
    most = {6: 1, 18: 2, 26: 3}
    if connectivity not in most:
        raise ValueError("connectivity is 6, 18 or 26")
    around = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    return [o for o in around if 0 < sum(map(abs, o)) <= most[connectivity]]


def edges(cells: DataFrame, connectivity: int = 6, loops: bool = False) -> DataFrame:
    """Directed edges between occupied neighbours, ``object_id, src, dst``, in numbers of ``nodes``; a cell counts once.

    Words of bits meet their neighbours, not cells: the bits that two words
    share after a shift are the edges between them, and both ends' numbers
    follow from the bits below.
    """
    rows = _rows(cells)
    steps: dict[tuple[int, int, int], list[int]] = {}
    for a, b, c in [o for o in offsets(connectivity) if o > (0, 0, 0)] + [(0, 0, 0)] * loops:  # edges go both ways
        for w in (0, c) if c else (0,):
            steps.setdefault((a, b, w), []).append(c - WORD * w)
    moves = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("di", "dj", "dw"), s)], F.array(*map(F.lit, by)).alias("by")) for s, by in steps.items()]))
    asks = rows.withColumn("m", moves).where(f"m.dw = 0 OR shiftrightunsigned(mask, if(m.dw > 0, {WORD - 1}, 0)) & 1L = 1L")
    asks = asks.select(
        "object_id", "mask", "first", (F.col("i") + F.col("m.di")).alias("i"), (F.col("j") + F.col("m.dj")).alias("j"), (F.col("w") + F.col("m.dw")).alias("w"), F.col("m.by").alias("by")
    )  # bit b of a word is beside bit b + by of the other
    other = rows.select("object_id", "i", "j", "w", F.col("mask").alias("other"), F.col("first").alias("other_first"))
    met = asks.join(other.hint("merge"), ["object_id", "i", "j", "w"]).select("object_id", "mask", "first", "other", "other_first", F.explode("by").alias("by"))
    shared = F.expr("mask & if(by < 0, shiftleft(other, -by), shiftright(other, by))")
    each = with_bits(met.withColumn("shared", shared), "shared")
    each = each.select("object_id", "by", F.expr(_nth("first", "mask", "b")).alias("one"), F.expr(_nth("other_first", "other", "b + by")).alias("two"))
    ways = F.explode(F.expr("if(one = two, array(struct(one AS src, two AS dst)), array(struct(one AS src, two AS dst), struct(two AS src, one AS dst)))"))
    return each.select("object_id", ways.alias("e")).select("object_id", "e.src", "e.dst")


def neighbour_counts(cells: DataFrame, connectivity: int = 6) -> DataFrame:
    """Edges per object, counted in one pass over bit masks of the rows along k, without node numbers or edge rows."""
    row = cells.groupBy("object_id", "i", "j").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask"))
    steps: dict[tuple[int, int], list[int]] = {}
    for a, b, c in offsets(connectivity):
        steps.setdefault((a, b), []).append(c)
    moves = [F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.array(*map(F.lit, cs)).alias("dk")) for (a, b), cs in steps.items()]
    asks = row.withColumn("m", F.explode(F.array(*moves))).select("object_id", "mask", (F.col("i") + F.col("m.di")).alias("i"), (F.col("j") + F.col("m.dj")).alias("j"), F.col("m.dk").alias("dk"))
    met = asks.join(row.withColumnRenamed("mask", "other").hint("merge"), ["object_id", "i", "j"])
    shared = F.expr("aggregate(dk, 0, (t, d) -> t + bit_count(if(d > 0, shiftrightunsigned(other, 1), if(d < 0, shiftleft(other, 1), other)) & mask))")
    return met.groupBy("object_id").agg(F.sum(shared).alias("num_edges"))


def sparse_statistics(cells: DataFrame, objects: DataFrame, resolution: int) -> DataFrame:
    """Occupancy, sparsity, compression against a dense grid and mean degree (6 neighbours)."""
    n = cells.groupBy("object_id").agg(F.count("*").alias("n"))
    out = objects.join(n, "object_id", "left").join(neighbour_counts(cells), "object_id", "left").na.fill(0, ["n", "num_edges"])
    total = resolution**3
    return out.select(
        "object_id", F.col("n").alias("num_occupied"), F.lit(total).cast("long").alias("total_voxels"), (F.col("n") / float(total)).alias("occupancy"),
        (1.0 - F.col("n") / float(total)).alias("sparsity"), F.when(F.col("n") > 0, float(total) / F.col("n")).alias("compression_ratio"), "num_edges",
        F.when(F.col("n") > 0, F.col("num_edges") / F.col("n")).otherwise(0.0).alias("avg_degree"),
    )


def to_dense(points: DataFrame, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """``coo`` back to full grids with 0 where nothing is; without ``shape`` each grid ends at its last coordinate."""
    if shape:
        sizes = points.select("object_id").distinct().select("object_id", *[F.lit(s).alias(f"n{a}") for a, s in zip("zyx", shape, strict=True)])
    else:
        sizes = points.groupBy("object_id").agg(*[(F.max(a) + 1).alias(f"n{a}") for a in "zyx"])
    grid = sizes
    for a in "zyx":
        grid = grid.withColumn(a, F.explode(F.expr(f"sequence(0, n{a} - 1)")))
    return grid.hint("merge").join(points, ["object_id", "z", "y", "x"], "left").select("object_id", "z", "y", "x", F.coalesce("feature", F.lit(0.0)).alias("value"))
