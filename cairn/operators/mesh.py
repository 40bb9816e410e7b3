"""Voxelization of triangle meshes by separating axes, and cube meshes of voxel grids."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.sparse import WORD, numbered, with_bits, words
from cairn.operators.voxel import fill_interior


def mesh_points(triangles: DataFrame) -> DataFrame:
    """The corners of all triangles."""
    corners = F.explode(F.array(*[F.struct(*[F.col(f"{v}{a}").alias(a) for a in "xyz"]) for v in "abc"]))
    return triangles.select("object_id", corners.alias("p")).select("object_id", "p.x", "p.y", "p.z")


def _cross(p: list[Column], q: list[Column]) -> list[Column]:
    return [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]


def _axis(a: list[Column]) -> Column:
    """``x, y, z, lo, hi``: cells whose centre lies between ``lo`` and ``hi`` along the axis aren't separated by it from the triangle ``a, b, c``."""
    along = [sum((a[n] * F.col(f"{v}{x}") for n, x in enumerate("xyz")), F.lit(0.0)) for v in "abc"]
    reach = (F.abs(a[0]) + F.abs(a[1]) + F.abs(a[2])) * (0.5 + 1e-9)
    return F.struct(a[0].alias("x"), a[1].alias("y"), a[2].alias("z"), (F.least(*along) - reach).alias("lo"), (F.greatest(*along) + reach).alias("hi"))


def passed_cells(triangles: DataFrame, resolution: int) -> DataFrame:
    """``object_id, i, j, k`` of the cells that triangles in cell units pass, each once for every triangle.

    A triangle reaches the cells from that of its least to that of its greatest
    coordinate. Of those, along the axis that its plane faces most, only the
    few that the plane crosses in a column are made, so candidates grow with
    its area; they stay if none of the plane's normal and the nine products of
    its sides with the axes separates them. All of it is column expressions.
    """
    side = [[F.col(f"{q}{x}") - F.col(f"{p}{x}") for x in "xyz"] for p, q in ("ab", "bc", "ca")]
    normal = _cross(side[0], side[1])
    axes = [_axis(normal)]
    for s, n in product(side, range(3)):
        axes.append(_axis(_cross([F.lit(float(n == m)) for m in range(3)], s)))
    t = triangles.withColumns({"normal": F.array(*normal), "axes": F.array(*axes)})
    cell = lambda f, x: F.greatest(F.lit(0), F.least(F.lit(resolution - 1), F.floor(f(*[F.col(f"{v}{x}") for v in "abc"])))).cast("int")
    ends = F.array(*[F.struct(cell(F.least, x).alias("lo"), cell(F.greatest, x).alias("hi")) for x in "xyz"])
    most = F.array_max(F.transform("normal", lambda c: F.abs(c)))
    main = F.array_position(F.transform("normal", lambda c: F.abs(c) == most), True).cast("int") - 1
    level = sum((normal[n] * F.col(f"a{x}") for n, x in enumerate("xyz")), F.lit(0.0))  # of the plane along its normal
    t = t.select("object_id", "normal", "axes", ends.alias("ends"), F.coalesce(main, F.lit(2)).alias("w"), level.alias("level"))
    t = t.withColumns({"u": (F.col("w") + 1) % 3, "v": (F.col("w") + 2) % 3})
    for c in "uv":
        t = t.withColumn(f"c{c}", F.explode(F.expr(f"sequence(ends[{c}].lo, ends[{c}].hi)")))
    low = "(level - least(normal[u] * cu, normal[u] * (cu + 1)) - least(normal[v] * cv, normal[v] * (cv + 1))) / normal[w]"
    high = "(level - greatest(normal[u] * cu, normal[u] * (cu + 1)) - greatest(normal[v] * cv, normal[v] * (cv + 1))) / normal[w]"
    first = F.expr(f"if(normal[w] = 0, ends[w].lo, greatest(ends[w].lo, cast(floor(least({low}, {high}) - 1e-6) AS int)))")
    last = F.expr(f"if(normal[w] = 0, ends[w].hi, least(ends[w].hi, cast(floor(greatest({low}, {high}) + 1e-6) AS int)))")
    # the last cell also holds what lies on the grid's far border
    first = F.least(first, F.expr("ends[w].hi"))
    t = t.withColumns({"from": first, "to": last}).where("`from` <= `to`").withColumn("cw", F.explode(F.sequence("from", "to")))
    at = [F.expr(f"CASE {n} WHEN u THEN cu WHEN v THEN cv ELSE cw END").alias(c) for n, c in enumerate("ijk")]
    t = t.select("object_id", "axes", *at)
    return t.where(F.expr("forall(axes, a -> a.x * (i + 0.5D) + a.y * (j + 0.5D) + a.z * (k + 0.5D) BETWEEN a.lo AND a.hi)")).select("object_id", "i", "j", "k")


def in_cell_units(triangles: DataFrame, resolution: int) -> DataFrame:
    """``triangles`` moved to their object's least corner and scaled to its pitch; objects without extent are left out."""
    ends = mesh_points(triangles).groupBy("object_id").agg(*[f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    pitch = F.greatest(*[F.col(f"hi{a}") - F.col(f"lo{a}") for a in "xyz"]) / float(resolution)
    box = ends.select(F.col("object_id").alias("_id"), "lox", "loy", "loz", pitch.alias("pitch")).where("pitch > 0")
    placed = triangles.join(box, F.col("object_id") == F.col("_id"))
    return placed.select("object_id", *[((F.col(f"{v}{a}") - F.col(f"lo{a}")) / F.col("pitch")).alias(f"{v}{a}") for v in "abc" for a in "xyz"])


def voxelize_mesh(triangles: DataFrame, resolution: int, solid: bool = True) -> DataFrame:
    """Cells that the triangles pass, and with ``solid`` those that they enclose; see ``passed_cells``."""
    shell = passed_cells(in_cell_units(triangles, resolution), resolution).distinct()
    return fill_interior(shell, resolution) if solid else shell


#: Corners of a cell's faces -X, +X, -Y, +Y, -Z, +Z, anticlockwise from outside, and the neighbour behind each.
FACES = tuple(
    (
        tuple(sign if a == axis else 0 for a in range(3)),
        tuple(
            tuple((sign > 0) if a == axis else (p if a == (axis + 1) % 3 else q) for a in range(3))
            for p, q in (((0, 0), (1, 0), (1, 1), (0, 1)) if sign > 0 else ((0, 0), (0, 1), (1, 1), (1, 0)))
        ),
    )
    for axis in range(3)
    for sign in (-1, 1)
)


def boundary_faces(cells: DataFrame) -> DataFrame:
    """``object_id, i, j, k, face``: sides of cells without an occupied neighbour behind them, numbered -X, +X, -Y, +Y, -Z, +Z along i, j, k."""
    sides = F.explode(F.array(*[F.struct(F.lit(f).alias("face"), *[F.lit(n).alias(f"d{a}") for n, a in zip(way, "ijk")]) for f, (way, _) in enumerate(FACES)]))
    every = cells.select("object_id", "i", "j", "k", sides.alias("s")).select("object_id", "i", "j", "k", "s.*")
    every = every.select("object_id", "i", "j", "k", "face", *[(F.col(a) + F.col(f"d{a}")).alias(f"n{a}") for a in "ijk"])
    there = cells.select("object_id", *[F.col(a).alias(f"n{a}") for a in "ijk"])
    return every.join(there.hint("merge"), ["object_id", "ni", "nj", "nk"], "left_anti").select("object_id", "i", "j", "k", "face")


def _columns(cells: DataFrame) -> DataFrame:
    """``object_id, i, j, w, mask, below, above``: words of cells along k, with the cell before their first and that after their last bit."""
    last = WORD - 1
    parts = F.array(
        *[
            F.struct(F.lit(d).alias("dw"), F.expr(m).alias("mask"), F.expr(b).alias("below"), F.expr(a).alias("above"))
            for d, m, b, a in ((0, "mask", "0L", "0L"), (1, "0L", f"shiftrightunsigned(mask, {last}) & 1L", "0L"), (-1, "0L", "0L", "mask & 1L"))
        ]
    )
    each = words(cells).select("object_id", "i", "j", "w", F.explode(parts).alias("p")).where("p.mask <> 0 OR p.below <> 0 OR p.above <> 0")
    each = each.select("object_id", "i", "j", (F.col("w") + F.col("p.dw")).alias("w"), "p.mask", "p.below", "p.above")
    return each.groupBy("object_id", "i", "j", "w").agg(*[F.bit_or(c).alias(c) for c in ("mask", "below", "above")])


def _corners(columns: DataFrame) -> DataFrame:
    """``object_id, x, y, w, spots, vid``: words of the corners along z that are vertices, and the number of the first.

    A corner lies on the surface if some of the eight cells around it are
    occupied and some aren't.
    """
    every = (1 << WORD) - 1
    pairs = columns.withColumn("under", F.expr(f"(shiftleft(mask, 1) | below) & {every}L")).where("mask <> 0 OR below <> 0")
    sides = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (0, 1) for y in (0, 1)]))
    at = pairs.select("object_id", "i", "j", "w", F.expr("mask | under").alias("some"), F.expr("mask & under").alias("both"), sides.alias("d"))
    at = at.select("object_id", (F.col("i") + F.col("d.x")).alias("x"), (F.col("j") + F.col("d.y")).alias("y"), "w", "some", "both")
    at = at.groupBy("object_id", "x", "y", "w").agg(F.expr("bit_or(some) & ~if(count(*) = 4, bit_and(both), 0L)").alias("spots"))
    return numbered(at, ["x", "y", "w"], F.bit_count("spots"), "vid")


def cube_mesh(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The surface of a voxel grid as an indexed mesh: ``object_id, vid, x, y, z`` and ``object_id, fid, a, b, c``.

    Faces between occupied neighbours are left out; the others are two
    triangles each, seen anticlockwise from outside. Vertices are shared and
    numbered from 0 within each object, in order of x, y, z, as are triangles
    in order of cells and faces. Repeated cells count once.

    Words of cells along k meet their neighbours and the words of the four
    columns of corners around them; numbers follow from the bits below. So
    corners and faces are made at last only, and neither is shuffled.
    """
    columns = _columns(cells)
    corners = _corners(columns)
    vertices = with_bits(corners, "spots").select(
        "object_id", F.expr("vid + bit_count(spots & (shiftleft(1L, b) - 1L))").alias("vid"), "x", "y", F.expr(f"w * {WORD} + b").alias("z")
    )

    moves = F.explode(F.array(*[F.struct(F.lit(f).alias("face"), F.lit(-way[0]).alias("di"), F.lit(-way[1]).alias("dj")) for f, (way, _) in enumerate([*FACES[:4], ((0, 0, 0), None)])]))
    asks = columns.select("object_id", "i", "j", "w", "mask", "below", "above", moves.alias("m"))
    asks = asks.select("object_id", (F.col("i") + F.col("m.di")).alias("i"), (F.col("j") + F.col("m.dj")).alias("j"), "w", "mask", "below", "above", F.col("m.face").alias("face"))
    own = [F.expr(f"bit_or(if(face = 4, {c}, 0L))").alias(c) for c in ("mask", "below", "above")]
    met = asks.groupBy("object_id", "i", "j", "w").agg(*own, *[F.expr(f"bit_or(if(face = {f}, mask, 0L))").alias(f"n{f}") for f in range(4)]).where("mask <> 0")
    behind = [*[f"n{f}" for f in range(4)], "(shiftleft(mask, 1) | below)", f"(shiftrightunsigned(mask, 1) | shiftleft(above, {WORD - 1}))"]
    open_ = met.select("object_id", "i", "j", "w", *[F.expr(f"mask & ~{n}").alias(f"g{f}") for f, n in enumerate(behind)])
    quads = numbered(open_, ["i", "j", "w"], sum((F.bit_count(f"g{f}") for f in range(1, 6)), F.bit_count("g0")))

    around = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(2 * x + y).alias("slot")) for x in (0, 1) for y in (0, 1)]))
    near = corners.select("object_id", "x", "y", "w", "spots", "vid", around.alias("d"))
    near = near.select("object_id", (F.col("x") - F.col("d.x")).alias("i"), (F.col("y") - F.col("d.y")).alias("j"), "w", "spots", "vid", F.col("d.slot").alias("slot"))
    near = near.groupBy("object_id", "i", "j", "w").agg(*[F.expr(f"max(if(slot = {s}, {c}, 0L))").alias(f"{c}{s}") for s in range(4) for c in ("spots", "vid")])

    sides = []
    for f, (_, four) in enumerate(FACES):
        ends = [c for n, (x, y, z) in enumerate(four) for c in (F.col(f"spots{2 * x + y}").alias(f"s{n}"), F.col(f"vid{2 * x + y}").alias(f"v{n}"), F.lit(int(z)).alias(f"z{n}"))]
        sides.append(F.struct(F.lit(f).alias("face"), F.col(f"g{f}").alias("shown"), *ends))
    side = quads.join(near.hint("merge"), ["object_id", "i", "j", "w"]).select("object_id", "first", *[f"g{f}" for f in range(6)], F.explode(F.array(*sides)).alias("s"))
    each = with_bits(side.select("object_id", "first", *[f"g{f}" for f in range(6)], "s.*"), "shown")
    # quads of the cells before, and of this cell's faces before
    nth = " + ".join(["first", *[f"bit_count(g{f} & (shiftleft(1L, b + if(face > {f}, 1, 0)) - 1L))" for f in range(6)]])
    each = each.select("object_id", F.expr(nth).alias("n"), *[F.expr(f"v{n} + bit_count(s{n} & (shiftleft(1L, b + z{n}) - 1L))").alias(f"v{n}") for n in range(4)])
    two = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), *[F.col(f"v{n}").alias(v) for n, v in zip(t, "abc")]) for h, t in enumerate(((0, 1, 2), (0, 2, 3)))]))
    faces = each.select("object_id", "n", two.alias("t")).select("object_id", (2 * F.col("n") + F.col("t.h")).alias("fid"), "t.a", "t.b", "t.c")
    return vertices, faces
