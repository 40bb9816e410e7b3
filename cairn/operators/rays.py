"""Ray sampling, traversal of occupied cells, and statistics over rays.

Grids are centred at the origin with cells of size 1. Axes are "zyx": a cell's
``i`` lies along z, ``j`` along y, ``k`` along x.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.columns import number, template, uniform

PARALLEL = 1e-8


def _axis(low: int, high: int):
    return F.explode(F.sequence(F.lit(low), F.lit(high)))


def _unit(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    n = F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y) + F.col(z) * F.col(z))
    return df.withColumn("_n", n).withColumns({c: F.col(c) / F.col("_n") for c in (x, y, z)}).drop("_n")


def sphere_views(source, divisions: int, radius) -> DataFrame:
    """``divisions``² cameras on a sphere, ``view_id, px, py, pz``: elevations from 0.1 to 0.9 pi, azimuths once round.

    Like the other samplers it takes a session, for one set, or a table of
    objects, each of which gets its own by columns in place of numbers.
    """
    (rows, names), radius = template(source), number(radius)
    step = 0.8 * math.pi / (divisions - 1) if divisions > 1 else 0.0
    v = rows.withColumn("e", _axis(0, divisions - 1)).withColumn("a", _axis(0, divisions - 1))
    elev, azim = F.lit(0.1 * math.pi) + F.col("e") * step, F.col("a") * (2 * math.pi / divisions)
    return v.select(
        *names, (F.col("e") * divisions + F.col("a")).cast("int").alias("view_id"),
        (radius * F.sin(elev) * F.cos(azim)).alias("px"), (radius * F.sin(elev) * F.sin(azim)).alias("py"), (radius * F.cos(elev)).alias("pz"),
    )


def sphere_rays(spark, divisions: int, samples: int, half: float, seed: str = "42") -> DataFrame:
    """Rays from the box's faces towards the cameras of ``sphere_views`` at twice the half extent.

    Of sampler faces -X, +X, -Y, +Y, -Z, +Z those count whose normal points
    along the view direction, with ``samples // 3`` hashed-uniform points each.
    """
    views = sphere_views(spark, divisions, 2 * half)
    rows = views.withColumn("face_id", _axis(0, 5)).withColumn("n", _axis(0, samples // 3 - 1))
    axis, sign = F.expr("face_id div 2"), F.when(F.col("face_id") % 2 == 0, -1.0).otherwise(1.0)
    toward = -F.when(axis == 0, F.col("px")).when(axis == 1, F.col("py")).otherwise(F.col("pz")) * sign / (2 * half)
    rows = rows.where(toward > 1e-9)
    a, b = ((2 * uniform(f"{seed}{s}", F.col("view_id"), F.col("face_id"), F.col("n")) - 1) * half for s in "uv")
    at = sign * half
    rows = rows.withColumns({"ox": F.when(axis == 0, at).otherwise(a), "oy": F.when(axis == 1, at).when(axis == 0, a).otherwise(b), "oz": F.when(axis == 2, at).otherwise(b)})
    rows = rows.withColumns({f"d{c}": F.col(f"p{c}") - F.col(f"o{c}") for c in "xyz"})
    return _unit(rows, "dx", "dy", "dz").select("view_id", "face_id", "n", "ox", "oy", "oz", "dx", "dy", "dz")


def face_rays(spark, samples: int, half: float, seed: str = "42") -> DataFrame:
    """``samples`` rays from every face of the box straight inwards."""
    rows = spark.range(1).select(_axis(0, 5).alias("face_id")).withColumn("n", _axis(0, samples - 1))
    axis, sign = F.expr("face_id div 2"), F.when(F.col("face_id") % 2 == 0, -1.0).otherwise(1.0)
    a, b = ((2 * uniform(f"{seed}{s}", F.col("face_id"), F.col("n")) - 1) * half for s in "uv")
    at = sign * half
    return rows.select(
        "face_id", "n", F.when(axis == 0, at).otherwise(a).alias("ox"), F.when(axis == 1, at).when(axis == 0, a).otherwise(b).alias("oy"), F.when(axis == 2, at).otherwise(b).alias("oz"),
        *[F.when(axis == n, -sign).otherwise(0.0).alias(f"d{c}") for n, c in enumerate("xyz")],
    )


def orthographic_rays(source, width: int, height: int, extent, distance) -> DataFrame:
    """A raster of parallel rays along -Z from the plane z = ``distance``; one of a single row or column begins at the border."""
    (rows, names), extent = template(source), number(extent)
    r = rows.withColumn("row", _axis(0, height - 1)).withColumn("col", _axis(0, width - 1))
    x = -extent / 2 + F.col("col") * (extent / max(1, width - 1))
    y = -extent / 2 + F.col("row") * (extent / max(1, height - 1))
    zero = F.lit(0.0)
    return r.select(*names, "row", "col", x.alias("ox"), y.alias("oy"), number(distance).alias("oz"), zero.alias("dx"), zero.alias("dy"), F.lit(-1.0).alias("dz"))


def _cross(a, b):
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _norm(v):
    n = math.sqrt(sum(c * c for c in v))
    return [c / n for c in v]


def perspective_rays(source, width: int, height: int, camera, look_at, up, fov: float = 60.0, size=1.0) -> DataFrame:
    """Rays of a pinhole camera through pixel centres; ``fov`` is vertical, in degrees. Camera and ``look_at`` are in units of ``size``."""
    forward = _norm([b - a for a, b in zip(camera, look_at, strict=True)])
    right = _norm(_cross(forward, up))
    above = _norm(_cross(right, forward))
    tall = math.tan(math.radians(fov) / 2)
    wide = width / height * tall
    rows, names = template(source)
    r = rows.withColumn("row", _axis(0, height - 1)).withColumn("col", _axis(0, width - 1))
    sx, sy = (2 * (F.col("col") + 0.5) / width - 1) * wide, (1 - 2 * (F.col("row") + 0.5) / height) * tall
    r = r.withColumns({f"d{c}": F.lit(forward[n]) + sx * right[n] + sy * above[n] for n, c in enumerate("xyz")})
    return _unit(r, "dx", "dy", "dz").select(*names, "row", "col", *[(number(size) * float(camera[n])).alias(f"o{c}") for n, c in enumerate("xyz")], "dx", "dy", "dz")


def turntable(source, views: int, radius) -> DataFrame:
    """Cameras evenly round the z axis at 0.3 of the radius above the plane."""
    (rows, names), radius = template(source), number(radius)
    a = F.col("view_id") * (2 * math.pi / views)
    return rows.withColumn("view_id", _axis(0, views - 1)).select(*names, "view_id", (radius * F.cos(a)).alias("px"), (radius * F.sin(a)).alias("py"), (0.3 * radius).alias("pz"))


def adaptive_samples(tree: DataFrame, samples: int, least: int) -> DataFrame:
    """Samples per level: halved with each, but never under ``least``."""
    return tree.select("level").distinct().select("level", F.expr(f"greatest({least}, {samples} div (1 << level))").alias("samples"))


def _slab(rays: DataFrame, resolution: int) -> DataFrame:
    """``rays`` with inverse directions, entry ``t_in`` and exit ``t_out`` of the box; a ray misses if ``t_out < max(t_in, 0)``."""
    h = resolution / 2
    inv = {f"v{a}": F.when(F.abs(F.col(f"d{a}")) > PARALLEL, 1.0 / F.col(f"d{a}")).otherwise(1e20) for a in "xyz"}
    out = rays.withColumns(inv)
    ends = [((-h - F.col(f"o{a}")) * F.col(f"v{a}"), (h - F.col(f"o{a}")) * F.col(f"v{a}")) for a in "xyz"]
    out = out.withColumn("t_in", F.greatest(*[F.least(a, b) for a, b in ends]))
    for (a, b), axis in zip(ends, "xyz", strict=True):
        out = out.withColumn(f"f{axis}", F.greatest(a, b))
    return out.withColumn("t_out", F.least("fx", "fy", "fz"))


def hits_box() -> Column:
    return (F.col("t_in") <= F.col("t_out")) & (F.col("t_out") >= 0)


def _crossed(axis: str, h: float, resolution: int, every: int) -> str:
    """The planes between entry and exit, one in ``every``, rounded outwards."""
    ends = ", ".join(f"(o{axis} + d{axis} * {t} + {h})" + f" / {every}" * (every > 1) for t in ("begin", "t_out"))
    low = f"greatest(0, int(floor(least({ends}))))"
    return f"sequence({low}, greatest({low}, least({-(-resolution // every)}, int(ceil(greatest({ends}))))))"


def _cuts(resolution: int, every: int = 1) -> Column:
    """The sorted distances ``begin``, ``t_out`` and those between at which a ray crosses planes, one in ``every``."""
    h, at = resolution / 2, "p" if every == 1 else f"p * {every}"
    planes = ", ".join(f"if(abs(d{a}) > {PARALLEL}, transform({_crossed(a, h, resolution, every)}, p -> ({at} - {h} - o{a}) * v{a}), array())" for a in "xyz")
    return F.expr(f"array_sort(array_distinct(concat(array(begin, t_out), filter(concat({planes}), t -> t > begin AND t < t_out))))")


def segments(rays: DataFrame, resolution: int) -> DataFrame:
    """``rays`` with ``cuts``: the sorted distances at which each ray enters, changes cells and leaves; null for misses."""
    out = _slab(rays, resolution).withColumn("begin", F.greatest("t_in", F.lit(0.0)))
    return out.withColumn("cuts", F.when(hits_box(), _cuts(resolution)))


def _cell(axis: str, h: float) -> str:
    return f"int(floor(o{axis} + d{axis} * (cuts[n] + cuts[n + 1]) / 2 + {h}))"


def _steps(h: float) -> str:
    """Length and cell of every stretch between two cuts."""
    part = f"named_struct('len', cuts[n + 1] - cuts[n], 'i', {_cell('z', h)}, 'j', {_cell('y', h)}, 'k', {_cell('x', h)})"
    return f"if(size(cuts) > 1, transform(sequence(0, size(cuts) - 2), n -> {part}), array())"


def masks(cells: DataFrame, resolution: int) -> DataFrame:
    """``object_id, planes``: for each occupied i of a grid of up to 62 cells a side, a bigint of occupied k for every j.

    One hash aggregation gathers a plane's bits in as many bigints as it has
    rows; objects then collect at most ``resolution`` planes.
    """
    if resolution > 62:
        raise ValueError("grids of more than 62 cells a side are traced with trace_cells")
    row = [F.expr(f"bit_or(if(j = {n}, shiftleft(1L, k), 0L))").alias(f"m{n}") for n in range(resolution)]
    plane = cells.groupBy("object_id", "i").agg(*row).select("object_id", "i", F.array(*[f"m{n}" for n in range(resolution)]).alias("rows"))
    return plane.groupBy("object_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "rows"))).alias("planes"))


def trace(rays: DataFrame, cells: DataFrame, resolution: int, whole: bool = False) -> DataFrame:
    """``ray_id, object_id, distance, hit``: each ray's length inside its object's occupied cells; if ``whole``, with the rays' ``ox .. dz``.

    Objects are compacted to bit masks, so the rays are joined once, on their
    object, and walked without exploding them into segments.
    """
    h = resolution / 2
    ready = segments(rays, resolution).select("ray_id", "object_id", *[f"{p}{a}" for p in "od" for a in "xyz"], "cuts")
    joined = ready.join(masks(cells, resolution).hint("merge"), "object_id", "left")
    inside = " AND ".join(f"s.{a} BETWEEN 0 AND {resolution - 1}" for a in "ijk")
    add = f"if({inside} AND getbit(planes[s.i][s.j], s.k) = 1, s.len, 0D)"
    total = F.expr(f"if(cuts IS NULL OR planes IS NULL, 0D, aggregate({_steps(h)}, 0D, (t, s) -> t + {add}))")
    return joined.select("ray_id", "object_id", *[f"{p}{a}" for p in "od" for a in "xyz" if whole], total.alias("distance")).withColumn("hit", (F.col("distance") > 0).cast("int"))


#: Cells a side of the bricks of ``trace_cells``; four rows of one are a bigint.
BRICK = 16


def _bricks(cells: DataFrame) -> DataFrame:
    """``object_id, bi, bj, bk, words``: occupied bricks as 64 bigints, four for each i, each the bits of four rows along k."""
    inner = {a: f"pmod({a}, {BRICK})" for a in "ijk"}
    at = [F.expr(f"int(({a} - {inner[a]}) div {BRICK})").alias(f"b{a}") for a in "ijk"]
    rows = [F.expr(f"bit_or(if({inner['j']} div 4 = {n}, shiftleft(1L, int({inner['j']} % 4 * {BRICK} + {inner['k']})), 0L))").alias(f"m{n}") for n in range(4)]
    plane = cells.groupBy("object_id", *at, F.expr(f"int({inner['i']})").alias("i")).agg(*rows)
    brick = plane.groupBy("object_id", "bi", "bj", "bk").agg(F.map_from_entries(F.collect_list(F.struct("i", F.array(*[f"m{n}" for n in range(4)]).alias("rows")))).alias("planes"))
    whole = F.expr(f"flatten(transform(sequence(0, {BRICK - 1}), i -> coalesce(planes[i], array(0L, 0L, 0L, 0L))))")
    return brick.select("object_id", "bi", "bj", "bk", whole.alias("words"))


def crossed_bricks(rays: DataFrame, resolution: int) -> DataFrame:
    """``rays`` once for each brick that they cross, ``bi, bj, bk``, with the distances ``begin`` and ``end`` between which they do; those that miss the box once, with nulls."""
    h = resolution / 2
    out = _slab(rays, resolution).withColumn("begin", F.greatest("t_in", F.lit(0.0)))
    out = out.withColumn("cuts", F.when(hits_box(), _cuts(resolution, every=BRICK)))
    in_brick = ", ".join(f"'b{a}', int(floor((o{x} + d{x} * (cuts[n] + cuts[n + 1]) / 2 + {h}) / {BRICK}))" for a, x in zip("ijk", "zyx", strict=True))
    parts = f"if(size(cuts) > 1, transform(sequence(0, size(cuts) - 2), n -> named_struct({in_brick}, 'begin', cuts[n], 'end', cuts[n + 1])), null)"
    return out.select("ray_id", "object_id", *[f"{p}{a}" for p in "od" for a in "xyz"], F.expr(f"inline_outer({parts})"))


def _walk(resolution: int):
    """A function of rays, the stretches ``begin, end`` that they have in a brick, and its place and words (null: empty): their length inside occupied cells."""
    h = resolution / 2

    @F.pandas_udf(T.DoubleType())
    def walk(ox: pd.Series, oy: pd.Series, oz: pd.Series, dx: pd.Series, dy: pd.Series, dz: pd.Series, begin: pd.Series, end: pd.Series, bi: pd.Series, bj: pd.Series, bk: pd.Series, words: pd.Series) -> pd.Series:
        out, full = np.zeros(len(words)), words.notna().to_numpy()
        columns = lambda *c: np.stack([x.to_numpy(np.float64)[full] for x in c], axis=1)
        if full.any():
            o, d, ends, base = columns(oz, oy, ox), columns(dz, dy, dx), columns(begin, end), columns(bi, bj, bk) * BRICK
            with np.errstate(divide="ignore"):
                v = np.where(np.abs(d) > PARALLEL, 1.0 / d, np.inf)
            planes = base[:, :, None] + np.arange(BRICK + 1)
            with np.errstate(invalid="ignore"):
                t = (planes - h - o[:, :, None]) * v[:, :, None]
            inner = (t > ends[:, :1, None]) & (t < ends[:, 1:, None]) & (planes <= resolution)
            cuts = np.sort(np.concatenate([ends, np.where(inner, t, ends[:, 1:, None]).reshape(len(t), -1)], axis=1), axis=1)
            twice = cuts[:, :-1] + cuts[:, 1:]
            i, j, k = (np.floor(o[:, a, None] + d[:, a, None] * twice / 2 + h).astype(np.int64) - base[:, a, None].astype(np.int64) for a in range(3))
            inside = (np.minimum(np.minimum(i, j), k) >= 0) & (np.maximum(np.maximum(i, j), k) < BRICK)
            i, j, k = (np.where(inside, x, 0) for x in (i, j, k))
            bits = np.take_along_axis(np.stack(words[full].to_numpy()), i * 4 + j // 4, axis=1) >> (j % 4 * BRICK + k) & 1
            out[full] = np.where(inside & (bits == 1), np.diff(cuts, axis=1), 0.0).sum(axis=1)
        return pd.Series(out)

    return walk


def trace_cells(rays: DataFrame, cells: DataFrame, resolution: int) -> DataFrame:
    """As ``trace`` for grids of any size; ``ray_id`` must be unique.

    Rays are exploded into the bricks that they cross, not into segments; those
    meet the bricks' bit masks, in whose planes an Arrow kernel walks them.
    """
    met = crossed_bricks(rays, resolution).join(_bricks(cells).hint("merge"), ["object_id", "bi", "bj", "bk"], "left")
    length = _walk(resolution)(*[f"{p}{a}" for p in "od" for a in "xyz"], "begin", "end", "bi", "bj", "bk", "words")
    out = met.select("ray_id", "object_id", length.alias("len")).groupBy("object_id", "ray_id").agg(F.sum("len").alias("distance"))
    return out.select("ray_id", "object_id", "distance").withColumn("hit", (F.col("distance") > 0).cast("int"))


def trace_exit(rays: DataFrame, resolution: int) -> DataFrame:
    """Where each ray leaves the box: point and patch face (+X, -X, +Y, -Y, +Z, -Z), ties going to x, then y."""
    s = _slab(rays, resolution).where(hits_box())
    face = F.when((F.col("fx") <= F.col("fy")) & (F.col("fx") <= F.col("fz")), F.when(F.col("dx") > 0, 0).otherwise(1))
    face = face.when(F.col("fy") <= F.col("fz"), F.when(F.col("dy") > 0, 2).otherwise(3)).otherwise(F.when(F.col("dz") > 0, 4).otherwise(5))
    return s.select("ray_id", face.alias("exit_face"), *[(F.col(f"o{a}") + F.col("t_out") * F.col(f"d{a}")).alias(f"e{a}") for a in "xyz"])


def ray_statistics(traced: DataFrame, *by: str) -> DataFrame:
    """Rays, hits, hit rate, and the distances of hits, per group."""
    d = F.when(F.col("hit") == 1, F.col("distance"))
    out = traced.groupBy(*by).agg(F.count("*").alias("n_rays"), F.sum("hit").alias("n_hits"), F.min(d).alias("min_distance"), F.max(d).alias("max_distance"), F.avg(d).alias("mean_distance"))
    return out.withColumn("hit_rate", 100.0 * F.col("n_hits") / F.col("n_rays"))


def normalize_distance(traced: DataFrame, level: Column, base: int = 128) -> DataFrame:
    """Distances over the diagonal of a block of the ray's level."""
    size = F.lit(float(base)) / F.pow(F.lit(2.0), level)
    return traced.withColumn("distance", F.col("distance") / F.sqrt(3 * size * size))


def occlusion(traced: DataFrame) -> DataFrame:
    """Mean occupied length over all of an object's rays."""
    return traced.groupBy("object_id").agg(F.avg("distance").alias("occlusion"), F.count("*").alias("n_rays"))


def trace_rays(rays: DataFrame, cells: DataFrame, resolution: int) -> DataFrame:
    """``trace`` for directions of any length but zero, which raise an error; distances are in cells."""
    size = F.sqrt(sum((F.col(f"d{a}") * F.col(f"d{a}") for a in "yz"), F.col("dx") * F.col("dx")))
    unit = F.when(size > 0, size).otherwise(F.raise_error(F.concat(F.lit("no direction: ray "), F.col("ray_id").cast("string"))))
    return trace(rays.withColumns({f"d{a}": F.col(f"d{a}") / unit for a in "xyz"}), cells, resolution)


def level_statistics(traced: DataFrame, occupancy: DataFrame) -> DataFrame:
    """``ray_statistics`` per level, with the mean occupancy over the objects that the level's rays meet."""
    met = traced.select("level", "object_id").distinct().join(occupancy.select("object_id", "occupancy_ratio"), "object_id")
    return ray_statistics(traced, "level").join(met.groupBy("level").agg(F.avg("occupancy_ratio").alias("mean_occupancy")), "level")
