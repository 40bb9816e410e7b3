"""Ray generation as table functions: a lateral join makes the rays of every object from its own box."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

RAY = "view_id int, face_id int, n int, ox double, oy double, oz double, dx double, dy double, dz double"
BOX = [f"{e}_{a}" for e in ("lo", "hi") for a in "xyz"]


def object_boxes(cells: DataFrame, resolution: int) -> DataFrame:
    """``object_id, lo_x .. hi_z``: the box of each object's cells, in a grid centred at the origin with z, y, x along i, j, k."""
    ends = [f(c).alias(f"{n}_{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a, c in zip("xyz", "kji")]
    half = resolution / 2
    box = cells.groupBy("object_id").agg(*ends)
    return box.select("object_id", *[(F.col(f"lo_{a}") - half).alias(f"lo_{a}") for a in "xyz"], *[(F.col(f"hi_{a}") + 1 - half).alias(f"hi_{a}") for a in "xyz"])


def _uniform(*parts) -> float:
    """The number that ``columns.uniform`` gives for the same parts."""
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:15], 16) / float(1 << 60)


def _points(seed: str, name: str, view: int, low: list[float], high: list[float], face: int, samples: int) -> Iterator[tuple[int, list[float]]]:
    """``samples`` hashed-uniform points of a side of the box."""
    axis = face // 2
    others = [a for a in range(3) if a != axis]
    for n in range(samples):
        p = [0.0] * 3
        p[axis] = high[axis] if face % 2 else low[axis]
        for a, s in zip(others, "uv"):
            p[a] = low[a] + _uniform(f"{seed}{s}", name, view, face, n) * (high[a] - low[a])
        yield n, p


@udtf(returnType=RAY)
class SphereRays:
    """Rays from a box's sides towards ``divisions``² cameras round it.

    Cameras stand at twice the greatest half extent from the centre, elevations
    from 0.1 to 0.9 pi, azimuths once round. Sides -X, +X, -Y, +Y, -Z, +Z whose
    normal points away from the camera have ``samples // 3`` points each.
    """

    def eval(self, name, lo_x, lo_y, lo_z, hi_x, hi_y, hi_z, divisions, samples, seed):
        low, high = [lo_x, lo_y, lo_z], [hi_x, hi_y, hi_z]
        centre = [(a + b) / 2 for a, b in zip(low, high)]
        radius = 2 * max((b - a) / 2 for a, b in zip(low, high))
        if not radius > 0:
            return
        for e in range(divisions):
            elevation = math.pi * (0.1 + (0.8 * e / (divisions - 1) if divisions > 1 else 0.0))
            for a in range(divisions):
                azimuth = a * 2 * math.pi / divisions
                out = [math.sin(elevation) * math.cos(azimuth), math.sin(elevation) * math.sin(azimuth), math.cos(elevation)]
                camera = [c + radius * o for c, o in zip(centre, out)]
                for face in range(6):
                    if out[face // 2] * (1 if face % 2 else -1) > -1e-9:
                        continue  # turned towards the camera, or edge on
                    for n, p in _points(seed, name, e * divisions + a, low, high, face, samples // 3):
                        way = [c - x for c, x in zip(camera, p)]
                        size = math.sqrt(sum(x * x for x in way))
                        yield (e * divisions + a, face, n, *p, *(x / size for x in way))


@udtf(returnType=RAY)
class FaceRays:
    """``samples`` rays from each side of a box straight inwards; ``view_id`` is 0."""

    def eval(self, name, lo_x, lo_y, lo_z, hi_x, hi_y, hi_z, samples, seed):
        low, high = [lo_x, lo_y, lo_z], [hi_x, hi_y, hi_z]
        for face in range(6):
            way = [0.0] * 3
            way[face // 2] = -1.0 if face % 2 else 1.0
            for n, p in _points(seed, name, 0, low, high, face, samples):
                yield (0, face, n, *p, *way)


def _lateral(boxes: DataFrame, function, call: str, name: str) -> DataFrame:
    spark = boxes.sparkSession
    spark.udtf.register(name, function)
    columns = ", ".join(f"b.{c}" for c in ["object_id", *BOX])
    known = boxes.where(" AND ".join(f"{c} IS NOT NULL" for c in ["object_id", *BOX]))
    return spark.sql(f"SELECT b.object_id, r.* FROM {{boxes}} b, LATERAL {name}({columns}, {call}) r", boxes=known)


def sphere_rays(boxes: DataFrame, divisions: int, samples: int, seed: str = "42") -> DataFrame:
    """``object_id`` and the rays of ``SphereRays`` for every row of ``boxes(object_id, lo_x .. hi_z)``.

    Rows are independent: nothing is exchanged, and an object's rays are made
    one after the other. Boxes with nulls or without extent have no rays.
    """
    return _lateral(boxes, SphereRays, f"{int(divisions)}, {int(samples)}, '{seed}'", "cairn_sphere_rays")


def face_rays(boxes: DataFrame, samples: int, seed: str = "42") -> DataFrame:
    """``object_id`` and the rays of ``FaceRays`` for every row of ``boxes``."""
    return _lateral(boxes, FaceRays, f"{int(samples)}, '{seed}'", "cairn_face_rays")
