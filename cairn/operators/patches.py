"""Boundary patches of a box: geometry, look-up and solid angles.

Patch faces are numbered +X, -X, +Y, -Y, +Z, -Z.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.columns import number, template


def _names(patches: DataFrame) -> list[str]:
    return [c for c in ("object_id", "patch_id") if c in patches.columns]


def _sign(face: Column) -> Column:
    return F.when(face % 2 == 0, 1.0).otherwise(-1.0)


def boundary_patches(source, low, high, per_face: int = 8) -> DataFrame:
    """``6 * per_face²`` patches; on each face u runs fastest. u is the first axis that the face isn't perpendicular to.

    ``source`` is a session, with numbers as the box's ends, or a table of
    objects, each of which has patches by the columns given as its ends.
    """
    axis_of = lambda values, axis: F.when(axis == 0, number(values[0])).when(axis == 1, number(values[1])).otherwise(number(values[2]))
    rows, names = template(source)
    p = rows.withColumn("patch_id", F.explode(F.sequence(F.lit(0), F.lit(6 * per_face * per_face - 1))))
    p = p.withColumns({"face_id": F.expr(f"int(patch_id div {per_face * per_face})"), "local_idx": F.expr(f"patch_id % {per_face * per_face}")})
    axis = F.expr("face_id div 2")
    u_axis, v_axis = F.when(axis == 0, 1).otherwise(0), F.when(axis == 2, 1).otherwise(2)
    p = p.withColumns({"u": F.col("local_idx") % per_face, "v": F.expr(f"local_idx div {per_face}")})
    u_low, v_low = axis_of(low, u_axis), axis_of(low, v_axis)
    u_step, v_step = (axis_of(high, u_axis) - u_low) / per_face, (axis_of(high, v_axis) - v_low) / per_face
    p = p.withColumns({"u_min": u_low + F.col("u") * u_step, "u_max": u_low + (F.col("u") + 1) * u_step, "v_min": v_low + F.col("v") * v_step, "v_max": v_low + (F.col("v") + 1) * v_step})
    at = F.when(F.col("face_id") % 2 == 0, axis_of(high, axis)).otherwise(axis_of(low, axis))
    u_mid, v_mid = (F.col("u_min") + F.col("u_max")) / 2, (F.col("v_min") + F.col("v_max")) / 2
    centre = lambda n: F.when(axis == n, at).when(u_axis == n, u_mid).otherwise(v_mid)
    normal = lambda n: F.when(axis == n, _sign(F.col("face_id"))).otherwise(0.0)
    return p.select(
        *names, "patch_id", "face_id", "local_idx", *[centre(n).alias(f"center_{a}") for n, a in enumerate("xyz")], *[normal(n).alias(f"normal_{a}") for n, a in enumerate("xyz")],
        (u_step * v_step).alias("area"), "u_min", "u_max", "v_min", "v_max",
    )


def decode_index(df: DataFrame, index: str, per_face: int) -> DataFrame:
    """Face, u and v of a patch index, and the opposite face."""
    n = per_face * per_face
    return df.withColumns({"face_id": F.expr(f"int({index} div {n})"), "v": F.expr(f"int({index} % {n} div {per_face})"), "u": F.expr(f"int({index} % {per_face})")}).withColumn(
        "opposite_face", F.col("face_id").bitwiseXOR(F.lit(1))
    )


def sample_points(patches: DataFrame, u: Column, v: Column) -> DataFrame:
    """A point of every patch at fractions ``u``, ``v`` of its sides."""
    pu, pv = F.col("u_min") + u * (F.col("u_max") - F.col("u_min")), F.col("v_min") + v * (F.col("v_max") - F.col("v_min"))
    axis = F.expr("face_id div 2")
    coordinate = {"x": F.when(axis == 0, F.col("center_x")).otherwise(pu), "y": F.when(axis == 1, F.col("center_y")).when(axis == 0, pu).otherwise(pv), "z": F.when(axis == 2, F.col("center_z")).otherwise(pv)}
    return patches.select(*_names(patches), *[c.alias(a) for a, c in coordinate.items()])


def exit_patch(points: DataFrame, low: float, high: float, per_face: int) -> DataFrame:
    """``points(px, py, pz, dx, dy, dz)`` with the patch of a cube's boundary at which they leave.

    A point within 1e-6 of a face belongs to it, the first in order; from
    inside, the direction decides.
    """
    near = F.lit(None).cast("int")
    for face in reversed(range(6)):
        a = "xyz"[face // 2]
        near = F.when(F.abs(F.col(f"p{a}") - (low if face % 2 else high)) < 1e-6, face).otherwise(near)
    times = []
    for face in range(6):
        a = "xyz"[face // 2]
        t = ((low if face % 2 else high) - F.col(f"p{a}")) * F.when(F.abs(F.col(f"d{a}")) > 1e-8, 1.0 / F.col(f"d{a}"))
        times.append(F.when(t > 0, t).otherwise(math.inf))
    every = F.array(*times)
    face = F.coalesce(near, F.array_position(every, F.array_min(every)).cast("int") - 1)
    part = lambda a: F.least(F.lit(per_face - 1), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1 - 1e-6), (F.col(f"p{a}") - low) / (high - low))) * per_face))
    out = points.withColumn("_to", F.struct(face.alias("face"), F.array(*map(part, "xyz")).alias("at")))
    index = f"int(t.face * {per_face * per_face} + t.at[if(t.face div 2 = 2, 1, 2)] * {per_face} + t.at[if(t.face div 2 = 0, 1, 0)])"
    out = out.withColumn("_to", F.expr(f"transform(array(_to), t -> named_struct('face', t.face, 'patch', {index}))[0]"))
    return out.withColumns({"exit_face": F.col("_to.face"), "exit_patch": F.col("_to.patch")}).drop("_to")


def solid_angle(patches: DataFrame, point: tuple[float, float, float]) -> DataFrame:
    """Solid angle of every patch from ``point``: area * cos / r², a half sphere on the patch itself, 0 where the view is along its normal."""
    d = [F.col(f"center_{a}") - float(point[n]) for n, a in enumerate("xyz")]
    r2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    r = F.sqrt(r2)
    cos = -(d[0] * F.col("normal_x") + d[1] * F.col("normal_y") + d[2] * F.col("normal_z")) / r
    return patches.select(*_names(patches), F.when(r < 1e-8, 2 * math.pi).when(cos <= 0, 0.0).otherwise(F.col("area") * cos / r2).alias("solid_angle"))
