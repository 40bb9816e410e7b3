"""Monte-Carlo light transport through a voxel grid, one incident condition a group."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import octree
from cairn.plans.stages import partitions


@dataclass(frozen=True)
class OpticalProperties:
    """Scattering and absorption per unit length and the phase function's asymmetry."""

    sigma_s: float
    sigma_a: float
    g: float = 0.0

    def __post_init__(self):
        if self.sigma_s < 0 or self.sigma_a < 0:
            raise ValueError("coefficients must be non-negative")
        if self.sigma_t <= 0:
            raise ValueError("one coefficient must be positive")
        if not -1 <= self.g <= 1:
            raise ValueError("g lies in [-1, 1]")

    @property
    def sigma_t(self) -> float:
        return self.sigma_s + self.sigma_a

    @property
    def albedo(self) -> float:
        return self.sigma_s / self.sigma_t

    @property
    def mean_free_path(self) -> float:
        return 1 / self.sigma_t


#: Incident conditions that are walked together, and passed on together to another task where a matrix has more.
TOGETHER = 256
#: Contents whose matrices a task keeps, for structures that have them again.
KNOWN = 512
#: Rows sent back at once.
ROWS = 1 << 16

_GOLDEN, _FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(key: np.ndarray) -> np.ndarray:
    z = (key ^ (key >> np.uint64(30))) * _FIRST
    z = (z ^ (z >> np.uint64(27))) * _SECOND
    return z ^ (z >> np.uint64(31))


def _drawn(key: np.ndarray) -> np.ndarray:
    """The next uniform number of every path, whose ``key`` goes on."""
    key += _GOLDEN
    return (_mixed(key) >> np.uint64(11)) * 2.0**-53


def _basis(d: np.ndarray, n_sh: int = 9) -> np.ndarray:
    """Harmonics of the directions ``d``, which are a row an axis."""
    x, y, z = d
    one = np.full(len(x), 0.282094791773878)
    of = [lambda: one, lambda: 0.4886025119029199 * y, lambda: 0.4886025119029199 * z, lambda: 0.4886025119029199 * x, lambda: 1.092548430592079 * x * y, lambda: 1.092548430592079 * y * z, lambda: 0.31539156525252 * (3 * z * z - 1), lambda: 1.092548430592079 * x * z, lambda: 0.54627421529604 * (x * x - y * y)]
    return np.stack([f() for f in of[:n_sh]])


def _about(axis: np.ndarray, sine: np.ndarray, cosine: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Directions at an angle from ``axis``, turned by ``phi`` about it."""
    x, y, z = axis
    steep = np.abs(y) >= 0.999
    # across: the y axis (x where that is too near) crossed with the axis
    t = np.stack([np.where(steep, 0.0, z), np.where(steep, -z, 0.0), np.where(steep, y, -x)])
    t /= np.sqrt((t * t).sum(0))
    b = np.stack([y * t[2] - z * t[1], z * t[0] - x * t[2], x * t[1] - y * t[0]])
    return sine * np.cos(phi) * t + sine * np.sin(phi) * b + cosine * axis


def simulate(grid: np.ndarray, asked: np.ndarray, props: OpticalProperties, per_face: int, n_sh: int, samples: int, bounces: int, seed: int) -> np.ndarray:
    """``[condition, patch, harmonic]``: the light of the conditions ``asked`` that leaves ``grid`` (by z, y, x), a mean over ``samples`` paths each.

    All paths advance together. They fly as if every cell were occupied; where a
    flight ends in an empty one it goes on as it was, which is as if only the
    way through occupied cells counted. Numbers are hashed from seed, condition,
    path and turn, so no path depends on what is walked beside it.
    """
    resolution = len(grid)
    h, cells, patches = resolution / 2, grid.ravel(), 6 * per_face * per_face
    nth = np.repeat(np.arange(len(asked)), samples)
    patch, mode = np.divmod(asked[nth], n_sh)
    with np.errstate(over="ignore"):
        key = _mixed(_mixed(np.uint64(seed) * _GOLDEN + asked[nth].astype(np.uint64)) + np.tile(np.arange(samples, dtype=np.uint64), len(asked)) * _SECOND)
        face, local = np.divmod(patch, per_face * per_face)
        axis, side = face // 2, np.where(face % 2 == 0, 1.0, -1.0)
        inward = np.where(np.arange(3)[:, None] == axis, -side, 0.0)
        pos = -inward * h
        paths = np.arange(len(nth))
        for a, step in ((np.where(axis == 0, 1, 0), local % per_face), (np.where(axis == 2, 1, 2), local // per_face)):
            pos[a, paths] = -h + (step + _drawn(key)) * resolution / per_face
        phi, c2 = 2 * np.pi * _drawn(key), _drawn(key)
        way = _about(inward, np.sqrt(1 - c2), np.sqrt(c2), phi)
        weight = _basis(-way, n_sh)[mode, paths]
        bounce, left = np.zeros(len(nth), np.int32), []
        while len(nth):
            flight = -np.log(1 - _drawn(key)) / props.sigma_t
            with np.errstate(divide="ignore", invalid="ignore"):
                out = np.where(np.abs(way) > 1e-8, (np.where(way > 0, h, -h) - pos) / way, np.inf).min(0)
            gone = flight >= out
            if gone.any():
                q, d = pos[:, gone] + way[:, gone] * out[gone], way[:, gone]
                far = np.abs(q).argmax(0)
                each = np.arange(len(far))
                f = far * 2 + (q[far, each] < 0)
                uv = [np.where(far == 0, q[1], q[0]), np.where(far == 2, q[1], q[2])]
                iu, iv = (np.clip(((c + h) / resolution * per_face).astype(int), 0, per_face - 1) for c in uv)
                cos = np.maximum(0, d[far, each] * np.where(f % 2 == 0, 1.0, -1.0))
                left.append((nth[gone] * patches + f * per_face * per_face + iv * per_face + iu, weight[gone] * cos * _basis(d, n_sh)))
                stay = ~gone
                nth, key, pos, way, weight, bounce, flight = nth[stay], key[stay], pos[:, stay], way[:, stay], weight[stay], bounce[stay], flight[stay]
            pos += way * flight
            x, y, z = np.clip((pos + h).astype(np.int64), 0, resolution - 1)
            hit = np.flatnonzero(cells[(z * resolution + y) * resolution + x])
            if not len(hit):
                continue
            keys = key[hit]
            u1, u2 = _drawn(keys), 2 * np.pi * _drawn(keys)
            if abs(props.g) < 1e-4:
                c = 1 - 2 * u1
            else:
                s = (1 - props.g**2) / (1 - props.g + 2 * props.g * u1)
                c = np.clip((1 + props.g**2 - s * s) / (2 * props.g), -1, 1)
            way[:, hit] = _about(way[:, hit], np.sqrt(np.maximum(0, 1 - c * c)), c, u2)
            weights = weight[hit] * props.albedo
            bounce[hit] += 1
            weak = (bounce[hit] > 3) & (np.abs(weights) < 0.01)
            saved = _drawn(keys) < 0.1
            dead = weak & ~saved | (bounce[hit] >= bounces)
            weight[hit] = np.where(weak, weights * 10, weights)
            key[hit] = keys
            if dead.any():
                stay = np.ones(len(nth), bool)
                stay[hit[dead]] = False
                nth, key, pos, way, weight, bounce = nth[stay], key[stay], pos[:, stay], way[:, stay], weight[stay], bounce[stay]
    if not left:
        return np.zeros((len(asked), patches, n_sh))
    at, values = np.concatenate([x[0] for x in left]), np.concatenate([x[1] for x in left], 1)
    sums = np.stack([np.bincount(at, v, len(asked) * patches) for v in values], 1)
    return sums.reshape(len(asked), patches, n_sh) / samples


def transfer_matrix(conditions: DataFrame, cells: DataFrame, resolution: int, props: OpticalProperties, per_face: int, n_sh: int = 9, samples: int = 200, bounces: int = 256, seed: int = 42) -> DataFrame:
    """``structure, in_idx, out_idx, value``: light of incident conditions that leaves through every patch, by harmonics.

    ``conditions(structure, in_idx)``; index = patch * n_sh + harmonic. Paths
    start cosine-distributed on the incident patch, fly an exponential length
    of occupied way, scatter by the albedo and the phase function, and play
    Russian roulette below weight 0.01 after three bounces. Each condition has
    a seed of its own, so results don't depend on how work is dealt out, and
    structures of equal cells have equal matrices: a task walks each once.
    The walk itself needs a Python kernel (see ``simulate``).

    Cells are sent as bits. A structure's conditions stay together where it was
    dealt, unless they are over ``TOGETHER``: then parts of them are dealt out.
    """
    rows = octree.words(cells).groupBy(F.col("object_id").alias("structure")).agg(F.collect_list(F.struct("bi", "bj", "bk", "w")).alias("words"))
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64()]
    wide = -(-resolution // 4)

    def occupied(words) -> np.ndarray:
        four = np.zeros((wide, wide, wide, 64), bool)
        if len(words):
            i, j, k, w = (words.field(n).to_numpy(zero_copy_only=False) for n in range(4))
            four[i, j, k] = np.unpackbits(np.ascontiguousarray(w, np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cells = four.reshape(wide, wide, wide, 4, 4, 4).transpose(0, 3, 1, 4, 2, 5).reshape((4 * wide,) * 3)
        return np.ascontiguousarray(cells[:resolution, :resolution, :resolution])

    def run(batches):
        known: dict[tuple, tuple] = {}
        held, n = [], 0

        def batch_of(held):
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], names=["structure", "in_idx", "out_idx", "value"])

        for batch in batches:
            structures, asks, words = (batch.column(batch.schema.get_field_index(c)) for c in ("structure", "asked", "words"))
            for at in range(batch.num_rows):
                grid, asked = occupied(words[at].values), np.array(asks[at].values, np.int64)
                content = grid.tobytes(), asked.tobytes()
                if content not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    values = simulate(grid, asked, props, per_face, n_sh, samples, bounces, seed)
                    full = values.any(2)  # patches that light left through
                    c, p = (np.repeat(x, n_sh) for x in np.nonzero(full))
                    outs = p * n_sh + np.tile(np.arange(n_sh), int(full.sum()))
                    some = values[full].ravel() != 0
                    known[content] = tuple(pa.array(x[some], t) for x, t in zip((asked[c], outs, values[full].ravel()), kinds[1:], strict=True))
                found = known[content]
                held.append([pa.repeat(structures[at], len(found[0])), *found])
                n += len(found[0])
                if n >= ROWS:
                    yield batch_of(held)
                    held, n = [], 0
        if held:
            yield batch_of(held)

    asked = conditions.select("structure", "in_idx", F.expr(f"in_idx div {TOGETHER}").alias("part"))
    asked = asked.groupBy("structure", "part").agg(F.sort_array(F.collect_list(F.col("in_idx").cast("int"))).alias("asked"))
    # a merge, as Spark knows only the cells' size before they are exploded and would broadcast all lists
    ready = asked.join(rows.hint("merge"), "structure", "left").withColumn("words", F.coalesce("words", F.expr("cast(array() AS array<struct<bi:int,bj:int,bk:int,w:bigint>>)")))
    if 6 * per_face * per_face * n_sh > TOGETHER:
        ready = ready.repartition(partitions(cells.sparkSession), "structure", "part")
    return ready.select(F.col("structure").cast("string"), "asked", "words").mapInArrow(run, "structure string, in_idx int, out_idx int, value double")
