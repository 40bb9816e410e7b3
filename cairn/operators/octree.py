"""Octree hierarchies with content hashes, as flat relations."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.columns import level_sizes


def words(cells: DataFrame) -> DataFrame:
    """Occupied cells as bits, ``object_id, bi, bj, bk, w``: a bigint for each 4 by 4 by 4 of them, in C order; ``unpacked`` makes cells of it again."""
    at = [F.expr(f"int({a} div 4)").alias(f"b{a}") for a in "ijk"]
    return cells.groupBy("object_id", *at).agg(F.bit_or(F.expr("shiftleft(1L, int(i % 4 * 16 + j % 4 * 4 + k % 4))")).alias("w"))


def unpacked(cells: DataFrame) -> DataFrame:
    """``object_id, i, j, k`` of ``words``; cells stay as they are."""
    if "w" not in cells.columns:
        return cells
    each = cells.withColumn("b", F.explode(F.expr("filter(sequence(0, 63), b -> getbit(w, b) = 1)")))
    return each.selectExpr("object_id", "int(bi * 4 + b div 16) AS i", "int(bj * 4 + b div 4 % 4) AS j", "int(bk * 4 + b % 4) AS k")


def _packed(cells: DataFrame, resolution: int, least: int) -> DataFrame | None:
    """Occupied blocks of at most 8 cells a side, ``object_id, level, size, bi, bj, bk, w0 .. w7``: their cells in C order as bits of 8 bigints.

    Cells (or ``words`` of them, here as in all that is made from this) are grouped into one bigint for each 4 by 4 by 4 of them, and only
    those into the planes of blocks of 8. Blocks of 1 and 2 cells a side are
    grouped by themselves.
    """
    levels = {s: n for n, s in enumerate(level_sizes(resolution, least)) if n and s <= 8}
    out = None
    if levels.keys() & {4, 8}:
        four = cells if "w" in cells.columns else words(cells)
        # one row for each level; of a plane of 8 by 8 cells, a block of 4 has four bits of each of four rows
        each = four.withColumn("size", F.explode(F.array(*[F.lit(s) for s in (8, 4) if s in levels])))
        row = "shiftleft((v & 15L) | shiftleft(v & 240L, 4) | shiftleft(v & 3840L, 8) | shiftleft(v & 61440L, 12), int(bj % 2 * 32 + bk % 2 * 4))"
        bits = [row.replace("v", f"shiftrightunsigned(w, {16 * (m % 4)})") for m in range(8)]
        bits = [f"if(size = 8 AND bi % 2 = {m // 4}, {b}, {'if(size = 4, w, 0L)' if m == 0 else '0L'})" for m, b in enumerate(bits)]
        at = [F.expr(f"if(size = 8, int({c} div 2), {c})").alias(c) for c in ("bi", "bj", "bk")]
        each = each.select("object_id", "size", *at, *[F.expr(b).alias(f"w{m}") for m, b in enumerate(bits)])
        each = each.groupBy("object_id", "size", "bi", "bj", "bk").agg(*[F.bit_or(f"w{m}").alias(f"w{m}") for m in range(8)])
        level = F.expr(f"if(size = 8, {levels.get(8, 0)}, {levels.get(4, 0)})")
        out = each.select("object_id", level.alias("level"), "size", "bi", "bj", "bk", *[f"w{m}" for m in range(8)])
    cells = unpacked(cells) if levels.keys() & {1, 2} else cells
    for s in levels.keys() & {1, 2}:
        at = [F.expr(f"int({a} div {s})").alias(f"b{a}") for a in "ijk"]
        one = cells.groupBy("object_id", *at).agg(F.bit_or(F.expr(f"shiftleft(1L, int((i % {s} * {s} + j % {s}) * {s} + k % {s}))")).alias("w0"))
        one = one.select("object_id", F.lit(levels[s]).alias("level"), F.lit(s).alias("size"), "bi", "bj", "bk", "w0", *[F.lit(0).cast("long").alias(f"w{m}") for m in range(1, 8)])
        out = one if out is None else out.union(one)
    return out


def _listed():
    """``occ``, the sorted offsets of the bits of ``w0 .. w7``."""
    part = "if(w{n} = 0L, CAST(array() AS array<int>), transform(filter(sequence(0, 63), b -> getbit(w{n}, b) = 1), b -> b + {m}))"
    return F.expr("concat(" + ", ".join(part.format(n=n, m=64 * n) for n in range(8)) + ")").alias("occ")


def blocks(cells: DataFrame, resolution: int, least: int) -> DataFrame:
    """Occupied blocks of every level: ``object_id, level, bi, bj, bk, size, occ``; ``occ`` has the sorted C-order offsets of their cells.

    A cell counts once. Lists of blocks of up to 8 cells a side are made from their bits.
    """
    names = ["object_id", "level", "bi", "bj", "bk", "size", "occ"]
    packed, out = _packed(cells, resolution, least), None
    if packed is not None:
        out = packed.withColumn("occ", _listed()).select(*names)
    sizes = [(n, s) for n, s in enumerate(level_sizes(resolution, least)) if n and s > 8]
    if sizes:
        levels = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.lit(s).alias("size")) for n, s in sizes]))
        c = unpacked(cells).select("object_id", "i", "j", "k", levels.alias("l")).select("object_id", "i", "j", "k", "l.level", "l.size")
        offset = F.expr("((i % size) * size + j % size) * size + k % size")
        keys = [F.expr(f"{a} div size").cast("int").alias(f"b{a}") for a in "ijk"]
        big = c.groupBy("object_id", "level", *keys, "size").agg(F.array_sort(F.collect_set(offset)).alias("occ")).select(*names)
        out = big if out is None else out.union(big)
    return out


def content_hash(occ: str = "occ", size: str = "size"):
    """SHA-256 of a block's cells, one byte each in C order, from the sorted offsets of the occupied ones."""
    ones = f"transform({occ}, (n, x) -> concat(repeat('00', n - if(x = 0, -1, {occ}[x - 1]) - 1), '01'))"
    tail = f"repeat('00', {size} * {size} * {size} - 1 - element_at({occ}, -1))"
    return F.expr(f"sha2(unhex(concat(array_join({ones}, ''), {tail})), 256)")


@F.pandas_udf(T.StringType())
def _digest(size: pd.Series, w0: pd.Series, w1: pd.Series, w2: pd.Series, w3: pd.Series, w4: pd.Series, w5: pd.Series, w6: pd.Series, w7: pd.Series) -> pd.Series:
    """``content_hash`` of blocks of up to 8 cells a side from their bits; contents that a batch repeats are hashed once."""
    blocks = np.stack([c.to_numpy(np.int64) for c in (w0, w1, w2, w3, w4, w5, w6, w7, size)], axis=1)
    rows, known = np.ascontiguousarray(blocks).view("V72").ravel().tolist(), {}
    for row in set(rows):
        cells = np.unpackbits(np.frombuffer(row, np.uint8, 64), bitorder="little")
        known[row] = hashlib.sha256(cells[: int(np.frombuffer(row, np.int64)[8]) ** 3].tobytes()).hexdigest()
    return pd.Series([known[row] for row in rows], dtype=object)


def unique_blocks(cells: DataFrame, resolution: int, least: int) -> DataFrame:
    """``level, hash, size, occ`` of each content that an occupied block has, once.

    Contents of up to 8 cells a side are made unique as bits in the tasks, and
    only then listed and hashed.
    """
    packed, out = _packed(cells, resolution, least), None
    if packed is not None:
        bits = [f"w{n}" for n in range(8)]
        each = packed.select("level", "size", *bits).distinct()
        out = each.select("level", _digest(F.col("size").cast("long"), *bits).alias("hash"), "size", _listed())
    big = [s for s in level_sizes(resolution, least)[1:] if s > 8]
    if big:
        each = blocks(cells, resolution, big[-1]).select("level", "size", "occ").distinct()
        listed = each.select("level", content_hash().alias("hash"), "size", "occ")
        out = listed if out is None else out.union(listed)
    return out


def hashed_blocks(cells: DataFrame, resolution: int, least: int) -> DataFrame:
    """Occupied blocks with ``hash`` and ``n_cells``.

    Blocks of up to 8 cells a side are gathered as bits in at most 8 bigints,
    by hash aggregations without lists; larger ones from offsets.
    """
    packed, out = _packed(cells, resolution, least), None
    big = [s for s in level_sizes(resolution, least)[1:] if s > 8]
    if packed is not None:
        bits = [f"w{n}" for n in range(8)]
        count = sum((F.bit_count(w) for w in bits[1:]), F.bit_count(bits[0]))
        out = packed.select("object_id", "level", "bi", "bj", "bk", _digest(F.col("size").cast("long"), *bits).alias("hash"), count.alias("n_cells"))
    if big:
        listed = blocks(cells, resolution, big[-1]).select("object_id", "level", "bi", "bj", "bk", content_hash().alias("hash"), F.size("occ").alias("n_cells"))
        out = out.union(listed) if out is not None else listed
    return out


def subdivide(cells: DataFrame, objects: DataFrame, resolution: int = 16, least: int = 4, max_depth: int | None = None) -> DataFrame:
    """The subdivision map: every block of every level below the object itself, ``max_depth`` at most, empty ones included.

    Blocks of up to 8 cells a side are hashed from their bits, each content once
    a batch; of larger ones only occupied blocks are hashed. ``is_full`` tells blocks without an empty cell.
    """
    least = max(least, resolution >> max_depth) if max_depth is not None else least
    sizes = level_sizes(resolution, least)[1:]
    grid = objects.select("object_id", F.explode(F.sequence(F.lit(1), F.lit(len(sizes)))).alias("level")).withColumn("size", F.expr(f"int({resolution} >> level)"))
    for a in "ijk":
        grid = grid.withColumn(f"b{a}", F.explode(F.expr("sequence(0, (1 << level) - 1)")))
    at = ["object_id", "level", "bi", "bj", "bk"]
    if sizes and sizes[0] <= 8:  # hashed after the join, as rows that a Python function returns would be dealt anew for it
        filled = _packed(cells, resolution, least).drop("size")
        bits = [F.coalesce(f"w{n}", F.lit(0).cast("long")) for n in range(8)]
        filled_hash, n_cells, is_empty = _digest(F.col("size").cast("long"), *bits), sum((F.bit_count(w) for w in bits[1:]), F.bit_count(bits[0])), F.col("w0").isNull()
    else:
        filled = hashed_blocks(cells, resolution, least).withColumnRenamed("hash", "filled")
        empty = F.create_map(*[F.lit(x) for n, s in enumerate(sizes) for x in (n + 1, hashlib.sha256(bytes(s**3)).hexdigest())])
        filled_hash, n_cells, is_empty = F.coalesce("filled", F.element_at(empty, F.col("level"))), F.col("n_cells"), F.col("filled").isNull()
    # a merge, as sizes are unknown before the blocks are exploded and grouped
    full = grid.join(filled.hint("merge"), at, "left")
    return full.select(
        "object_id", "level", F.expr("(bi % 2) * 4 + (bj % 2) * 2 + bk % 2").alias("octant_index"),
        *[F.expr(f"(b{a} % 2) * size").alias(f"position_{x}") for a, x in zip("ijk", "xyz", strict=True)],
        *[F.expr(f"b{a} * size").alias(f"global_position_{x}") for a, x in zip("ijk", "xyz", strict=True)],
        filled_hash.alias("hash"), is_empty.alias("is_empty"),
        F.coalesce(n_cells == F.col("size") * F.col("size") * F.col("size"), F.lit(False)).alias("is_full"), "size",
    )


def children(tree: DataFrame) -> DataFrame:
    """Every block with the blocks of the next level inside it, joined on the parent's block key."""
    at = ["object_id", "level", *(f"global_position_{x}" for x in "xyz")]
    parent = tree.select(*at, F.col("hash").alias("parent_hash"))
    child = tree.where("level > 1").select(
        "object_id", (F.col("level") - 1).alias("level"), *[F.expr(f"global_position_{x} div (2 * size) * (2 * size)").cast("int").alias(f"global_position_{x}") for x in "xyz"],
        "octant_index", F.col("hash").alias("child_hash"), "is_empty",
    )
    return parent.hint("merge").join(child, at)


def lossless(cells: DataFrame, resolution: int, least: int) -> DataFrame:
    """Per level, how many cells its blocks hold and how many differ from the grid: none, if subdivision loses nothing."""
    back = blocks(cells, resolution, least).select("object_id", "level", "bi", "bj", "bk", "size", F.explode("occ").alias("n"))
    back = back.select("object_id", "level", F.expr("int(bi * size + n div (size * size))").alias("i"), F.expr("int(bj * size + n div size % size)").alias("j"), F.expr("int(bk * size + n % size)").alias("k"))
    levels = F.explode(F.sequence(F.lit(1), F.lit(len(level_sizes(resolution, least)) - 1))).alias("level")
    want = cells.select("object_id", levels, "i", "j", "k", F.lit(1).alias("side"))
    cell = want.unionByName(back.withColumn("side", F.lit(2))).groupBy("object_id", "level", "i", "j", "k").agg(F.bit_or("side").alias("sides"))
    return cell.groupBy("level").agg(F.count("*").alias("n_cells"), F.count_if(F.col("sides") != 3).alias("n_different"))


def first_children(tree: DataFrame, most: int = 8) -> DataFrame:
    """Of every block the children in octant order, ``most`` at most (a block has eight)."""
    c = children(tree)
    at = ["object_id", "level", *(f"global_position_{x}" for x in "xyz")]
    kids = c.groupBy(*at, "parent_hash").agg(F.slice(F.array_sort(F.collect_list(F.struct("octant_index", "child_hash"))), 1, most).alias("kids"))
    return kids.select(*at, "parent_hash", F.posexplode("kids").alias("nth", "k")).select(*at, "parent_hash", "nth", "k.octant_index", "k.child_hash")
