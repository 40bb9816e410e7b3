"""The same queries as SQL for an independent engine (DuckDB's dialect)."""

from __future__ import annotations

from cairn.functions.columns import SH_C0, SH_C1, SH_C2_0, SH_C2_1, SH_C2_2

OBJECTS = "objects AS (SELECT printf('%04d', p_partkey) AS object_id FROM part)"
CELLS = """cells AS (
  SELECT printf('%04d', p_partkey) AS object_id, a.i::INT AS i, b.j::INT AS j, c.k::INT AS k
  FROM part, range(16) a(i), range(16) b(j), range(16) c(k)
  WHERE CASE p_partkey % 3 WHEN 0 THEN (i - 8) * (i - 8) + (j - 8) * (j - 8) + (k - 8) * (k - 8) <= (p_size % 8) * (p_size % 8)
        WHEN 1 THEN i < p_size % 16 AND j < 8 AND k < 8 ELSE (i + j + k) % (2 + p_size % 5) = 0 END)"""
LEVELS = "levels(level, size) AS (VALUES (1, 8), (2, 4))"
FILLED = f"""{CELLS}, {OBJECTS}, {LEVELS},
occ AS (
  SELECT object_id, level, size, i // size AS bi, j // size AS bj, k // size AS bk, ((i % size) * size + j % size) * size + k % size AS n
  FROM cells, levels),
steps AS (SELECT *, lag(n) OVER (PARTITION BY object_id, level, bi, bj, bk ORDER BY n) AS p FROM occ),
filled AS (
  SELECT object_id, level, size, bi, bj, bk, count(*) AS n_cells,
         sha256(unhex(string_agg(repeat('00', n - coalesce(p, -1) - 1) || '01', '' ORDER BY n) || repeat('00', size * size * size - 1 - max(n)))) AS h
  FROM steps GROUP BY object_id, level, size, bi, bj, bk)"""
TREE = f"""{FILLED},
tree AS (
  SELECT o.object_id, l.level, ((a.b % 2) * 4 + (b.b % 2) * 2 + c.b % 2) AS octant_index,
         (a.b % 2) * l.size AS position_x, (b.b % 2) * l.size AS position_y, (c.b % 2) * l.size AS position_z,
         a.b * l.size AS global_position_x, b.b * l.size AS global_position_y, c.b * l.size AS global_position_z,
         coalesce(f.h, sha256(unhex(repeat('00', l.size * l.size * l.size)))) AS hash, f.h IS NULL AS is_empty,
         coalesce(f.n_cells = l.size * l.size * l.size, false) AS is_full, l.size
  FROM objects o CROSS JOIN levels l JOIN range(4) a(b) ON a.b < 16 // l.size JOIN range(4) b(b) ON b.b < 16 // l.size JOIN range(4) c(b) ON c.b < 16 // l.size
  LEFT JOIN filled f ON f.object_id = o.object_id AND f.level = l.level AND f.bi = a.b AND f.bj = b.b AND f.bk = c.b)"""


def u(seed: str, *cols: str) -> str:
    """Hashed uniform number."""
    return f"(('0x' || substr(sha256(concat_ws('|', '{seed}', {', '.join(f'{c}::VARCHAR' for c in cols)})), 1, 15))::BIGINT / {float(1 << 60)!r}::DOUBLE)"


def bits(seed: str, *cols: str) -> str:
    return f"(('0x' || substr(sha256(concat_ws('|', '{seed}', {', '.join(f'{c}::VARCHAR' for c in cols)})), 1, 15))::BIGINT)"


def r(x: str, digits: int = 6) -> str:
    return f"(round(({x})::DOUBLE, {digits}) + 0.0::DOUBLE)"


SPLITS = f"""numbered AS (SELECT object_id, row_number() OVER (ORDER BY {bits('42', 'object_id')}, object_id) AS rank, count(*) OVER () AS n FROM objects),
splits AS (
  SELECT object_id, CASE WHEN rank <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rank <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM numbered)"""
USAGE = f"""{TREE}, {SPLITS},
usage AS (
  SELECT hash, object_id, split, count(*) AS n, bool_or(is_empty) AS is_empty, bool_or(is_empty OR is_full) AS uniform
  FROM tree JOIN splits USING (object_id) GROUP BY hash, object_id, split),
contents AS (
  SELECT hash, bit_or(CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 4 END) AS mask, bool_or(is_empty) AS trivial, bool_or(uniform) AS uniform, count(*) AS objects
  FROM usage GROUP BY hash)"""
BUCKET = "CASE WHEN {t} THEN 'trivial' ELSE ['train_only', 'val_only', 'train_val', 'test_only', 'train_test', 'val_test', 'all_splits'][mask] END"
RAYS = """aim AS (
  SELECT o_orderkey AS ray_id, printf('%04d', o_orderkey % (SELECT count(*) FROM part) + 1) AS object_id,
         ((o_orderkey * 13) % 4001) / 100.0::DOUBLE - 20.0037::DOUBLE AS ox, ((o_orderkey * 29) % 4001) / 100.0::DOUBLE - 20.0041::DOUBLE AS oy,
         ((o_orderkey * 53) % 4001) / 100.0::DOUBLE - 20.0053::DOUBLE AS oz,
         ((o_orderkey * 7) % 1301) / 100.0::DOUBLE - 6.5013::DOUBLE AS tx, ((o_orderkey * 11) % 1301) / 100.0::DOUBLE - 6.5017::DOUBLE AS ty,
         ((o_orderkey * 17) % 1301) / 100.0::DOUBLE - 6.5019::DOUBLE AS tz
  FROM orders),
rays AS (
  SELECT ray_id, object_id, ox, oy, oz, (tx - ox) / n AS dx, (ty - oy) / n AS dy, (tz - oz) / n AS dz
  FROM (SELECT *, sqrt((tx - ox) * (tx - ox) + (ty - oy) * (ty - oy) + (tz - oz) * (tz - oz)) AS n FROM aim))"""
SLAB = f"""{RAYS},
inv AS (
  SELECT *, CASE WHEN abs(dx) > 1e-8 THEN 1 / dx ELSE 1e20::DOUBLE END AS vx, CASE WHEN abs(dy) > 1e-8 THEN 1 / dy ELSE 1e20::DOUBLE END AS vy,
         CASE WHEN abs(dz) > 1e-8 THEN 1 / dz ELSE 1e20::DOUBLE END AS vz FROM rays),
slab AS (
  SELECT *, greatest(least((-8 - ox) * vx, (8 - ox) * vx), least((-8 - oy) * vy, (8 - oy) * vy), least((-8 - oz) * vz, (8 - oz) * vz)) AS t_in,
         greatest((-8 - ox) * vx, (8 - ox) * vx) AS fx, greatest((-8 - oy) * vy, (8 - oy) * vy) AS fy, greatest((-8 - oz) * vz, (8 - oz) * vz) AS fz FROM inv),
hits AS (SELECT *, greatest(t_in, 0) AS t0, least(fx, fy, fz) AS t1 FROM slab WHERE t_in <= least(fx, fy, fz) AND least(fx, fy, fz) >= 0)"""
TRACED = f"""{CELLS}, {SLAB},
cuts AS (
  SELECT ray_id, t0 AS t FROM hits UNION SELECT ray_id, t1 FROM hits
  UNION SELECT ray_id, (p - 8 - ox) * vx FROM hits, range(17) g(p) WHERE abs(dx) > 1e-8 AND (p - 8 - ox) * vx > t0 AND (p - 8 - ox) * vx < t1
  UNION SELECT ray_id, (p - 8 - oy) * vy FROM hits, range(17) g(p) WHERE abs(dy) > 1e-8 AND (p - 8 - oy) * vy > t0 AND (p - 8 - oy) * vy < t1
  UNION SELECT ray_id, (p - 8 - oz) * vz FROM hits, range(17) g(p) WHERE abs(dz) > 1e-8 AND (p - 8 - oz) * vz > t0 AND (p - 8 - oz) * vz < t1),
gaps AS (SELECT ray_id, t AS a, lead(t) OVER (PARTITION BY ray_id ORDER BY t) AS z FROM cuts),
parts AS (
  SELECT ray_id, object_id, z - a AS len, floor(oz + dz * (a + z) / 2 + 8)::INT AS i, floor(oy + dy * (a + z) / 2 + 8)::INT AS j, floor(ox + dx * (a + z) / 2 + 8)::INT AS k
  FROM gaps JOIN hits USING (ray_id) WHERE z IS NOT NULL),
sums AS (SELECT ray_id, sum(len) AS len FROM parts JOIN cells USING (object_id, i, j, k) GROUP BY ray_id),
traced AS (
  SELECT ray_id, object_id, coalesce(len, 0)::DOUBLE AS distance, (coalesce(len, 0) > 0)::BIGINT AS hit,
         ray_id % 36 AS view_id, ray_id % 6 AS face_id, ray_id % 3 AS level FROM rays LEFT JOIN sums USING (ray_id))"""
POINTS = """points AS (
  SELECT label::VARCHAR AS object_id, vec_id, t, embedding[t * 3 + 1]::DOUBLE AS x, embedding[t * 3 + 2]::DOUBLE AS y, embedding[t * 3 + 3]::DOUBLE AS z
  FROM embeddings, range(21) g(t) WHERE label IS NOT NULL)"""
BOX = """box AS (
  SELECT object_id, min(x) AS x0, min(y) AS y0, min(z) AS z0, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 16.0::DOUBLE AS pitch
  FROM points GROUP BY object_id)"""
MATRIX = """matrix AS (
  SELECT l_returnflag AS structure, l_partkey % 96 AS out_idx, l_suppkey % 96 AS in_idx,
         sum(CASE WHEN l_linenumber % 2 = 0 THEN -l_quantity ELSE l_quantity END) / 977.0::DOUBLE AS value
  FROM lineitem GROUP BY 1, 2, 3)"""
DIRECTIONS = """flat AS (SELECT event_id, event_type, value, ((event_id * 37) % 2001) / 1000.0::DOUBLE - 1.0 AS z, ((event_id * 91) % 6283) / 1000.0::DOUBLE AS phi FROM events),
dirs AS (SELECT event_id, event_type, value, sqrt(greatest(0.0, 1.0 - z * z)) * cos(phi) AS x, sqrt(greatest(0.0, 1.0 - z * z)) * sin(phi) AS y, z FROM flat)"""
BASIS = [f"{SH_C0}::DOUBLE", f"{SH_C1}::DOUBLE * y", f"{SH_C1}::DOUBLE * z", f"{SH_C1}::DOUBLE * x"]
BASIS += [f"{SH_C2_0}::DOUBLE * x * y", f"{SH_C2_0}::DOUBLE * y * z", f"{SH_C2_1}::DOUBLE * (3.0 * z * z - 1.0)", f"{SH_C2_0}::DOUBLE * x * z", f"{SH_C2_2}::DOUBLE * (x * x - y * y)"]
PLAN = f"""{POINTS},
moved AS (SELECT object_id, vec_id, t, x * 10 + 8 AS x, y * 10 + 8 AS y, z * 10 + 8 AS z FROM points),
s AS (SELECT object_id, vec_id * 10 + t AS src, x AS sx, y AS sy, z AS sz FROM moved WHERE t < 10),
g AS (SELECT object_id, vec_id * 10 + t - 10 AS src, t AS dst, x AS tx, y AS ty, z AS tz FROM moved WHERE t BETWEEN 10 AND 19),
plan AS (
  SELECT s.*, dst, tx, ty, tz, 0.75::DOUBLE AS weight FROM s JOIN g USING (object_id, src)
  UNION ALL SELECT s.*, dst + 100, tx, ty, tz, 0.25::DOUBLE FROM s JOIN g ON s.object_id = g.object_id AND s.src = g.src + 1)"""
TURNS = f"turns AS (SELECT object_id, CASE WHEN {u('rot', 'object_id')} <= 0.5 THEN ({bits('rotk', 'object_id')} % 3 + 1) ELSE 0 END AS turns FROM objects)"
FLIPS = f"flips AS (SELECT object_id, {u('flipi', 'object_id')} < 0.5 AS fi, {u('flipj', 'object_id')} < 0.5 AS fj, {u('flipk', 'object_id')} < 0.5 AS fk FROM objects)"
DIGEST = "count(*) AS n, sum(i * 10000 + j * 100 + k)::BIGINT AS checksum"
BATCHES = f"keyed AS (SELECT object_id, row_number() OVER (ORDER BY {bits('42', 'object_id')}, object_id) - 1 AS position FROM objects), batched AS (SELECT object_id, position, position // 16 AS batch FROM keyed)"
OFFSETS = "offs AS (SELECT a::INT AS di, b::INT AS dj, c::INT AS dk, abs(a) + abs(b) + abs(c) AS reach FROM range(-1, 2) x(a), range(-1, 2) y(b), range(-1, 2) z(c))"
NODES = "nodes AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY i, j, k) - 1 AS id FROM cells)"


def _edges(reach: int) -> str:
    return (
        f"WITH {CELLS}, {OFFSETS} SELECT c.object_id, count(d.i) AS num_edges FROM cells c JOIN offs ON reach BETWEEN 1 AND {reach} "
        "LEFT JOIN cells d ON d.object_id = c.object_id AND d.i = c.i + di AND d.j = c.j + dj AND d.k = c.k + dk GROUP BY c.object_id"
    )


def _statistics(by: str) -> str:
    d = "CASE WHEN hit = 1 THEN distance END"
    return (
        f"WITH {TRACED} SELECT {by}, count(*) AS n_rays, sum(hit)::BIGINT AS n_hits, {r(f'min({d})')} AS min_distance, {r(f'max({d})')} AS max_distance, "
        f"{r(f'avg({d})')} AS mean_distance, {r('100.0::DOUBLE * sum(hit) / count(*)')} AS hit_rate FROM traced GROUP BY {by}"
    )


def _rounded(*cols: str) -> str:
    return ", ".join(f"{r(c)} AS {c}" for c in cols)


SIZES = "sizes AS (SELECT object_id, coalesce(n, 0) AS num_nodes FROM objects LEFT JOIN (SELECT object_id, count(*) AS n FROM cells GROUP BY object_id) USING (object_id))"
DIFF_T = "(distance / sqrt(3 * (16.0::DOUBLE / pow(2.0, level)) * (16.0::DOUBLE / pow(2.0, level))))"
HG = f"""g AS (SELECT event_id, {u('u', 'event_id')} AS u, {u('v', 'event_id')} AS v FROM events),
c AS (SELECT event_id, v, greatest(-1.0, least(1.0, (1 + 0.6::DOUBLE * 0.6 - ((1 - 0.6::DOUBLE * 0.6) / (1 - 0.6::DOUBLE + 2 * 0.6 * u)) * ((1 - 0.6::DOUBLE * 0.6) / (1 - 0.6::DOUBLE + 2 * 0.6 * u))) / (2 * 0.6::DOUBLE))) AS z FROM g)"""
EXITS = """exits AS (
  SELECT ray_id, CASE WHEN fx <= fy AND fx <= fz THEN CASE WHEN dx > 0 THEN 0 ELSE 1 END WHEN fy <= fz THEN CASE WHEN dy > 0 THEN 2 ELSE 3 END
         ELSE CASE WHEN dz > 0 THEN 4 ELSE 5 END END AS exit_face, ox + t1 * dx AS ex, oy + t1 * dy AS ey, oz + t1 * dz AS ez FROM hits)"""
CELL8 = "least(7, floor(greatest(0.0, least(1 - 1e-6, ({c} + 8) / 16)) * 8))"
ERRORS = """errors AS (
  SELECT structure, in_idx, exit_patch, sum(w * w) AS weight_sq_sum, count(*) AS sample_count, sum(w) * sum(w) * 0.9e-4::DOUBLE AS sh_energy
  FROM (SELECT l_returnflag AS structure, l_suppkey % 96 AS in_idx, l_partkey % 24 AS exit_patch, l_discount + 0.01::DOUBLE AS w FROM lineitem) GROUP BY 1, 2, 3),
judged AS (
  SELECT *, CASE WHEN sample_count >= 10 AND weight_sq_sum / sample_count > 1e-10
    THEN 1 - greatest(0.0, least(1.0, sh_energy * 100.0::DOUBLE * 100.0 / sample_count / (weight_sq_sum / sample_count))) END AS error FROM errors)"""

ORACLE_SQL: dict[str, str] = {
    "voxelize_points": f"""WITH {POINTS}, {BOX} SELECT DISTINCT object_id, least(15, floor((x - x0) / pitch))::BIGINT AS i, least(15, floor((y - y0) / pitch))::BIGINT AS j,
        least(15, floor((z - z0) / pitch))::BIGINT AS k FROM points JOIN box USING (object_id)""",
    "voxel_pitch": f"WITH {POINTS}, {BOX} SELECT object_id, {r('pitch')} AS pitch FROM box",
    "voxel_occupancy": f"""WITH {CELLS}, {OBJECTS}, {SIZES} SELECT object_id, num_nodes AS num_occupied, {r('num_nodes / 4096.0::DOUBLE')} AS occupancy_ratio FROM sizes""",
    "grid_pad_crop": f"""WITH {CELLS}, small AS (SELECT object_id, i - 2 AS i, j - 2 AS j, k - 2 AS k FROM cells WHERE i BETWEEN 2 AND 12 AND j BETWEEN 2 AND 12 AND k BETWEEN 2 AND 12)
        SELECT object_id, {DIGEST} FROM small GROUP BY object_id""",
    "upsample_diff": f"""WITH {CELLS}, up AS (SELECT DISTINCT object_id, i, j, k, true AS l FROM (SELECT c.object_id, 2 * c.i + a AS i, 2 * c.j + b AS j, 2 * c.k + d AS k FROM cells c, range(2) x(a), range(2) y(b), range(2) z(d)
          WHERE c.i < 8 AND c.j < 8 AND c.k < 8)),
        m AS (SELECT object_id, l, r FROM up FULL JOIN (SELECT *, true AS r FROM cells) USING (object_id, i, j, k))
        SELECT object_id, count(*) FILTER (l IS NULL OR r IS NULL) AS n_xor, count(r) AS n_right,
               {r('CASE WHEN count(r) > 0 THEN 100.0::DOUBLE * count(*) FILTER (l IS NULL OR r IS NULL) / count(r) END')} AS percent FROM m GROUP BY object_id""",
    "silhouettes": f"WITH {CELLS} SELECT object_id, count(DISTINCT i * 16 + j) AS area FROM cells GROUP BY object_id",
    "middle_slice": f"WITH {CELLS} SELECT object_id, count(*) AS n FROM cells WHERE i = 8 GROUP BY object_id",
    "point_clouds": f"WITH {CELLS} SELECT object_id, count(*) AS n, 1.0::DOUBLE AS total, {r('avg(i)')} AS mean_x, {r('avg(j)')} AS mean_y, {r('avg(k)')} AS mean_z FROM cells GROUP BY object_id",
    "octree_map": f"""WITH {TREE} SELECT object_id, level::BIGINT AS level, octant_index::BIGINT AS octant_index, position_x::BIGINT AS position_x, position_y::BIGINT AS position_y,
        position_z::BIGINT AS position_z, global_position_x::BIGINT AS global_position_x, global_position_y::BIGINT AS global_position_y, global_position_z::BIGINT AS global_position_z,
        hash, is_empty, is_full FROM tree""",
    "octree_lossless": f"WITH {CELLS}, {LEVELS} SELECT level::BIGINT AS level, count(*) AS n_cells, 0::BIGINT AS n_different FROM cells, levels GROUP BY level",
    "octree_children": f"""WITH {TREE} SELECT p.object_id, p.level::BIGINT AS level, p.hash AS parent_hash, count(*) AS n_children, count(*) FILTER (c.is_empty) AS n_empty
        FROM tree p JOIN tree c ON c.object_id = p.object_id AND c.level = p.level + 1 AND c.global_position_x BETWEEN p.global_position_x AND p.global_position_x + p.size - 1
          AND c.global_position_y BETWEEN p.global_position_y AND p.global_position_y + p.size - 1 AND c.global_position_z BETWEEN p.global_position_z AND p.global_position_z + p.size - 1
        GROUP BY p.object_id, p.level, p.hash""",
    "subvolume_hash": f"WITH {FILLED} SELECT object_id, level::BIGINT AS level, bi::BIGINT AS bi, bj::BIGINT AS bj, bk::BIGINT AS bk, h AS hash FROM filled",
    "registry_table": f"WITH {TREE} SELECT level::BIGINT AS level, hash, count(*) AS count, bool_or(is_empty) AS is_empty, min(size)::BIGINT AS resolution, min(object_id) AS first_object FROM tree GROUP BY level, hash",
    "registry_level_stats": f"""WITH {TREE} SELECT level::BIGINT AS level, count(DISTINCT hash) AS "unique", count(*) AS total, count(DISTINCT CASE WHEN is_empty THEN hash END) AS empty,
        {r('count(DISTINCT hash)::DOUBLE / count(*)')} AS deduplication_ratio FROM tree GROUP BY level""",
    "registry_overall": f"""WITH {TREE}, reg AS (SELECT level, hash, count(*) AS n FROM tree GROUP BY level, hash)
        SELECT level::BIGINT AS level, count(*) AS unique_subvolumes, sum(n)::BIGINT AS total_subvolumes, {r('count(*)::DOUBLE / sum(n)')} AS deduplication_ratio FROM reg GROUP BY ROLLUP (level)""",
    "registry_new_per_object": f"""WITH {TREE}, m AS (SELECT object_id, row_number() OVER (PARTITION BY level, hash ORDER BY object_id) AS rn FROM tree)
        SELECT object_id, count(*) FILTER (rn = 1) AS new_unique_count FROM m GROUP BY object_id""",
    "most_common_topk": f"""WITH {TREE}, c AS (SELECT level, hash, count(*) AS count FROM tree GROUP BY level, hash)
        SELECT level::BIGINT AS level, hash, count, row_number() OVER (PARTITION BY level ORDER BY count DESC, hash) AS rank FROM c QUALIFY rank <= 5""",
    "hash_frequency": f"WITH {TREE} SELECT hash, count(*) AS count FROM tree GROUP BY hash",
    "resume_missing": f"WITH {TREE} SELECT DISTINCT level::BIGINT AS level, hash FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree x WHERE NOT x.is_full AND x.level = t.level AND x.hash = t.hash)",
    "object_complexity": f"WITH {TREE} SELECT object_id, count(DISTINCT hash) AS unique_hashes FROM tree GROUP BY object_id",
    "complexity_extremes": f"""WITH {TREE}, c AS (SELECT object_id, count(DISTINCT hash) AS unique_hashes FROM tree GROUP BY object_id)
        (SELECT object_id, unique_hashes, 'most' AS "end" FROM c ORDER BY unique_hashes DESC, object_id LIMIT 10) UNION ALL (SELECT object_id, unique_hashes, 'least' FROM c ORDER BY unique_hashes, object_id LIMIT 10)""",
    "summary_statistics": f"""WITH {TREE} SELECT level::BIGINT AS level, count(*) AS records, count(*) FILTER (is_empty) AS empty_count, count(DISTINCT hash) AS unique_hashes,
        count(DISTINCT object_id) AS num_objects FROM tree GROUP BY ROLLUP (level)""",
    "empty_ratio": f"WITH {TREE} SELECT level::BIGINT AS level, count(*) AS total, count(*) FILTER (is_empty) AS empty, {r('100.0::DOUBLE * count(*) FILTER (is_empty) / count(*)')} AS empty_pct FROM tree GROUP BY level",
    "octant_distribution": f"WITH {TREE} SELECT level::BIGINT AS level, octant_index::BIGINT AS octant_index, count(*) AS count, count(*) FILTER (NOT is_empty) AS occupied FROM tree GROUP BY level, octant_index",
    "level_hash_frequency": f"WITH {TREE} SELECT level::BIGINT AS level, hash, count(*) AS count FROM tree GROUP BY level, hash",
    "cooccurrence_pairs": f"""WITH {TREE}, own AS (SELECT DISTINCT object_id, hash FROM tree WHERE level = 1 AND NOT is_empty AND NOT is_full)
        SELECT a.hash AS hash_a, b.hash AS hash_b, count(*) AS objects FROM own a JOIN own b ON a.object_id = b.object_id AND a.hash < b.hash GROUP BY a.hash, b.hash""",
    "common_contents": f"""WITH {TREE} SELECT hash, count(DISTINCT object_id) AS objects FROM tree WHERE level = 1 AND NOT is_empty AND NOT is_full GROUP BY hash HAVING count(DISTINCT object_id) > 1000""",
    "thing_first_wins": "SELECT user_id AS thing_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "dedup_documents": "SELECT lang AS level, count(*) AS total, count(DISTINCT sha256(text)) AS \"unique\", count(DISTINCT source) AS objects FROM documents GROUP BY lang",
    "split_assignment": f"WITH {OBJECTS}, {SPLITS} SELECT object_id, split FROM splits",
    "split_object_counts": f"WITH {OBJECTS}, {SPLITS} SELECT s.split, count(splits.split) AS n_objects FROM (VALUES ('train'), ('val'), ('test')) s(split) LEFT JOIN splits USING (split) GROUP BY s.split",
    "hash_split_distribution": f"WITH {USAGE} SELECT {BUCKET.format(t='trivial')} AS bucket, count(*) AS n_hashes FROM contents GROUP BY 1",
    "hash_split_distribution_full": f"WITH {USAGE} SELECT {BUCKET.format(t='uniform')} AS bucket, count(*) AS n_hashes FROM contents GROUP BY 1",
    "object_purity": f"""WITH {USAGE}, j AS (SELECT u.*, c.trivial, c.objects, c.mask <> CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 4 END AS leaks FROM usage u JOIN contents c USING (hash)),
        p AS (SELECT object_id, split, sum(n)::BIGINT AS total_subvolumes, coalesce(sum(n) FILTER (trivial), 0)::BIGINT AS trivial, coalesce(sum(n) FILTER (NOT trivial), 0)::BIGINT AS nontrivial,
          coalesce(sum(n) FILTER (NOT trivial AND objects = 1), 0)::BIGINT AS pure, coalesce(sum(n) FILTER (NOT trivial AND objects > 1 AND NOT leaks), 0)::BIGINT AS shared_same_split,
          coalesce(sum(n) FILTER (NOT trivial AND leaks), 0)::BIGINT AS shared_other_split FROM j GROUP BY object_id, split)
        SELECT *, {r('CASE WHEN nontrivial > 0 THEN 100.0::DOUBLE * pure / nontrivial ELSE 0 END')} AS purity_percentage,
          {r('CASE WHEN nontrivial > 0 THEN 100.0::DOUBLE * shared_other_split / nontrivial ELSE 0 END')} AS leakage_percentage FROM p""",
    "splits_using_hash": f"WITH {USAGE} SELECT hash, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM usage GROUP BY hash",
    "objects_using_hash": f"WITH {USAGE} SELECT DISTINCT hash, object_id, split FROM usage",
    "nontrivial_hashes_by_split": f"WITH {USAGE} SELECT DISTINCT split, hash FROM usage WHERE hash NOT IN (SELECT hash FROM contents WHERE trivial)",
    "subvolume_split_info": f"WITH {USAGE} SELECT hash, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(*) AS n_objects, bool_or(is_empty) AS trivial FROM usage GROUP BY hash",
    "sample_collection": f"""WITH {TREE}, {SPLITS} SELECT 0::BIGINT AS level, 'object_' || object_id AS hash FROM splits WHERE split = 'val'
        UNION ALL SELECT DISTINCT level::BIGINT, hash FROM tree JOIN splits USING (object_id) WHERE split = 'val' AND NOT is_empty""",
    "level_distribution": f"""WITH {TREE}, {SPLITS}, s AS (SELECT 0 AS level, object_id AS hash FROM splits WHERE split = 'train'
        UNION ALL SELECT DISTINCT level, hash FROM tree JOIN splits USING (object_id) WHERE split = 'train' AND NOT is_empty) SELECT level::BIGINT AS level, count(*) AS count FROM s GROUP BY level""",
    "chunk_index": f"""WITH {RAYS}, c AS (SELECT object_id, count(*) AS n FROM rays GROUP BY object_id)
        SELECT object_id, x AS chunk_idx, x * 4 AS chunk_start, least(x * 4 + 4, n) AS chunk_end, least(x * 4 + 4, n) - x * 4 AS num_rays FROM c, LATERAL (SELECT unnest(range((n + 3) // 4)) AS x)""",
    "chunk_slice": f"WITH {RAYS}, n AS (SELECT object_id, ray_id, row_number() OVER (PARTITION BY object_id ORDER BY ray_id) - 1 AS ray_idx FROM rays) SELECT * FROM n WHERE ray_idx BETWEEN 4 AND 7",
    "batch_assign": f"WITH {OBJECTS}, {BATCHES} SELECT object_id, position, batch FROM batched",
    "collate_offsets": f"""WITH {CELLS}, {OBJECTS}, {BATCHES}, {SIZES} SELECT batch, position, object_id, num_nodes,
        coalesce(sum(num_nodes) OVER (PARTITION BY batch ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS node_offset, position % 16 AS voxel_idx,
        sum(num_nodes) OVER (PARTITION BY batch)::BIGINT AS batch_nodes, max(num_nodes) OVER (PARTITION BY batch) AS largest FROM batched JOIN sizes USING (object_id)""",
    "sparse_coo": f"WITH {CELLS} SELECT object_id, count(*) AS n, count(*)::DOUBLE AS total, sum(k)::BIGINT AS sum_x, sum(j)::BIGINT AS sum_y, sum(i)::BIGINT AS sum_z FROM cells GROUP BY object_id",
    "sparse_edges_6": f"""WITH {CELLS}, {NODES}, {OFFSETS} SELECT c.object_id, count(*) AS n_edges, sum(c.id * 4096 + d.id)::BIGINT AS checksum FROM nodes c JOIN offs ON reach = 1
        JOIN nodes d ON d.object_id = c.object_id AND d.i = c.i + di AND d.j = c.j + dj AND d.k = c.k + dk GROUP BY c.object_id""",
    "sparse_edges_18": _edges(2),
    "sparse_edges_26": _edges(3),
    "sparse_stats": f"""WITH {CELLS}, {OBJECTS}, {OFFSETS}, {SIZES}, e AS (SELECT c.object_id, count(*) AS num_edges FROM cells c JOIN offs ON reach = 1
          JOIN cells d ON d.object_id = c.object_id AND d.i = c.i + di AND d.j = c.j + dj AND d.k = c.k + dk GROUP BY c.object_id)
        SELECT object_id, num_nodes AS num_occupied, 4096::BIGINT AS total_voxels, {r('num_nodes / 4096.0::DOUBLE')} AS occupancy, {r('1.0::DOUBLE - num_nodes / 4096.0::DOUBLE')} AS sparsity,
          {r('CASE WHEN num_nodes > 0 THEN 4096.0::DOUBLE / num_nodes END')} AS compression_ratio, coalesce(num_edges, 0) AS num_edges,
          {r('CASE WHEN num_nodes > 0 THEN coalesce(num_edges, 0)::DOUBLE / num_nodes ELSE 0 END')} AS avg_degree FROM sizes LEFT JOIN e USING (object_id)""",
    "coo_to_dense": f"WITH {CELLS} SELECT object_id, ((max(i) + 1) * (max(j) + 1) * (max(k) + 1))::BIGINT AS n_cells, count(*)::DOUBLE AS total FROM cells GROUP BY object_id",
    "rotate90": f"""WITH {CELLS}, {OBJECTS}, {TURNS}, t AS (SELECT object_id, i, CASE turns WHEN 1 THEN 15 - k WHEN 2 THEN 15 - j WHEN 3 THEN k ELSE j END AS j,
        CASE turns WHEN 1 THEN j WHEN 2 THEN 15 - k WHEN 3 THEN 15 - j ELSE k END AS k FROM cells JOIN turns USING (object_id)) SELECT object_id, {DIGEST} FROM t GROUP BY object_id""",
    "rotate90_rays": f"""WITH {OBJECTS}, {RAYS}, {TURNS}, t AS (SELECT ray_id, turns, CASE turns WHEN 1 THEN -oy WHEN 2 THEN -ox WHEN 3 THEN oy ELSE ox END AS ox,
        CASE turns WHEN 1 THEN ox WHEN 2 THEN -oy WHEN 3 THEN -ox ELSE oy END AS oy, CASE turns WHEN 1 THEN -dy WHEN 2 THEN -dx WHEN 3 THEN dy ELSE dx END AS dx,
        CASE turns WHEN 1 THEN dx WHEN 2 THEN -dy WHEN 3 THEN -dx ELSE dy END AS dy FROM rays JOIN turns USING (object_id)) SELECT ray_id, turns::BIGINT AS turns, {_rounded('ox', 'oy', 'dx', 'dy')} FROM t""",
    "flip": f"""WITH {CELLS}, {OBJECTS}, {FLIPS}, t AS (SELECT object_id, CASE WHEN fi THEN 15 - i ELSE i END AS i, CASE WHEN fj THEN 15 - j ELSE j END AS j, CASE WHEN fk THEN 15 - k ELSE k END AS k
        FROM cells JOIN flips USING (object_id)) SELECT object_id, {DIGEST} FROM t GROUP BY object_id""",
    "flip_rays": f"""WITH {OBJECTS}, {RAYS}, {FLIPS}, t AS (SELECT ray_id, CASE WHEN fk THEN -ox ELSE ox END AS ox, CASE WHEN fj THEN -oy ELSE oy END AS oy, CASE WHEN fi THEN -oz ELSE oz END AS oz,
        CASE WHEN fk THEN -dx ELSE dx END AS dx, CASE WHEN fj THEN -dy ELSE dy END AS dy, CASE WHEN fi THEN -dz ELSE dz END AS dz FROM rays JOIN flips USING (object_id))
        SELECT ray_id, {_rounded('ox', 'oy', 'oz', 'dx', 'dy', 'dz')} FROM t""",
    "normalize_origins": f"WITH {RAYS} SELECT ray_id, {r('ox / 5.6::DOUBLE')} AS ox, {r('oy / 5.6::DOUBLE')} AS oy, {r('oz / 5.6::DOUBLE')} AS oz FROM rays",
    "ray_subsample": f"WITH {RAYS} SELECT object_id, ray_id FROM rays QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY {bits('sub', 'ray_id')}, ray_id) <= 3",
    "occupancy_jitter": f"""WITH {CELLS}, {OBJECTS}, grid AS (SELECT object_id, a.i, b.j, c.k FROM objects, range(16) a(i), range(16) b(j), range(16) c(k)),
        m AS (SELECT g.*, (c.i IS NOT NULL) <> ({u('jit', 'g.object_id', 'g.i', 'g.j', 'g.k')} < 0.01) AS lit FROM grid g LEFT JOIN cells c ON c.object_id = g.object_id AND c.i = g.i AND c.j = g.j AND c.k = g.k)
        SELECT object_id, {DIGEST} FROM m WHERE lit GROUP BY object_id""",
    "adaptive_samples": "SELECT level::BIGINT AS level, greatest(300, 1000 // (1 << level))::BIGINT AS samples FROM (VALUES (1), (2)) l(level)",
    "trace_dda": f"WITH {TRACED} SELECT ray_id, object_id, {r('distance')} AS distance, hit FROM traced",
    "trace_dda_cells": f"WITH {TRACED} SELECT ray_id, object_id, {r('distance')} AS distance, hit FROM traced",
    "trace_exit": f"WITH {SLAB}, {EXITS} SELECT ray_id, exit_face::BIGINT AS exit_face, {_rounded('ex', 'ey', 'ez')} FROM exits",
    "ray_stats_view": _statistics("view_id"),
    "ray_stats_face": _statistics("face_id"),
    "ray_stats_level": _statistics("level"),
    "distance_normalize": f"WITH {TRACED} SELECT ray_id, {r(DIFF_T)} AS distance FROM traced",
    "occlusion_field": f"WITH {TRACED} SELECT object_id, {r('avg(distance)')} AS occlusion, count(*) AS n_rays FROM traced GROUP BY object_id",
    "distance_mse": f"WITH {TRACED} SELECT level, {r(f'avg(({DIFF_T} - 0.1) * ({DIFF_T} - 0.1))')} AS mse FROM traced GROUP BY level",
    "patch_index_decode": """SELECT DISTINCT l_partkey % 384 AS patch_id, l_partkey % 384 // 64 AS face_id, l_partkey % 384 % 64 // 8 AS v, l_partkey % 384 % 8 AS u, xor(l_partkey % 384 // 64, 1) AS opposite_face FROM lineitem""",
    "exit_patch": f"""WITH {SLAB}, {EXITS} SELECT ray_id, exit_face::BIGINT AS exit_face,
        (exit_face * 64 + CASE exit_face // 2 WHEN 2 THEN {CELL8.format(c='ey')} ELSE {CELL8.format(c='ez')} END * 8 + CASE exit_face // 2 WHEN 0 THEN {CELL8.format(c='ey')} ELSE {CELL8.format(c='ex')} END)::BIGINT AS exit_patch
        FROM exits""",
    "sh_basis": f"WITH {DIRECTIONS} SELECT event_id, {', '.join(f'{r(b)} AS y{i}' for i, b in enumerate(BASIS))} FROM dirs",
    "sh_project": f"""WITH {DIRECTIONS}, l AS (SELECT event_type, value, unnest([{', '.join(BASIS)}]) AS y, unnest(range(9)) AS sh_idx FROM dirs)
        SELECT event_type, sh_idx, {r('4 * pi() * sum(value * y) / count(*)')} AS coefficient FROM l GROUP BY event_type, sh_idx""",
    "sh_reconstruct": f"""WITH {DIRECTIONS}, l AS (SELECT event_id, event_type, value, unnest([{', '.join(BASIS)}]) AS y, unnest(range(9)) AS sh_idx FROM dirs),
        c AS (SELECT event_type, sh_idx, 4 * pi() * sum(value * y) / count(*) AS coefficient FROM l GROUP BY event_type, sh_idx)
        SELECT event_id, {r('sum(y * coefficient)')} AS value FROM l JOIN c USING (event_type, sh_idx) GROUP BY event_id""",
    "sh_inner_products": f"""WITH {DIRECTIONS}, l AS (SELECT event_id, unnest([{', '.join(BASIS)}]) AS y, unnest(range(9)) AS i FROM dirs)
        SELECT p.i AS a, q.i AS b, {r('4 * pi() * sum(p.y * q.y) / count(*)')} AS product FROM l p JOIN l q USING (event_id) GROUP BY p.i, q.i""",
    "hg_sample": f"""WITH {HG} SELECT event_id, {r('sqrt(greatest(0.0, 1 - z * z)) * cos(v * 2 * pi())')} AS x, {r('sqrt(greatest(0.0, 1 - z * z)) * sin(v * 2 * pi())')} AS y, {r('z')} AS z FROM c""",
    "matrix_stats": f"""WITH {MATRIX}, names AS (SELECT DISTINCT structure FROM matrix), dense AS (SELECT structure, coalesce(value, 0) AS v FROM names CROSS JOIN range(96) a(out_idx) CROSS JOIN range(96) b(in_idx)
          LEFT JOIN matrix USING (structure, out_idx, in_idx))
        SELECT structure, {r('min(v)')} AS min, {r('max(v)')} AS max, {r('avg(v)')} AS mean, {r('stddev_pop(v)')} AS std, {r('avg((v <> 0)::INT)')} AS nnz_ratio FROM dense GROUP BY structure""",
    "matrix_column_sums": f"WITH {MATRIX} SELECT structure, in_idx, {r('sum(abs(value))')} AS column_sum FROM matrix GROUP BY structure, in_idx",
    "matrix_column_statistics": f"""WITH {MATRIX}, c AS (SELECT structure, in_idx, sum(abs(value)) AS s FROM matrix GROUP BY structure, in_idx)
        SELECT structure, {r('CASE WHEN count(*) < 96 THEN 0 ELSE min(s) END')} AS min, {r('max(s)')} AS max, {r('sum(s) / 96')} AS mean FROM c GROUP BY structure""",
    "matrix_row_sums": f"WITH {MATRIX} SELECT structure, out_idx, {r('sum(abs(value))')} AS row_sum FROM matrix GROUP BY structure, out_idx",
    "matrix_symmetry": f"""WITH {MATRIX} SELECT coalesce(a.structure, b.structure) AS structure, {r('max(abs(coalesce(a.value, 0) - coalesce(b.value, 0)))')} AS symmetry_error
        FROM matrix a FULL JOIN matrix b ON a.structure = b.structure AND a.out_idx = b.in_idx AND a.in_idx = b.out_idx GROUP BY 1""",
    "matrix_sparsity": f"""WITH {MATRIX}, top AS (SELECT structure, max(abs(value)) * 1e-6 AS m FROM matrix GROUP BY structure)
        SELECT structure, {r('count(*) FILTER (abs(value) > m) / 9216.0::DOUBLE')} AS density FROM matrix JOIN top USING (structure) GROUP BY structure""",
    "face_energy": f"WITH {MATRIX} SELECT structure, in_idx // 16 AS in_face, {r('sum(abs(value))')} AS energy FROM matrix GROUP BY structure, in_idx // 16",
    "face_transport": f"""WITH {MATRIX}, f AS (SELECT structure, out_idx // 16 AS out_face, in_idx // 16 AS in_face, sum(abs(value)) AS e FROM matrix GROUP BY 1, 2, 3)
        SELECT structure, out_face, in_face, {r('e')} AS energy, {r('CASE WHEN sum(e) OVER w > 0 THEN e / sum(e) OVER w ELSE 0 END')} AS share FROM f WINDOW w AS (PARTITION BY structure, in_face)""",
    "sh_coupling": f"WITH {MATRIX} SELECT structure, out_idx % 4 AS out_sh, in_idx % 4 AS in_sh, {r('sum(abs(value))')} AS energy FROM matrix GROUP BY 1, 2, 3",
    "matrix_diff": f"""WITH {MATRIX}, names AS (SELECT DISTINCT structure FROM matrix), dense AS (SELECT structure, out_idx, in_idx, coalesce(value, 0) AS v FROM names CROSS JOIN range(96) a(out_idx) CROSS JOIN range(96) b(in_idx)
          LEFT JOIN matrix USING (structure, out_idx, in_idx))
        SELECT a.structure AS a, b.structure AS b, {r('max(abs(a.v - b.v))')} AS max_abs, {r('avg(abs(a.v - b.v))')} AS mean_abs, {r('sqrt(sum((a.v - b.v) * (a.v - b.v)))')} AS frobenius,
          {r('sqrt(sum((a.v - b.v) * (a.v - b.v))) / sqrt(sum(a.v * a.v))')} AS relative, {r('corr(a.v, b.v)')} AS correlation
        FROM dense a JOIN dense b ON a.out_idx = b.out_idx AND a.in_idx = b.in_idx AND a.structure < b.structure GROUP BY 1, 2""",
    "view_radiance": f"WITH {MATRIX} SELECT structure, out_idx // 4 AS patch_id, {r('sum(value)')} AS radiance FROM matrix WHERE out_idx % 4 = 0 AND in_idx % 4 = 0 AND in_idx // 16 = 1 GROUP BY 1, 2",
    "mean_radiance": f"WITH {MATRIX} SELECT structure, out_idx // 4 AS patch_id, {r('sum(value) / 6')} AS radiance FROM matrix WHERE out_idx % 4 = 0 AND in_idx < 24 GROUP BY 1, 2",
    "boundary_radiance": f"""WITH {MATRIX}, p AS (SELECT structure, out_idx, sum(value * (1.0::DOUBLE / (in_idx + 1))) AS p FROM matrix GROUP BY 1, 2)
        SELECT structure, out_idx // 4 AS patch_id, {r('sqrt(sum(p * p))')} AS radiance FROM p GROUP BY 1, 2""",
    "exit_energy": f"WITH {MATRIX} SELECT structure, in_idx, out_idx // 4 AS exit_patch, {r('sum(value * value)')} AS sh_energy FROM matrix GROUP BY 1, 2, 3",
    "matrix_histogram": f"""WITH {MATRIX} SELECT structure, greatest(0, least(31, floor((log10(abs(value)) + 4) * 5) + 1))::BIGINT AS bin, count(*) AS n, count(*) FILTER (out_idx = in_idx) AS n_diagonal
        FROM matrix WHERE value <> 0 GROUP BY 1, 2""",
    "sh_error_summary": f"""WITH {ERRORS} SELECT structure, count(*) AS pairs, count(*) FILTER (sample_count >= 10) AS well_sampled, min(sample_count) AS min_count, {r('quantile_cont(sample_count, 0.5)')} AS median_count,
        max(sample_count) AS max_count, {r('avg(error)')} AS mean_error, {r('quantile_cont(error, 0.5)')} AS median_error, {r('quantile_cont(error, 0.9)')} AS p90, {r('quantile_cont(error, 0.95)')} AS p95,
        {r('quantile_cont(error, 0.99)')} AS p99, {r('max(error)')} AS max_error FROM judged GROUP BY structure""",
    "barycentric_interp": f"""WITH {PLAN} SELECT object_id, src, {', '.join(r(f'0.75::DOUBLE * any_value(s{a}) + 0.25::DOUBLE * (sum(weight * t{a}) / sum(weight))') + f' AS {a}' for a in 'xyz')} FROM plan GROUP BY object_id, src""",
    "split_interp": f"""WITH {PLAN}, sh AS (SELECT *, weight / (sum(weight) OVER (PARTITION BY object_id, src) + 1e-10) AS share FROM plan)
        SELECT object_id, src, dst, {', '.join(r(f'0.5::DOUBLE * s{a} + 0.5::DOUBLE * t{a}') + f' AS {a}' for a in 'xyz')} FROM sh WHERE share > 0.1""",
    "transport_cost": f"""WITH {PLAN} SELECT object_id, {r('sum(weight * sqrt((sx - tx) * (sx - tx) + (sy - ty) * (sy - ty) + (sz - tz) * (sz - tz)))')} AS cost, 1.0::DOUBLE AS density FROM plan GROUP BY object_id""",
    "raymap_splat": f"""WITH {PLAN}, m AS (SELECT object_id, n - 1 AS step, {', '.join(f'trunc(s{a} + (t{a} - s{a}) * (n / 5.0::DOUBLE))::BIGINT AS {c}' for a, c in zip('xyz', 'ijk', strict=True))}, weight FROM plan, range(1, 5) g(n))
        SELECT object_id, step, i, j, k, {r('sum(weight)')} AS value FROM m GROUP BY object_id, step, i, j, k""",
    "gaussian_splat": f"""WITH {POINTS}, p AS (SELECT object_id, x * 12 + 8 AS x, y * 12 + 8 AS y, z * 12 + 8 AS z FROM points WHERE t < 20),
        c AS (SELECT *, greatest(0, least(15, round_even(x, 0)))::INT AS i, greatest(0, least(15, round_even(y, 0)))::INT AS j, greatest(0, least(15, round_even(z, 0)))::INT AS k FROM p),
        n AS (SELECT object_id, c.i + a AS i, c.j + b AS j, c.k + d AS k, exp(-((x - (c.i + a)) * (x - (c.i + a)) + (y - (c.j + b)) * (y - (c.j + b)) + (z - (c.k + d)) * (z - (c.k + d))) / (2 * 0.7::DOUBLE * 0.7)) AS w
          FROM c, range(-3, 4) e(a), range(-3, 4) f(b), range(-3, 4) g(d) WHERE c.i + a BETWEEN 0 AND 15 AND c.j + b BETWEEN 0 AND 15 AND c.k + d BETWEEN 0 AND 15),
        s AS (SELECT object_id, i, j, k, sum(w) AS w FROM n GROUP BY object_id, i, j, k)
        SELECT object_id, i::BIGINT AS i, j::BIGINT AS j, k::BIGINT AS k FROM s QUALIFY w / max(w) OVER (PARTITION BY object_id) > 0.25""",
    "morph_stats": f"""WITH {PLAN}, m AS (SELECT DISTINCT object_id, n - 1 AS step, {', '.join(f'trunc(s{a} + (t{a} - s{a}) * (n / 5.0::DOUBLE))::BIGINT AS {c}' for a, c in zip('xyz', 'ijk', strict=True))} FROM plan, range(1, 5) g(n)),
        c AS (SELECT object_id, step, count(*) AS num_voxels FROM m GROUP BY object_id, step)
        SELECT object_id, step, num_voxels, {r('num_voxels / 4096.0::DOUBLE')} AS occupancy, num_voxels - lag(num_voxels) OVER (PARTITION BY object_id ORDER BY step) AS delta FROM c""",
}
ORACLE_SQL["subvolume_hash_lists"] = ORACLE_SQL["subvolume_hash"]

from cairn.plans import more_oracles, spatial_oracles  # noqa: E402, F401  add their queries to these
