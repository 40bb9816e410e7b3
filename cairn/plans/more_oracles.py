"""SQL twins of the further queries."""

from __future__ import annotations

from cairn.plans.oracles import CELLS, DIRECTIONS, MATRIX, OBJECTS, ORACLE_SQL, RAYS, SPLITS, TRACED, TREE, TURNS, USAGE, bits, r, u

COUNTS = f"{CELLS}, {OBJECTS}, counts AS (SELECT object_id, coalesce(n, 0) AS n FROM objects LEFT JOIN (SELECT object_id, count(*) AS n FROM cells GROUP BY object_id) USING (object_id))"
BATCHED = f"""{COUNTS},
keyed AS (SELECT object_id, row_number() OVER (ORDER BY {bits('42', 'object_id')}, object_id) - 1 AS position FROM objects),
batched AS (
  SELECT object_id, position, position // 16 AS batch, position % 16 AS voxel_idx,
         coalesce(sum(n) OVER (PARTITION BY position // 16 ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS node_offset
  FROM keyed JOIN counts USING (object_id))"""
FLIPS = "flips AS (SELECT object_id, " + ", ".join(f"{u(f'flip{a}', 'object_id')} < 0.5 AS f{a}" for a in "ijk") + " FROM objects)"
STEPS = ORACLE_SQL["raymap_splat"]
UV = f"uv AS (SELECT event_id, {u('u', 'event_id')} AS u, {u('v', 'event_id')} AS v FROM events)"
LOCAL = ["sqrt(1 - v) * cos(u * 2 * pi())", "sqrt(1 - v) * sin(u * 2 * pi())", "sqrt(v)"]
#: Harmonics of degrees 3 and 4 with their constants from closed forms.
HIGH = [
    "sqrt(35 / (32 * pi())) * y * (3 * x * x - y * y)", "sqrt(105 / (4 * pi())) * x * y * z", "sqrt(21 / (32 * pi())) * y * (5 * z * z - 1)",
    "sqrt(7 / (16 * pi())) * z * (5 * z * z - 3)", "sqrt(21 / (32 * pi())) * x * (5 * z * z - 1)", "sqrt(105 / (16 * pi())) * z * (x * x - y * y)",
    "sqrt(35 / (32 * pi())) * x * (x * x - 3 * y * y)",
    "sqrt(315 / (16 * pi())) * x * y * (x * x - y * y)", "sqrt(315 / (32 * pi())) * y * z * (3 * x * x - y * y)", "sqrt(45 / (16 * pi())) * x * y * (7 * z * z - 1)",
    "sqrt(45 / (32 * pi())) * y * z * (7 * z * z - 3)", "sqrt(9 / (256 * pi())) * (35 * z * z * z * z - 30 * z * z + 3)", "sqrt(45 / (32 * pi())) * x * z * (7 * z * z - 3)",
    "sqrt(45 / (64 * pi())) * (x * x - y * y) * (7 * z * z - 1)", "sqrt(315 / (32 * pi())) * x * z * (x * x - 3 * y * y)",
    "sqrt(315 / (256 * pi())) * (x * x * (x * x - 3 * y * y) - y * y * (3 * x * x - y * y))",
]
Y = [f"{c}::DOUBLE{f}" for c, f in (("0.282094791773878", ""), ("0.48860251190292", " * y"), ("0.48860251190292", " * z"), ("0.48860251190292", " * x"), ("1.092548430592079", " * x * y"), ("1.092548430592079", " * y * z"), ("0.31539156525252", " * (3 * z * z - 1)"))]
TRIPLES = ((0, 0, 0), (1, 1, 0), (2, 2, 6), (3, 4, 5))


def of(name: str) -> str:
    return f"({ORACLE_SQL[name]})"


def _position(c: str = "") -> str:
    return ", ".join(f"{c}global_position_{a}" for a in "xyz")


MORE = {
    "tree_json_roundtrip": f"""SELECT object_id, level, octant_index, position_x, position_y, position_z, {_position()}, hash, is_empty FROM {of('octree_map')}""",
    "tree_ndjson_roundtrip": f"""SELECT object_id, level, octant_index, position_x, position_y, position_z, {_position()}, hash, is_empty FROM {of('octree_map')}""",
    "tree_csv_roundtrip": of("octree_map")[1:-1],
    "blocks_roundtrip": f"""WITH {TREE}, b AS (SELECT DISTINCT ON (level, h) object_id AS o, level AS l, size AS s, bi AS a, bj AS b, bk AS c, h FROM filled),
        f AS (SELECT l, h, s, count(*) AS n_cells, sum(n) AS checksum FROM b JOIN occ ON o = object_id AND l = level AND a = bi AND b.b = bj AND c = bk GROUP BY 1, 2, 3)
        SELECT DISTINCT level::BIGINT AS level, hash, s::BIGINT AS size, n_cells, checksum::BIGINT AS checksum FROM tree LEFT JOIN f ON l = level AND h = hash""",
    "registry_json_roundtrip": f"SELECT level, count(*) AS unique, sum(count)::BIGINT AS total, count(*) FILTER (is_empty) AS empty FROM {of('registry_table')} GROUP BY 1",
    "splits_json_roundtrip": ORACLE_SQL["objects_using_hash"],
    "object_metadata_json": f"""WITH v AS {of('voxelize_points')}, n AS (SELECT object_id, count(*) AS num_occupied_voxels FROM v GROUP BY 1),
        b AS (SELECT label::VARCHAR AS object_id, min(embedding[t * 3 + 1]::DOUBLE) AS min_x FROM embeddings, range(21) g(t) WHERE label IS NOT NULL GROUP BY 1)
        SELECT object_id, pitch AS voxel_pitch, {r('min_x')} AS min_x, num_occupied_voxels, {r('num_occupied_voxels / 4096.0::DOUBLE')} AS occupancy_ratio FROM {of('voxel_pitch')} JOIN n USING (object_id) JOIN b USING (object_id)""",
    "matrix_roundtrip": f"SELECT *, 16::BIGINT AS resolution FROM {of('matrix_stats')}",
    "light_metadata": f"""WITH {MATRIX} SELECT count(DISTINCT structure) AS num_structures, count(*) AS num_entries, 16::BIGINT AS resolution, 24::BIGINT AS num_patches, 4::BIGINT AS num_sh, 96::BIGINT AS matrix_size,
        0.05::DOUBLE AS sigma_a, 0.3::DOUBLE AS sigma_s, 0.2::DOUBLE AS g FROM matrix""",
    "morph_files": f"SELECT object_id AS source_id, 'to-' || object_id AS target_id, count(DISTINCT step) AS steps FROM ({STEPS}) GROUP BY 1",
    "morph_roundtrip": f"SELECT step, count(*) AS n, {r('sum(value)')} AS total FROM ({STEPS}) WHERE object_id = '0' GROUP BY 1",
    "rays_npz_roundtrip": f"""WITH {TRACED} SELECT 0::BIGINT AS level, object_id AS hash, count(*) AS n, sum(hit)::BIGINT AS hits, sum(face_id)::BIGINT AS faces, {r('round(sum(ox::FLOAT::DOUBLE), 2)')} AS origin_x
        FROM traced JOIN rays USING (ray_id, object_id) GROUP BY 2""",
    "distance_maps_roundtrip": f"""WITH {TRACED}, m AS (SELECT object_id, ray_id % 2 AS view_id, ray_id % 4 AS a, ray_id % 5 AS b, max(distance) AS distance, max(hit) AS hit FROM traced GROUP BY 1, 2, 3, 4)
        SELECT object_id, view_id, sum(hit)::BIGINT AS hits, {r('round(sum(distance::FLOAT::DOUBLE), 3)')} AS total FROM m GROUP BY 1, 2""",
    "discovered_objects": f"WITH {OBJECTS} SELECT object_id FROM objects",
    "resumed_build": ORACLE_SQL["registry_level_stats"],
    "pending_objects": f"WITH {TREE} SELECT object_id FROM tree GROUP BY 1 HAVING object_id::INT % 3 = 0 OR bool_or(NOT is_empty AND hash LIKE '3%')",
    "source_hashes": "SELECT page_id, sha256(encode(coalesce(html, ''))) AS source_hash FROM pages",
    "objects_range": f"WITH {OBJECTS} SELECT object_id FROM objects WHERE object_id >= '0050' ORDER BY 1 LIMIT 100",
    "random_object": f"WITH {OBJECTS} SELECT object_id FROM objects ORDER BY {bits('42', 'object_id')}, object_id LIMIT 1",
    "binarized": f"WITH {CELLS} SELECT object_id, count(*) AS n, sum(i * 10000 + j * 100 + k)::BIGINT AS checksum FROM cells WHERE (i + j + k) / 45.0::DOUBLE > 0.5 GROUP BY 1",
    "power_of_two_keys": "SELECT o_orderkey FROM orders WHERE o_orderkey > 0 AND o_orderkey & (o_orderkey - 1) = 0",
    "shallow_tree": f"SELECT * FROM {of('octree_map')} WHERE level = 1",
    "first_children": f"""WITH {TREE}, k AS (
          SELECT p.object_id, p.level, {_position('p.')}, p.hash AS parent_hash, c.octant_index, row_number() OVER (PARTITION BY p.object_id, p.level, {_position('p.')} ORDER BY c.octant_index) - 1 AS nth
          FROM tree p JOIN tree c ON c.object_id = p.object_id AND c.level = p.level + 1 AND {' AND '.join(f'c.global_position_{a} // p.size * p.size = p.global_position_{a}' for a in 'xyz')})
        SELECT object_id, level::BIGINT AS level, {', '.join(f'global_position_{a}::BIGINT AS global_position_{a}' for a in 'xyz')}, parent_hash, octant_index::BIGINT AS octant_index, nth FROM k WHERE nth < 3""",
    "hash_counts": f"""WITH {TREE}, asked AS (SELECT DISTINCT hash FROM tree WHERE level = 1 UNION ALL SELECT sha256(object_id) FROM objects), n AS (SELECT hash, count(*) AS count FROM tree GROUP BY 1)
        SELECT hash, coalesce(count, 0) AS count FROM asked LEFT JOIN n USING (hash)""",
    "blocks_with_uses": f"""WITH {TREE}, n AS (SELECT level, hash, count(*) AS uses FROM tree WHERE NOT is_full GROUP BY 1, 2)
        SELECT object_id, level::BIGINT AS level, sum(coalesce(uses, 0))::BIGINT AS uses, count(*) FILTER (uses IS NULL) AS unknown FROM tree LEFT JOIN n USING (level, hash) GROUP BY 1, 2""",
    "new_block_flags": f"""WITH {TREE} SELECT object_id, level::BIGINT AS level, {', '.join(f'global_position_{a}::BIGINT AS global_position_{a}' for a in 'xyz')},
        row_number() OVER (PARTITION BY level, hash ORDER BY object_id, {_position()}) = 1 AS is_new FROM tree""",
    "top_contents_of_level": f"""WITH {TREE}, n AS (SELECT level, hash, count(*) AS count FROM tree WHERE level = 2 GROUP BY 1, 2)
        SELECT level::BIGINT AS level, hash, count, row_number() OVER (ORDER BY count DESC, hash) AS rank FROM n QUALIFY rank <= 100""",
    "hashes_of_two_splits": f"""WITH {USAGE} SELECT hash, CASE WHEN bool_or(split = 'train') AND bool_or(split = 'val') THEN 'both' WHEN bool_or(split = 'train') THEN 'first' ELSE 'second' END AS side
        FROM usage WHERE split IN ('train', 'val') GROUP BY 1""",
    "cooccurrence_of_all": f"""WITH {TREE}, own AS (SELECT DISTINCT level, object_id, hash FROM tree WHERE NOT is_empty AND NOT is_full)
        SELECT a.hash AS hash_a, b.hash AS hash_b, count(*) AS objects, a.level::BIGINT AS level FROM own a JOIN own b ON a.object_id = b.object_id AND a.level = b.level AND a.hash < b.hash GROUP BY 1, 2, 4""",
    "samples_of_levels": f"""WITH {TREE}, {SPLITS} SELECT 0::BIGINT AS level, 'object_' || object_id AS hash FROM splits WHERE split = 'train'
        UNION ALL SELECT DISTINCT level::BIGINT, hash FROM tree JOIN splits USING (object_id) WHERE split = 'train' AND level = 2""",
    "existing_samples": f"""WITH {TREE}, {SPLITS}, held AS (SELECT DISTINCT level, hash FROM tree WHERE NOT is_full)
        SELECT DISTINCT level::BIGINT AS level, hash FROM tree JOIN splits USING (object_id) JOIN held USING (level, hash) WHERE split = 'train' AND NOT is_empty""",
    "collated_rays": f"WITH {BATCHED}, {RAYS} SELECT batch, ray_id, voxel_idx AS ray_to_voxel FROM rays JOIN batched USING (object_id)",
    "collated_edges": f"""WITH {BATCHED}, nodes AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY i, j, k) - 1 AS id FROM cells),
        offs AS (SELECT a::INT AS di, b::INT AS dj, c::INT AS dk FROM range(-1, 2) x(a), range(-1, 2) y(b), range(-1, 2) z(c) WHERE abs(a) + abs(b) + abs(c) <= 1),
        e AS (SELECT c.object_id, c.id AS src, d.id AS dst FROM nodes c, offs JOIN nodes d ON d.object_id = c.object_id AND d.i = c.i + di AND d.j = c.j + dj AND d.k = c.k + dk)
        SELECT batch, count(*) AS n, sum(src + node_offset)::BIGINT AS src, max(dst + node_offset)::BIGINT AS last FROM e JOIN batched USING (object_id) GROUP BY 1""",
    "padded_grids": f"""WITH {BATCHED}, x AS (SELECT object_id, max(i) + 1 AS ni, max(j) + 1 AS nj, max(k) + 1 AS nk FROM cells GROUP BY 1),
        w AS (SELECT batch, object_id, ni::BIGINT AS ni, nj::BIGINT AS nj, nk::BIGINT AS nk, {', '.join(f'(max(n{a}) OVER (PARTITION BY batch))::BIGINT AS p{a}' for a in 'ijk')} FROM x JOIN batched USING (object_id))
        SELECT *, pi * pj * pk - ni * nj * nk AS zeros FROM w""",
    "gathered_latents": f"WITH {COUNTS}, {RAYS} SELECT ray_id, object_id, {r('n / 4096.0::DOUBLE')} AS latent FROM rays JOIN counts USING (object_id)",
    "composed_transforms": f"""WITH {CELLS}, {OBJECTS}, {TURNS}, {FLIPS},
        t AS (SELECT object_id, i, CASE turns WHEN 1 THEN 15 - k WHEN 2 THEN 15 - j WHEN 3 THEN k ELSE j END AS j, CASE turns WHEN 1 THEN j WHEN 2 THEN 15 - k WHEN 3 THEN 15 - j ELSE k END AS k FROM cells JOIN turns USING (object_id)),
        f AS (SELECT object_id, CASE WHEN fi THEN 15 - i ELSE i END AS i, CASE WHEN fj THEN 15 - j ELSE j END AS j, CASE WHEN fk THEN 15 - k ELSE k END AS k FROM t JOIN flips USING (object_id))
        SELECT object_id, count(*) AS n, sum(i * 10000 + j * 100 + k)::BIGINT AS checksum FROM f GROUP BY 1""",
    "timing_percentiles": f"""SELECT event_type, count(*) AS n, {r('avg(value)')} AS mean, {r('min(value)')} AS least, {r('max(value)')} AS most,
        {', '.join(r(f'quantile_cont(value, {p})') + f' AS p{n}' for n, p in ((50, 0.5), (90, 0.9), (95, 0.95), (99, 0.99)))} FROM events GROUP BY 1""",
    "batch_totals": f"""WITH {TRACED}, o AS (SELECT object_id, count(*) AS n_rays, sum(distance) AS seconds, sum(hit) > 0 AS good FROM traced GROUP BY 1)
        SELECT count(*) AS total, count(*) FILTER (good) AS successful, count(*) FILTER (NOT good) AS failed, (sum(n_rays) FILTER (good))::BIGINT AS total_rays,
        {r('avg(n_rays) FILTER (good)')} AS mean_rays, {r('avg(seconds) FILTER (good)')} AS mean_seconds FROM o""",
    "trace_unnormalised": ORACLE_SQL["trace_dda"],
    "ray_stats_level_occupancy": f"""WITH {TRACED}, n AS (SELECT object_id, count(*) / 4096.0::DOUBLE AS occ FROM cells GROUP BY 1), ids AS (SELECT printf('%04d', p_partkey) AS object_id FROM part),
        met AS (SELECT DISTINCT level, object_id FROM traced), a AS (SELECT level, avg(coalesce(occ, 0)) AS mean FROM met JOIN ids USING (object_id) LEFT JOIN n USING (object_id) GROUP BY 1)
        SELECT level, count(*) AS n_rays, {r('any_value(mean)')} AS mean_occupancy FROM traced JOIN a USING (level) GROUP BY 1""",
    "sh_basis_4": f"WITH {DIRECTIONS} SELECT event_id, {', '.join(r(y) + f' AS y{n + 9}' for n, y in enumerate(HIGH))} FROM dirs",
    "sh_triple": f"""WITH {DIRECTIONS}, s AS (SELECT x, y, z FROM dirs)
        {' UNION ALL '.join(f"SELECT '{i}{j}{k}' AS indices, {r(f'avg(({Y[i]}) * ({Y[j]}) * ({Y[k]})) * 4 * pi()')} AS integral FROM s" for i, j, k in TRIPLES)} UNION ALL SELECT '900', 0.0::DOUBLE""",
    "cosine_directions": f"WITH {UV} SELECT event_id, {', '.join(r(c) + f' AS {a}' for a, c in zip('xyz', LOCAL, strict=True))} FROM uv",
    "world_directions": f"""WITH {UV}, {DIRECTIONS}, l AS (SELECT event_id, x AS nx, y AS ny, z AS nz, {', '.join(f'{c} AS l{a}' for a, c in zip('xyz', LOCAL, strict=True))} FROM uv JOIN dirs USING (event_id)),
        t AS (SELECT *, CASE WHEN abs(ny) >= 0.999 THEN 0 ELSE nz END AS ax, CASE WHEN abs(ny) >= 0.999 THEN -nz ELSE 0 END AS ay, CASE WHEN abs(ny) >= 0.999 THEN ny ELSE -nx END AS az FROM l),
        n AS (SELECT *, CASE WHEN sqrt(ax * ax + ay * ay + az * az) > 1e-8 THEN sqrt(ax * ax + ay * ay + az * az) ELSE 1 END AS s FROM t),
        b AS (SELECT *, ax / s AS tx, ay / s AS ty, az / s AS tz FROM n)
        SELECT event_id, {r('lx * tx + ly * (ny * tz - nz * ty) + lz * nx')} AS wx, {r('lx * ty + ly * (nz * tx - nx * tz) + lz * ny')} AS wy, {r('lx * tz + ly * (nx * ty - ny * tx) + lz * nz')} AS wz FROM b""",
    "energy_relative_to_max": f"""WITH {MATRIX}, e AS (SELECT structure, in_idx // 16 AS in_face, sum(abs(value)) AS energy FROM matrix GROUP BY 1, 2)
        SELECT structure, in_face, {r('coalesce(energy / nullif(max(energy) OVER (PARTITION BY structure), 0), 0)')} AS energy FROM e""",
    "matrix_overall": f"""WITH {MATRIX}, d AS (SELECT structure, coalesce(value, 0) AS v FROM (SELECT DISTINCT structure FROM matrix) CROSS JOIN range(96) a(out_idx) CROSS JOIN range(96) b(in_idx) LEFT JOIN matrix USING (structure, out_idx, in_idx)),
        s AS (SELECT structure, min(v) AS lo, max(v) AS hi, avg(v) AS mean, avg((v <> 0)::INT) AS nnz FROM d GROUP BY 1)
        SELECT count(*) AS matrices, {r('min(lo)')} AS min, {r('max(hi)')} AS max, {r('avg(mean)')} AS mean, {r('avg(nnz)')} AS nnz_ratio FROM s""",
    "view_radiance_all": f"WITH {MATRIX} SELECT structure, out_idx // 4 AS patch_id, {r('sum(value)')} AS radiance FROM matrix WHERE out_idx % 4 = 0 AND in_idx % 4 = 0 GROUP BY 1, 2",
    "patch_energy": f"""WITH {MATRIX}, e AS (SELECT structure, in_idx // 4 AS in_patch, out_idx // 4 AS out_patch, sum(abs(value)) AS energy FROM matrix GROUP BY 1, 2, 3)
        SELECT structure, in_patch, out_patch, {r('coalesce(energy, 0)')} AS energy FROM (SELECT DISTINCT structure FROM matrix) CROSS JOIN range(24) a(in_patch) CROSS JOIN range(24) b(out_patch) LEFT JOIN e USING (structure, in_patch, out_patch)""",
    "star_differences": f"SELECT a, b, max_abs, frobenius FROM {of('matrix_diff')} WHERE a = (SELECT min(l_returnflag) FROM lineitem)",
    "worst_error_pairs": f"""WITH e AS (SELECT l_returnflag AS structure, l_suppkey % 96 AS in_idx, l_partkey % 24 AS exit_patch, sum(w * w) AS ss, count(*) AS n, sum(w) * sum(w) * 0.9e-4::DOUBLE AS en
          FROM (SELECT *, l_discount + 0.01::DOUBLE AS w FROM lineitem) GROUP BY 1, 2, 3)
        SELECT structure, in_idx, exit_patch, {r('1 - least(1.0, en * 10000 / ss)')} AS error FROM e WHERE n >= 10 ORDER BY error DESC, structure, in_idx, exit_patch LIMIT 5""",
}
ORACLE_SQL.update(MORE)
