"""Explicit schemas of the engine's tables, as DDL."""

CELLS = "object_id string, i int, j int, k int"
SUBDIVISION_MAP = (
    "object_id string, level int, octant_index int, position_x int, position_y int, position_z int, "
    "global_position_x int, global_position_y int, global_position_z int, hash string, is_empty boolean"
)
REGISTRY = "hash string, level int, count bigint, path string, is_empty boolean, resolution int"
OBJECT_METADATA = (
    "object_id string, source_file string, voxel_pitch double, original_bbox_min array<double>, original_bbox_max array<double>, "
    "original_bbox_extents array<double>, num_occupied_voxels bigint, occupancy_ratio double, source_hash string"
)
OBJECT_SPLITS = "object_id string, split string"
HASH_USAGE = "hash string, object_id string, split string"
RAYS = (
    "level int, hash string, ray_id int, ox float, oy float, oz float, dx float, dy float, dz float, "
    "distance float, hit tinyint, face_id int, view_id int"
)
VIEWS = "view_id int, px float, py float, pz float"
CHUNKS = "sample_idx int, subvolume_idx int, chunk_start int, chunk_end int, num_rays int"
TRANSFER = "structure string, out_idx int, in_idx int, value float"
MORPH_STEPS = "source_id string, target_id string, step int, i int, j int, k int, value double"
