"""Canonical schemas."""

POINTS = (
    "point_idx long, x float, y float, z float, r short, g short, b short, intensity float, classification short, "
    "return_number short, num_returns short, source_id int, gps_time double, nir int, src string"
)
NODES = (
    "name string, depth int, num_points long, child_mask int, is_leaf boolean, min_x double, min_y double, min_z double, "
    "max_x double, max_y double, max_z double, radius double, spacing double, byte_offset long, byte_size long"
)
AXES = ("x", "y", "z")


def fields(schema: str) -> list[tuple[str, str]]:
    """Names and types of a schema."""
    return [tuple(f.split()) for f in schema.split(", ")]
