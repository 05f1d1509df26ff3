"""Name -> query, and name -> equivalent SQL."""

from __future__ import annotations

from . import closure_plans, file_plans, filter_plans, join_plans, kernel_plans, measure_plans, opening_plans, path_plans, plane_plans, pose_plans, relational_plans, shape_plans, space_plans, thermal_plans, time_plans  # noqa: F401  they fill the registry
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "thermal_voxel_u_value"
