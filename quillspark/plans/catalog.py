"""All registered layout queries; importing this module fills the registry."""

from __future__ import annotations

from quillspark.plans import box_queries, cache_queries, control_queries, fold_queries, layout_queries, link_queries, region_queries, style_queries, table_queries, translate_queries, unit_queries  # noqa: F401
from quillspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
