"""Registered queries over the given tables, and their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trajspark.plans import q_alignment, q_edits, q_images, q_layouts, q_motion, q_names, q_quality, q_reports, q_stats
from trajspark.plans.rounding import plain_zero

MODULES = (q_stats, q_motion, q_alignment, q_edits, q_quality, q_images, q_layouts, q_reports, q_names)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: plain_zero(v) for m in MODULES for k, v in m.ORACLE.items()}
