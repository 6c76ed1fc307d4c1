"""kpiframe — weighted-KPI exploration operators on Spark DataFrames.

Every public operator takes a DataFrame and returns DataFrames built from
Spark columns, aggregations and windows; nothing row-level passes through
the driver.  Small, bounded results (a handful of scalars, <= 1000 tile
edges, display rows under an explicit cap) are the only things ever collected.
"""

from __future__ import annotations

import importlib

_EXPORTS = {
    "get_spark": "kpiframe.session",
    "ensure_checkpoint_dir": "kpiframe.session",
    "Table": "kpiframe.sources.table",
    "load_table": "kpiframe.sources.table",
    "chart": "kpiframe.plans.chart",
    "ChartResult": "kpiframe.plans.chart",
    "geo_summary": "kpiframe.plans.geo",
    "GeoResult": "kpiframe.plans.geo",
    "boundary_join": "kpiframe.plans.geo",
    "profile": "kpiframe.operators.profile",
    "chart_defaults": "kpiframe.operators.profile",
    "chart_from_request": "kpiframe.plans.chart",
    "geo_from_request": "kpiframe.plans.geo",
    "MapResult": "kpiframe.plans.geo",
    "apply_filter": "kpiframe.operators.filters",
    "combine_filters": "kpiframe.operators.filters",
    "check_filters": "kpiframe.operators.filters",
    "row_counts": "kpiframe.operators.filters",
    "load_saved_filters": "kpiframe.sources.saved_filters",
    "read_boundaries": "kpiframe.sources.boundaries",
    "write_features": "kpiframe.sources.boundaries",
    "features_from_wkb": "kpiframe.sources.boundaries",
    "assign_tiles": "kpiframe.operators.tiles",
    "running_sum": "kpiframe.operators.ranking",
}

__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name in _EXPORTS:
        return getattr(importlib.import_module(_EXPORTS[name]), name)
    raise AttributeError(name)
