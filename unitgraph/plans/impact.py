"""Change impact: changed files or names to chains of callers (entry C of the model)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import DEFAULT, Settings
from ..operators import graph as G
from ..sources import diffs


def impact_of_diff(diff: DataFrame, units: DataFrame, edges: DataFrame, settings: Settings = DEFAULT, mode: str = "head", compare: str | None = None) -> DataFrame:
    """Chains of all units that the diff touches (modes head and between)."""
    diffs.check_mode(mode, compare)
    touched = G.units_of_hunks(units, diffs.hunks(diffs.changed_files(diff, settings)))
    return impact_of_names(touched.select("qualified_name"), units, edges, settings)


def impact_of_names(names: DataFrame, units: DataFrame, edges: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Chains of given names (modes methods and recent)."""
    starts = names.select(names.columns[0]).distinct().toDF("start_qn")
    return G.impact_chains(starts, edges, units, settings)
