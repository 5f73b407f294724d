"""Connected components of an edge table, its rounds written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.graph import connected_components
from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(vertex, label) of every vertex that has a link; label is the least vertex reachable.  An empty table
    gives an empty result."""
    return connected_components(edges, lambda df: scratch.cut(df, "stars"))
