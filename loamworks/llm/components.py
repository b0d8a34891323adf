"""Connected components of a graph whose edges lie in a DataFrame, as in operators/graph.py."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.graph import components


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge.

    edges: two columns of one orderable type; direction, repeats, loops and nulls don't matter (an edge with a null, or a
    loop, is none). No edges: an empty table. Only counts come to the driver: a few jobs, where few edges are linked by one task.
    """
    a, b = (f"`{c}`" for c in edges.columns)
    return components(edges.where(f"{a} <> {b}"))
