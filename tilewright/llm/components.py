"""Connected components with every round kept as a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import graph
from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id it reaches."""
    return graph.connected_components(links, materialize)
