"""Query catalogue: importing this package fills `registry.ENTRIES`."""

from rankloom.catalog import (  # noqa: F401
    aggregates, chemistry, clinical, fitted, filters, joins, metrics, preparation, scalars,
    similarity, sources, trajectories)
from rankloom.catalog.registry import ENTRIES  # noqa: F401
