"""All core queries by name, and their DuckDB twins."""

from __future__ import annotations

from spelunka.plans import extra, graph, project, quality, search  # noqa: F401
from spelunka.plans.base import ORACLES, QUERIES  # noqa: F401
