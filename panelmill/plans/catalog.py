"""All registered queries."""

from . import queries_aggregates, queries_cleaning, queries_frames, queries_graph, queries_joins, queries_models, queries_windows  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
