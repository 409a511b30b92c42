"""Matching free-form attribute values against a reference table, as Spark jobs."""

from .operators.matching import hashed_trigrams
from .operators.terms import ValueRules
from .plans.cascade import display_columns, match_values
from .plans.prepared import PreparedReference, prepare_reference
from .session import build_session
from .sources.tables import load_inputs, load_reference, read_table

__all__ = [
    "PreparedReference",
    "ValueRules",
    "build_session",
    "display_columns",
    "hashed_trigrams",
    "load_inputs",
    "load_reference",
    "match_values",
    "prepare_reference",
    "read_table",
]
