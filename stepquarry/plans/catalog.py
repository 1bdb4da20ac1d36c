"""Every query on the reference's operators, with its SQL twin."""

from __future__ import annotations

from . import eval_queries, grade_queries, sample_queries, source_queries, text_queries, tree_queries  # noqa: F401  they register themselves
from .registry import ORACLE, QUERIES  # noqa: F401
