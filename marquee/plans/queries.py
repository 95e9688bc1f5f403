"""All registered queries: importing this module imports the query modules."""

from __future__ import annotations

from marquee.plans import q_clean, q_expr, q_io, q_linkage, q_model, q_profile, q_reports  # noqa: F401
from marquee.plans.registry import ORACLE, QUERIES, query, rnd, tables  # noqa: F401
