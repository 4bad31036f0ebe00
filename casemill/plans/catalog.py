"""Queries of the engine's own operators by name, and their DuckDB SQL."""

from __future__ import annotations

from casemill.functions import queries as _functions  # noqa: F401  registers
from casemill.operators import aggregates, audit, audit_text, eligibility, evaluation, extraction, filters, joins, leaks, name_cases, names_queries, notice_text, notices, readmodel, rescreen_queries, scoring, screen_queries, screening, trust, windows  # noqa: F401
from casemill.plans.registry import ORACLES, QUERIES  # noqa: F401
from casemill.sources import queries as _sources  # noqa: F401
from casemill.streaming import queries as _streaming  # noqa: F401
