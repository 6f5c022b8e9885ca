"""All queries of the core, and the SQL each is checked against."""

from __future__ import annotations

from vitalake.plans import problems, reference

QUERIES = {**problems.QUERIES, **reference.QUERIES}
ORACLES: dict[str, str] = {**problems.ORACLES, **reference.ORACLES}
