"""All queries of the library by name, with the SQL that says the same."""

from __future__ import annotations

from causeway.plans import analysis, core, records  # noqa: F401

QUERIES: dict = {**core.QUERIES}
ORACLE_SQL: dict = {**core.ORACLE_SQL}
