"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from . import retrieval, structure, upkeep

QUERIES = {**retrieval.QUERIES, **structure.QUERIES, **upkeep.QUERIES}
ORACLE_SQL = {**retrieval.ORACLE_SQL, **structure.ORACLE_SQL, **upkeep.ORACLE_SQL}
