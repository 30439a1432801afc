"""All registered queries and the SQL they are held against."""

from __future__ import annotations

from dropletry.plans import alleles, counting, filtering, files, linking, models, single_cell

_MODULES = (single_cell, counting, alleles, linking, filtering, files, models)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
