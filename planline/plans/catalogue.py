"""Every registered query with its SQL twin."""

from __future__ import annotations

from planline.plans import queries_dossier, queries_drawing, queries_feeds, queries_files, queries_filters, queries_joins, queries_measures, queries_sources, queries_values

_MODULES = (queries_filters, queries_measures, queries_joins, queries_values, queries_feeds, queries_sources, queries_dossier, queries_drawing, queries_files)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
