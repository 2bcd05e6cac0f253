"""Named queries over the driver's tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from tessera.queries import answering, bills, changing, fulltext, graphs, retrieving, rules, sequences, speech

_THEMES = (retrieving, sequences, graphs, changing, speech, answering, fulltext, bills, rules)
QUERIES: dict = {name: query for theme in _THEMES for name, query in theme.QUERIES.items()}
SQL: dict = {name: sql for theme in _THEMES for name, sql in theme.SQL.items()}
FLAGSHIP = "rrf_fusion"
