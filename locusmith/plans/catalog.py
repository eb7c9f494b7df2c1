"""All queries of the core library, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from locusmith.plans import change_queries, corpus_queries, eval_queries, text_queries

MODULES = [change_queries, text_queries, corpus_queries, eval_queries]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
