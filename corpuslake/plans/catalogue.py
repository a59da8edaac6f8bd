"""The catalogue of queries over the reference's operators, with their oracle SQL."""

from __future__ import annotations

from corpuslake.plans import context, corpus, evaluation, parsing, retrieval, serving, storage, text

_MODULES = (retrieval, context, corpus, parsing, evaluation, serving, storage, text)
QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
