"""All of the engine's own queries and their SQL."""

from __future__ import annotations

from vellumgrid.plans import answers, graph, retrieval

_ALL = {**retrieval.QUERIES, **graph.QUERIES, **answers.QUERIES}
QUERIES = {name: run for name, (run, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
