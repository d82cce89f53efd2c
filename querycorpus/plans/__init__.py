"""Queries bound to the given tables, by area. ``QUERIES`` and ``ORACLES`` share their keys."""

from querycorpus.plans import comparing, corpora, landing, neighbours, profiling, querylog, running, scoring, tabletext

AREAS = [profiling, running, landing, comparing, querylog, tabletext, corpora, neighbours, scoring]
