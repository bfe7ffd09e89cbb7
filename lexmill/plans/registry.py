"""All queries of the library by name, with their reference SQL."""

from __future__ import annotations

from lexmill.plans import build, consult, corpus, search

QUERIES = {**search.QUERIES, **corpus.QUERIES, **consult.QUERIES, **build.QUERIES}
ORACLES = {**search.ORACLES, **corpus.ORACLES, **consult.ORACLES, **build.ORACLES}
