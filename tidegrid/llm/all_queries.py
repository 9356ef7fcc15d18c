"""Importing this module registers every query of this package."""

import corpus_pipeline
from tidegrid.llm import queries  # noqa: F401
from tidegrid.llm.registry import ORACLES, QUERIES  # noqa: F401

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
