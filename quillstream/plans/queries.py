"""All registered queries of the stream-quality operators."""

from __future__ import annotations

from . import chain_queries, evidence_queries, fold_queries, lineage_queries, more_queries, quality_queries, revision_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
