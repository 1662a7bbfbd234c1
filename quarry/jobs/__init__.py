"""Queries that apply the operators to the given tables."""

from ..registry import ORACLES, QUERIES
from . import aggregates, chunks, corpus, graph, records, retrieval, streams, text

__all__ = ["ORACLES", "QUERIES", "aggregates", "chunks", "corpus", "graph", "records", "retrieval", "streams", "text"]
