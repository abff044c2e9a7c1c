"""Importing this registers every query."""

from lexgrove.plans import audit_queries, corpus_queries, graph_queries, passage_queries, rule_queries  # noqa: F401
