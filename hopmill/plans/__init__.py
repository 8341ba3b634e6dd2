"""Registered queries of the library on the driver's tables, module by module."""

from hopmill.plans import accounting_queries, family_queries, gate_queries, graph_queries, integrity_queries, metric_queries, review_queries, source_queries, text_queries

PLANS = [metric_queries, accounting_queries, integrity_queries, text_queries, graph_queries, review_queries, family_queries, source_queries, gate_queries]
