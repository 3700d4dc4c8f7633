"""Registered queries; importing this package fills the registry."""

from . import decision_queries, fact_queries, feed_queries, lexical_queries, picture_queries, rule_queries  # noqa: F401
