"""Queries that bind the operators to the driver's tables."""

from . import captions, corpus, joins, ledger, metrics, relational, rules, search, streams, tail  # noqa: F401
