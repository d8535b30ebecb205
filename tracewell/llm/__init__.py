"""Operators of a large training-data pipeline: tokenising, scoring, deduplication, mixing, audit.

Nothing outside this folder imports it; ``registry`` names the queries that use it.
"""
