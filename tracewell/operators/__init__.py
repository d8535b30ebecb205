"""Operators that compose DataFrames: sequences of events, correlations, counters, aggregates."""
