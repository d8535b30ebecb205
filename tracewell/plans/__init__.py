"""All registered queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import predicates as p
from ..sources.views import log
from . import aggregates, correlations, filters, hints, lines, mibs, packets, parsers, payloads, protocols, rules, scalars, sequences, streams, tcp, traps  # noqa: F401
from .registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings and worse that do not come from one host: a boolean filter over the log view."""
    rows = log(spark, sf_dir)
    return rows.where(p.compare("severity", "<=", 4) & ~p.host("address", "host", "sw7$")).select("id", "received", "host", "program", "severity", "message")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
