"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audits, contest, engines, evidence, finance, layout, orient, rebuild, tables, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (finance, text, layout, tables, audits, orient, evidence, engines, rebuild, contest):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
