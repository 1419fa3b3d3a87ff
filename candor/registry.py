"""The registered queries of the library proper and the SQL that reproduces them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from candor.plans import base
from candor.plans import relational, scores, texts  # noqa: F401

FLAGSHIP = "weak_label_summary"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
