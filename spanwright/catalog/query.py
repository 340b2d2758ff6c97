"""What a registered query consists of."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    """`covers`: ids of the operator inventory. `sql` is None where SQL cannot express the operator."""

    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
