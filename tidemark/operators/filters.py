"""Predicates on metadata."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def meta_eq(key: str, value: str, column: str = "metadata") -> Column:
    """Equality; a missing key counts as empty, but no metadata at all matches nothing."""
    found = F.coalesce(F.col(column)[key], F.lit("")) == value
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & found, F.lit(False))


def all_of(*conditions: Column) -> Column:
    return reduce(and_, conditions, F.lit(True))
