"""Evaluate a value once per row before using it inside an array lambda.

The optimizer moves a column that is used once into its consumer. Inside a lambda that means once per element, so
a per-row total used there would be recomputed for every array element. Binding it as a lambda variable keeps it
at one evaluation per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)
