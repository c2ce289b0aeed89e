"""Small expression-building helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable and evaluate ``body`` on it once.

    Expressions inside higher-order functions get no common-subexpression
    elimination, so a helper that refers to its argument many times would
    copy a large argument into the plan many times.  Binding it through a
    one-element ``transform`` keeps the plan linear in size.
    """
    return F.get(F.transform(F.array(value), body), 0)
