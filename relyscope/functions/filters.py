"""Predicates shared by the operators.

All predicates are plain Columns with literal bounds, so Catalyst folds them
and hands them to the Parquet reader as pushed filters.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reference's status filter choices and its "all" choice.
OPEN_ONLY = "Open only"
RESOLVED_ONLY = "Resolved only"
ALL = "All"


def as_date(as_of) -> Column:
    """The reporting date (R12): a literal when given, else ``current_date()``."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.date()
    if isinstance(as_of, str):
        as_of = _dt.date.fromisoformat(as_of)
    return F.lit(as_of)


def window_start(as_of, days: int) -> Column:
    """Midnight ``days`` days before the reporting date."""
    return F.date_sub(as_date(as_of), int(days))


def since(ts_col: str, as_of, days: int) -> Column:
    """``ts >= as_of - days`` with no upper bound (future rows count)."""
    return F.col(ts_col) >= window_start(as_of, days)


def incident_window(as_of, days: int, date_partitioned: bool = False) -> Column:
    """R1 on ``detected_at``.

    With ``date_partitioned=True`` the caller asserts that ``detected_date`` is
    the date of ``detected_at`` (true for tables written by this library); the
    equivalent ``detected_date`` bound is then added so a table partitioned by
    ``detected_date`` is pruned to the window's directories.
    """
    cond = since("detected_at", as_of, days)
    if date_partitioned:
        cond = cond & (F.col("detected_date") >= window_start(as_of, days))
    return cond


def is_open() -> Column:
    """R2: open means ``resolved_at IS NULL``."""
    return F.col("resolved_at").isNull()


def is_resolved() -> Column:
    """Resolved means a ``resolved_at`` value is present."""
    return F.col("resolved_at").isNotNull()


def status_filter(status: str | None) -> Column | None:
    """Exactly ``Open only`` / ``Resolved only``; anything else adds no predicate."""
    if status == OPEN_ONLY:
        return is_open()
    if status == RESOLVED_ONLY:
        return is_resolved()
    return None


def is_all(value) -> bool:
    """``None``, empty or ``All`` mean no filter."""
    return value is None or (isinstance(value, str) and value.strip() in ("", ALL))


def all_of(conds) -> Column:
    """AND an optional list of predicates (the reference's ``1=1`` seed)."""
    conds = [c for c in conds if c is not None]
    if not conds:
        return F.lit(True)
    return reduce(lambda a, b: a & b, conds)
