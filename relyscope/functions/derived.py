"""Per-row derived values D1, D2, D5, D6, D7 as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DASH

# Categories shown as DELAYED (rather than FAILED) while open.
DELAYED_CATEGORIES = ("TIMEOUT", "NETWORK", "DEPENDENCY")
# Texts read as a true auto-resolved flag.
TRUE_TEXTS = ("true", "1", "yes")


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def resolved_flag(resolved_at="resolved_at") -> Column:
    """A resolution time is present."""
    return _c(resolved_at).isNotNull()


def incident_status(cause="cause_category", resolved_at="resolved_at") -> Column:
    """RESOLVED, else DELAYED for wait-type causes, else FAILED."""
    return (F.when(resolved_flag(resolved_at), F.lit("RESOLVED"))
            .when(F.upper(_c(cause)).isin(*DELAYED_CATEGORIES), F.lit("DELAYED"))
            .otherwise(F.lit("FAILED")))


def confidence_pct(conf="confidence") -> Column:
    """``int(confidence * 100)`` truncated; 0 when missing, NaN or infinite."""
    v = _c(conf).cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(bad, F.lit(0).cast("bigint")).otherwise(
        F.coalesce((v * 100).try_cast("bigint"), F.lit(0)))


def auto_flag(auto="auto_resolved") -> Column:
    """Auto-resolved when the value reads true / 1 / yes."""
    return F.coalesce(F.lower(_c(auto).cast("string")).isin(*TRUE_TEXTS), F.lit(False))


def mttr_text(mttr="mttr_minutes") -> Column:
    """Whole minutes + `` min``; missing or zero shows an em dash."""
    m = _c(mttr)
    return (F.when(m.isNull() | (m == 0), F.lit(DASH))
            .otherwise(F.concat(m.cast("double").cast("bigint").cast("string"), F.lit(" min"))))
