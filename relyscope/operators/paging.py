"""Page arithmetic on a count row (I8 / M3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import OPEN_ONLY, RESOLVED_ONLY, incident_window, is_open, is_resolved
from .incidents import count_if

# The page sizes offered, and the default.
PAGE_SIZES = (10, 20, 50)
DEFAULT_PAGE_SIZE = 20


def _summary(total, size: int, asked):
    size = F.lit(int(size)).cast("bigint")
    total = total.cast("bigint")
    pages = F.greatest(F.lit(1).cast("bigint"), F.ceil(total / size).cast("bigint"))
    pg = F.least(asked.cast("bigint"), pages - 1)
    return [total.alias("total"), size.alias("page_size"), pages.alias("pages"),
            pg.alias("page"), (pg * size + 1).alias("lo"), F.least((pg + 1) * size, total).alias("hi")]


def page_summary(counts: DataFrame, page_size: int = DEFAULT_PAGE_SIZE, page: int = 0,
                 count_col: str = "cnt") -> DataFrame:
    """pages = max(1, ceil(total/size)); page clamped to the last; shown range lo..hi."""
    return counts.select(*_summary(F.col(count_col), page_size, F.lit(int(page))))


def status_page_summaries(incidents: DataFrame, as_of=None, days: int = 7,
                          page_size: int = DEFAULT_PAGE_SIZE, open_page: int = 0,
                          resolved_page: int = 0, date_partitioned: bool = False) -> DataFrame:
    """I8 for both statuses plus D14 for each, from one aggregate (one scan).

    The investigate page counts open and resolved incidents with two queries
    in the reference; here one aggregate returns both and each becomes a row
    ``(status, total, page_size, pages, page, lo, hi)``.
    """
    counts = incidents.where(incident_window(as_of, days, date_partitioned)).agg(
        count_if(is_open()).alias("_o"), count_if(is_resolved()).alias("_r"))
    rows = counts.select(F.inline(F.array(
        F.struct(F.lit(OPEN_ONLY).alias("status"), F.col("_o").alias("cnt"),
                 F.lit(int(open_page)).alias("asked")),
        F.struct(F.lit(RESOLVED_ONLY).alias("status"), F.col("_r").alias("cnt"),
                 F.lit(int(resolved_page)).alias("asked")))))
    return rows.select("status", *_summary(F.col("cnt"), page_size, F.col("asked")))
