"""Column expressions and small distributed building blocks."""

from cellsight.functions.columns import (decimal_text, measure, numeric_text, parse_event_time,
                                         parse_with_formats, surrogate_key, total_usage,
                                         weekday_name)
from cellsight.functions.ranking import column_percentiles, exact_percentiles, rank_within

__all__ = [
    "decimal_text", "measure", "numeric_text", "parse_event_time", "parse_with_formats", "surrogate_key",
    "total_usage", "weekday_name", "column_percentiles", "exact_percentiles", "rank_within",
]
