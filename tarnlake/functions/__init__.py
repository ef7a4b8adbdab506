"""Column expressions, all JVM-side."""

from tarnlake.functions.counts import row_count
from tarnlake.functions.dates import day_text, event_time, typed, typed_report
from tarnlake.functions.fingerprint import row_hash, spread_hash
from tarnlake.functions.money import money_avg, money_sum

__all__ = [
    "day_text",
    "event_time",
    "money_avg",
    "money_sum",
    "row_count",
    "row_hash",
    "spread_hash",
    "typed",
    "typed_report",
]
