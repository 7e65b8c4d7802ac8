from feira.functions.dates import day_diff, first_of_month, lenient_timestamp, month_diff
from feira.functions.numeric import (
    count_when,
    int_div,
    money,
    ratio_pct_round,
    ratio_round,
    round_double,
    sample_stdev,
)

__all__ = [
    "count_when",
    "day_diff",
    "first_of_month",
    "int_div",
    "lenient_timestamp",
    "money",
    "month_diff",
    "ratio_pct_round",
    "ratio_round",
    "round_double",
    "sample_stdev",
]
