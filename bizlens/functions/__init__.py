from bizlens.functions.expr import (
    NUMBER_TEXT,
    col_ref,
    is_date_type,
    is_numeric_type,
    money_text,
    pct_change,
    percent_text,
    to_number,
    unbiased_skew,
    zero_sum,
)

__all__ = [
    "NUMBER_TEXT",
    "col_ref",
    "is_date_type",
    "is_numeric_type",
    "money_text",
    "pct_change",
    "percent_text",
    "to_number",
    "unbiased_skew",
    "zero_sum",
]
