"""Row-wise scalar functions and null-safe rule predicates."""

from riskframe.functions.rules import (  # noqa: F401
    Rule, all_of, any_of, as_column, decode, decoded_code, flag_count, hash_bucket,
    hash_key, hash_unit, is_true, nan_to_null, row_mean, yes_no,
)
