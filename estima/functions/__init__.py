"""Column expressions shared by the operators (all JVM-side, no UDFs)."""

from estima.functions.stats import (  # noqa: F401
    round_sig, sample_skewness, sample_kurtosis, t_test_p_value,
    pooled_t_statistic,
)
from estima.functions.hashing import hash_bucket, key_string, hash_hex  # noqa: F401
from estima.functions.tokens import NA_TOKENS  # noqa: F401
