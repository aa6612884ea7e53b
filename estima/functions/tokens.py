"""Texts that count as not available."""

# The text tokens that the usual CSV reader (pandas ``read_csv``
# defaults) turns into a missing value. Matching is exact and case-sensitive.
NA_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)
