"""Sources and sinks: columnar tables, CSV with one-pass type inference,
inline request strings, and the model registry."""

from estima.sources.tables import TABLES, scan_table, load_report  # noqa: F401
from estima.sources.csv import (  # noqa: F401
    scan_csv, read_csv_text, infer_types, na_normalise, sniff_delimiter,
    apply_types, score_csv_source,
)
from estima.sources.inline import inline_source  # noqa: F401
from estima.sources.registry import (  # noqa: F401
    model_metadata, model_save, model_load, score_sink, ModelBundle,
)
