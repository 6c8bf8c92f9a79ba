"""Where records, features, responses and catalogs come from, and where results go."""

from tessera.sources.http import HttpTransport, Settings
from tessera.sources.records import dataset_records, feature_table, from_records, in_file_order, read_dataset, read_ndjson, with_ord
from tessera.sources.sinks import for_each_result, results_to_frames, results_to_pandas, save_results, write_json_lines, write_tsv

__all__ = [
    "HttpTransport",
    "Settings",
    "dataset_records",
    "feature_table",
    "for_each_result",
    "from_records",
    "in_file_order",
    "read_dataset",
    "read_ndjson",
    "results_to_frames",
    "results_to_pandas",
    "save_results",
    "with_ord",
    "write_json_lines",
    "write_tsv",
]
