"""Readers and writers of the file forms a run leaves behind."""

from verdigraph.sources.readers import lines_in_order, read_corpus, read_responses, read_shots
from verdigraph.sources.writers import (
    append_responses,
    commit_runs,
    log_lines,
    open_buckets,
    read_log,
    read_runs,
    split_generations,
    stage_runs,
    write_buckets,
    write_generations,
    write_history,
    write_metrics,
    write_predictions,
    write_runs,
)

__all__ = [
    "append_responses", "commit_runs", "lines_in_order", "log_lines", "open_buckets", "read_corpus", "read_log", "read_responses", "read_runs", "read_shots", "split_generations",
    "stage_runs", "write_buckets", "write_generations", "write_history", "write_metrics", "write_predictions", "write_runs",
]
