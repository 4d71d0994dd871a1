"""Runs as streams: stateless validation, counts by event time, and counts of micro-batches merged into a table."""

from assayer.streaming.measures import batch_counts, measures_so_far, merge_run, merged_counts
from assayer.streaming.runs import accumulate_counts, read_run, validate_stream

__all__ = ["accumulate_counts", "batch_counts", "measures_so_far", "merge_run", "merged_counts", "read_run", "validate_stream"]
