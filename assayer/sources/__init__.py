"""Readers with explicit schemas, and sinks."""

from assayer.sources.readers import annotations, attribution, delimited, jsonl, pairs, profiles, qrels, text_files, trec_run, verification_answers
from assayer.sources.writers import write_annotations, write_answers, write_measures

__all__ = [
    "annotations", "attribution", "delimited", "jsonl", "pairs", "profiles", "qrels", "text_files", "trec_run", "verification_answers",
    "write_annotations", "write_answers", "write_measures",
]
