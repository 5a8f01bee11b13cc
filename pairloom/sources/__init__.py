"""Readers and writers: text lines, JSON documents, pair files, aligned datasets, generator logs."""

from pairloom.sources.files import (
    list_files,
    read_dataset,
    read_documents,
    read_lines,
    read_numbered_lines,
    read_pairs,
    read_scores,
    read_word_ranks,
    split_shards,
    write_dataset,
    write_lines,
    write_pairs,
)

__all__ = [
    "list_files",
    "read_dataset",
    "read_documents",
    "read_lines",
    "read_numbered_lines",
    "read_pairs",
    "read_scores",
    "read_word_ranks",
    "split_shards",
    "write_dataset",
    "write_lines",
    "write_pairs",
]
