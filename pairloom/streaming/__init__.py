"""Incremental runs: a directory of documents is turned into sentence windows, each file once."""

from pairloom.streaming.ingest import ingest_sentences, read_stream

__all__ = ["ingest_sentences", "read_stream"]
