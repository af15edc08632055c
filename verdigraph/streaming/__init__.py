"""Structured Streaming over a growing answer log."""

from verdigraph.streaming.failures import FailureCut, cut_stream
from verdigraph.streaming.scoring import drain_to_table, score_stream

__all__ = ["FailureCut", "cut_stream", "drain_to_table", "score_stream"]
