"""Spark toolkit for labelled text corpora and for judging classifier answers over them."""

from verdigraph.session import build_session, scratch_path, shared_dir

__all__ = ["build_session", "scratch_path", "shared_dir"]
