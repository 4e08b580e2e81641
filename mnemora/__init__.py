"""mnemora: vector-backed memory and conversational text analytics on Spark DataFrames."""

from mnemora.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
