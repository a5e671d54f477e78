"""Set-oriented analytics over source-code review data, built on Spark DataFrames."""

from reviewloom.session import configure, scratch_dir

__all__ = ["configure", "scratch_dir"]
