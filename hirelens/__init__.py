"""hirelens — job-posting market analytics as lazy Spark DataFrame jobs.

Every operator has the shape ``op(df, *, as_of=..., ...) -> DataFrame``: it
never calls ``collect()`` and never reads the wall clock, so the same call
gives the same rows on a laptop and on a thousand-executor cluster.
"""

from hirelens.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
