"""Source-code corpus preparation as Spark DataFrame operators."""

from glossmill.config import JobConfig

__all__ = ["JobConfig"]
