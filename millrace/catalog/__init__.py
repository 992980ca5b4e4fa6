"""The registered queries, each next to the SQL that must give the same rows."""

from millrace.catalog.registry import ORACLES, QUERIES
from millrace.catalog import (  # noqa: F401  (importing registers)
    accounts,
    allocation,
    curation,
    files,
    series,
    streams,
    texts,
    verdicts,
)

__all__ = ["ORACLES", "QUERIES"]
