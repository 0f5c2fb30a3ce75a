"""Runnable examples of every operator on the TPC-H-like test tables.

``QUERIES`` maps a name to ``(spark, folder) -> DataFrame`` and ``ORACLES`` to
the equivalent SQL over the same tables.
"""

from risingtide.catalogue.base import ORACLES, QUERIES
from risingtide.catalogue import files, models, proofs, reports, rows, scale, texts  # noqa: F401  (register)

__all__ = ["ORACLES", "QUERIES"]
