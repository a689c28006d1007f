"""Every operator as a query over the given tables, next to the SQL that must give the same rows."""

from .base import ORACLES, QUERIES  # noqa: F401
from . import analytics, detectors, extraction, scalars, streams  # noqa: F401
