"""Queries over the driver tables and, for most of them, equivalent SQL."""

from railtempo.catalog import detection, features, feeds, reports, streams  # isort: skip
from railtempo.catalog import checks  # isort: skip, builds on the others
from railtempo.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "checks", "detection", "features", "feeds", "reports", "streams"]
