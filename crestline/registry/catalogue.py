"""All registered queries."""

from crestline.registry import catalogue_views, grades_tags, pages_io  # noqa: F401
from crestline.registry.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
