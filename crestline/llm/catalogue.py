"""All queries of the pipeline operators."""

from crestline.llm import (  # noqa: F401
    fingerprint, htmltext, maxscore, mixing, neardup, packing, spelling, substring, suffixes, toxicity, urlrules, warc, whitening)
from crestline.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
