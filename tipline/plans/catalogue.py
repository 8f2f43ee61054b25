"""The query catalogue: name to Spark query, and name to the SQL that must return the same rows."""

from __future__ import annotations

from tipline.plans import audits, cards, evaluation, features, feeds, matchups, merging, projections
from tipline.plans.registry import ORACLES, QUERIES

__all__ = ["audits", "cards", "evaluation", "features", "feeds", "matchups", "merging", "projections"]


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict:
    return dict(ORACLES)
