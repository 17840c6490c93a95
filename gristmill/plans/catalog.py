"""All queries of the library proper."""

from __future__ import annotations

from gristmill.plans import entities, market, search, streams, texts  # noqa: F401
from gristmill.plans.registry import ORACLE, QUERIES  # noqa: F401
