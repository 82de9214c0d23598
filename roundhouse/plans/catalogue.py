"""All queries of the catalogue."""

from __future__ import annotations

from . import aiming, chances, combat, economy, live, logs, match, mistakes, places, playstyle, roles, rounds, selection, standing, timing
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "aiming", "chances", "combat", "economy", "live", "logs", "match", "mistakes", "places", "playstyle", "roles", "rounds", "selection", "standing", "timing"]
