"""All registered queries and their oracle SQL, gathered from the family modules."""

from __future__ import annotations

import importlib

from tidelag.plans.inputs import ORACLES, QUERIES

#: Modules whose queries are registered by importing them.
FAMILIES = ("teams", "players", "participation", "games", "rosters", "market", "rankings", "adjusters", "accuracy", "texts", "mentions", "checks", "streams", "models", "prospects", "profiles")

for family in FAMILIES:
    importlib.import_module(f"tidelag.plans.{family}")

__all__ = ["FAMILIES", "ORACLES", "QUERIES"]
