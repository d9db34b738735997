"""Collects every registered query."""

from tallyfold.plans import combining, first_look, layout, profiles, questions, recovery, shaping, sheets, streams  # noqa: F401
from tallyfold.plans.registry import ORACLES, QUERIES  # noqa: F401
