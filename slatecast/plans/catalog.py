"""Queries over the driver tables and their SQL."""

from __future__ import annotations

from . import competition, evaluation, forecasts, panels, relational, rules, sources

QUERIES: dict = panels.QUERIES | competition.QUERIES | forecasts.QUERIES | evaluation.QUERIES | relational.QUERIES | rules.QUERIES | sources.QUERIES
SQL: dict = panels.SQL | competition.SQL | forecasts.SQL | evaluation.SQL | relational.SQL | rules.SQL | sources.SQL
