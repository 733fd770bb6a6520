"""Queries of the training-data operators, keyed ``opN_<name>``, and their DuckDB SQL."""

from __future__ import annotations

from pricewell.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
