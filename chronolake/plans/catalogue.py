"""The query catalogue: name -> query, and name -> equivalent DuckDB SQL."""

from __future__ import annotations

from chronolake.plans import board_queries, extract_queries, lowrank_queries, model_queries, record_queries, rolling_queries, series_queries, spectral_queries, table_queries
from chronolake.plans.inputs import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "board_queries", "extract_queries", "flagship_detection", "lowrank_queries", "model_queries", "record_queries", "rolling_queries", "series_queries", "spectral_queries", "table_queries"]

flagship_detection = QUERIES["flagship_detection"]
