"""All registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import details, engineering, network, obstacles, rings, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = network.QUERIES | engineering.QUERIES | obstacles.QUERIES | details.QUERIES | search.QUERIES | rings.QUERIES
ORACLES: dict[str, str] = network.ORACLES | engineering.ORACLES | obstacles.ORACLES | details.ORACLES | search.ORACLES | rings.ORACLES
FLAGSHIP = "network_slice"
