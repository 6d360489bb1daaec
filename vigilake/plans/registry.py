"""All queries of the engine by name, with the SQL that each must equal."""

from __future__ import annotations

from vigilake.plans import boosted, canonical, correlation, dictionary, exposure_rules, ingestion, keyed, matching, membership, pipelines, read_models, statistics, training, url_dataset  # noqa: F401  (modules add their queries when imported)
from vigilake.plans.base import ORACLES, QUERIES

FLAGSHIP = "dash_top_machines"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
