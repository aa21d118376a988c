"""Named queries over the driver's tables."""

from riskflow.plans import features, ingest, live, models, outcomes, quality, watch
from riskflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "features", "ingest", "live", "models", "outcomes", "quality", "watch"]
