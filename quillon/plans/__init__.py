"""All queries of the engine's own operators."""

from quillon.plans import act_plans, citation_plans, metric_plans, misc_plans, retrieval_plans, rule_plans, stats_plans, table_plans, telemetry_plans, text_plans  # noqa: F401
from quillon.plans.registry import ORACLES, QUERIES  # noqa: F401
