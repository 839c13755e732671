"""Named queries over the given tables."""

from webestate.plans import rule_queries, rollup_queries, site_queries, report_queries, flow_queries, history_queries, entry_queries, page_queries  # noqa: F401, I001
from webestate.plans.catalog import ORACLES, QUERIES  # noqa: F401
