"""The audit rules; importing the package fills the registry in its fixed order."""

from webestate.operators.rules import availability, links, directory  # noqa: F401, I001
from webestate.operators.rules.base import (  # noqa: F401
    AVAILABILITY_RULES, REGISTRY, Rule, RuleContext, materialise_findings, register_rule, rule_severities, run_rules,
    scoped_portals, select_rules,
)
