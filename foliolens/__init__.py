"""Rule-driven portfolio views on Spark."""

from foliolens.model import Modifier, Rule, RuleBook, View, ViewSet, container_labels, custom_rules, stored_rules
from foliolens.plans.modifiers import DEFAULT_MODIFIERS, MODIFIERS
from foliolens.plans.pipeline import ViewResult, process_tables, run_views

__all__ = [
    "DEFAULT_MODIFIERS",
    "MODIFIERS",
    "Modifier",
    "Rule",
    "RuleBook",
    "View",
    "ViewResult",
    "ViewSet",
    "container_labels",
    "custom_rules",
    "process_tables",
    "run_views",
    "stored_rules",
]
