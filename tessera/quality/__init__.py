"""Data quality: a table of rules, one-pass evaluation, gates, files and suggestions."""

from .engine import GateClosed, Outcome, Report, evaluate, explain, gate
from .rules import KINDS, Rule, Suite, rule
from .suggest import anomalies, suggest
from .suites import load, of_plain, plain, save

__all__ = ["KINDS", "GateClosed", "Outcome", "Report", "Rule", "Suite", "anomalies", "evaluate", "explain", "gate", "load", "of_plain", "plain", "rule", "save", "suggest"]
