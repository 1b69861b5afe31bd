"""Sensitive-content scanning over Spark DataFrames."""

from siftwell.functions.rules import RuleSet, default_rules, fuse, make_rules
from siftwell.plans.scan import scan_chunked, scan_files, scan_text, scan_units

__all__ = [
    "RuleSet",
    "default_rules",
    "fuse",
    "make_rules",
    "scan_chunked",
    "scan_files",
    "scan_text",
    "scan_units",
]
