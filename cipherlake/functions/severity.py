"""The five numeric severity scales.  They differ on purpose; do not merge them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cipherlake import fixed_values as V
from cipherlake.functions.text import first_match, has_any, lookup


def summary_weight(sev: Column) -> Column:
    return lookup(V.SUMMARY_WEIGHT, F.lower(sev), 0.0)


def risk_value(sev: Column) -> Column:
    return lookup(V.RISK_VALUE, F.lower(sev), V.RISK_VALUE_DEFAULT)


def ml_factor(sev: Column) -> Column:
    return lookup(V.ML_SEVERITY_FACTOR, sev, 1.0)


def priority(sev: Column) -> Column:
    return lookup(V.PRIORITY_ORDER, F.lower(sev), 0)


def feature_value(sev: Column) -> Column:
    return lookup(V.FEATURE_SEVERITY, sev, 1.0)


def calculator_type_weight(crypto_type: Column) -> Column:
    return lookup(V.CALCULATOR_TYPE_WEIGHT, F.lower(crypto_type), 0.0)


def scan_priority(sev: Column) -> Column:
    """Rule severity to first-stage priority: 1, 2 or 3."""
    low = F.lower(sev)
    return first_match([(low.isin("critical", "high"), 1), (low.isin("medium", "low"), 2)], 3)


def criticality(algorithm: Column) -> Column:
    low = F.lower(algorithm)
    return first_match([(has_any(low, words), score) for words, score in V.CRITICALITY], V.CRITICALITY_DEFAULT)


def at_least(sev: Column, threshold: str = "medium") -> Column:
    """Severity at or above a level."""
    return priority(sev) >= V.PRIORITY_ORDER.get(threshold.lower(), 0)
