"""Severity bands and the final score."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The ordered bands, 1 to 4.
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

# Band floors on the detector's 0-10 scale.
HIGH_FLOOR = 7.0
MEDIUM_FLOOR = 4.0


def severity_number(severity: Column) -> Column:
    """Band 1..3 of a 0-10 severity; null counts as 0."""
    value = F.coalesce(severity, F.lit(0.0))
    return F.when(value >= HIGH_FLOOR, 3).when(value >= MEDIUM_FLOOR, 2).otherwise(1)


def level_number(name: Column) -> Column:
    """Band number of a band name in any case; anything else, UNKNOWN included, is 1."""
    upper = F.upper(name)
    number = F.when(upper == "LOW", 1)
    for position, level in enumerate(LEVELS[1:], 2):
        number = number.when(upper == level, position)
    return number.otherwise(1)


def level_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(level) for level in LEVELS]), number.cast("int"))


def rescore(severity: Column, blast_radius: Column, related_count: Column, model_severity: Column) -> Column:
    """Final band name: strongest signal, raised by corroboration, pinned by a CRITICAL principal."""
    blast = level_number(blast_radius)
    strongest = F.greatest(severity_number(severity), blast, level_number(model_severity))
    related = F.coalesce(related_count, F.lit(0))
    corroborated = (related >= 3) | ((related >= 1) & (strongest < 3))
    raised = strongest + F.when(corroborated, 1).otherwise(0)
    pinned = F.when(blast == 4, 4).otherwise(F.least(raised, F.lit(4)))
    return level_name(pinned)
