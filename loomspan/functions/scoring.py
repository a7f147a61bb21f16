"""Confidence, recency, fusion and penalties as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings

#: Parts of paths of secondary files.
PENALISED = ("tests/", "test_", "docs/", "spec", "plan")


def unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def recency(modified: Column, s: Settings = SETTINGS) -> Column:
    """0.5 for null; 1 for the future; halved with each half-life."""
    age = F.lit(s.as_of) - modified
    return F.when(modified.isNull(), 0.5).when(age <= 0, 1.0).otherwise(F.pow(F.lit(0.5), age / s.half_life_seconds))


def confidence(distance: Column, keyword: Column, modified: Column, s: Settings = SETTINGS) -> Column:
    near = F.greatest(F.lit(0.0), 1 - distance)
    words = F.greatest(F.lit(0.0), 1 - keyword / s.keyword_scale)
    return unit(s.distance_weight * near + s.keyword_weight * words + s.recency_weight * recency(modified, s))


def level(score: Column) -> Column:
    return F.when(score > 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def halved_distance(distance: Column) -> Column:
    """L2 distance of unit vectors on a scale of 0 to 1."""
    return unit(distance / 2)


def penalty(path: Column, markers=PENALISED, s: Settings = SETTINGS) -> Column:
    """The factor of secondary files, once; 1 for commits."""
    low, hit = F.lower(path), F.lit(False)
    for m in markers:
        hit = hit | low.contains(m)
    return F.when(path.startswith("git:"), 1.0).when(hit, s.path_penalty).otherwise(1.0)
