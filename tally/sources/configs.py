"""Configurations as trees: what all buildings share, and what some set otherwise."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.sources import ledger

BASE = {
    "category_variation": {"min": 1000, "percent": 1.0},
    "negative_alert": True,
    "continuity": {},
    "yield": {"tolerance": 0.25},
    "manager": {"new_vendor": 3000, "off": ["G7"], "stability": 0.05},
}
#: Overlay -> (divisor, remainder) of the buildings that have it.
OVERLAYS = [
    ({"category_variation": {"min": 5000}, "movement": {}, "yield": {"tolerance": 0.45}, "continuity": {"tolerance": 2000}, "manager": {"new_vendor": 20000, "off": []}}, (4, 0)),
    ({"negative_balance": {"months": 4}, "collection": {"least": 0.5}, "repeated_invoice": {}}, (5, 1)),
    ({"continuity": False, "manager": {"ordinary": 60000}, "negative_alert": {}}, (7, 2)),
    ({"category_variation": None, "manager": None, "negative_alert": False, "late": {"days": 10}}, (10, 3)),
]


def _buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.condos(spark, sf_dir)


def base_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(condo_id, tree): the same JSON for all."""
    return _buildings(spark, sf_dir).withColumn("tree", F.lit(json.dumps(BASE)))


def overlay_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(condo_id, tree) of the buildings with settings of their own; the first overlay that fits counts."""
    tree = F.coalesce(*(F.when(F.col("condo_id") % d == r, json.dumps(x)) for x, (d, r) in OVERLAYS))
    return _buildings(spark, sf_dir).withColumn("tree", tree).filter("tree is not null")
