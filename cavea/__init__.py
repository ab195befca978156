"""Occluded-volume analytics over point clouds, expressed as Spark DataFrames."""

from __future__ import annotations

import os


def reachable(spark) -> None:
    """Python workers look for this package where the driver has it, besides where they
    would. On a cluster the package is shipped with the job; then this adds nothing."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
