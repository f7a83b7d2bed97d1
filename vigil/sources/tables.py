"""Parquet table access.

Tables are read lazily with ``spark.read.parquet``; every operator selects
only the columns it needs, so Catalyst prunes the scan (``ReadSchema``) and
pushes filters into the parquet reader (``PushedFilters``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

DEFAULT_SF_DIR = os.environ.get("VIGIL_SF_DIR", "/root/testdata/sf0.01")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Expose every table as a temp view for ``spark.sql`` users."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
