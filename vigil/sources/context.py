"""Business context: the small dimension document that drives enrichment.

``load_context(path)`` reads a JSON document with the sections below, by
Spark from any storage that it can read; a missing document gives empty
sections, an unreadable one an error. Pattern sections are folded into the
plan as literal arrays; sections that are looked up by key become tables.
"""

from __future__ import annotations

import json
from importlib.resources import files
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: The sample document beside this file: made-up values that show every section in use.
DEFAULT_CONTEXT: dict[str, Any] = json.loads(files("vigil.sources").joinpath("sample_context.json").read_text())

_SECTIONS = list(DEFAULT_CONTEXT)


def load_context(path: str | None = None) -> dict[str, Any]:
    """Context document (one JSON file on local or remote storage); ``None`` gives the
    default, a missing file empty sections. Anything else that stops the read is an error."""
    if path is None:
        return DEFAULT_CONTEXT
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise ValueError(f"a Spark session is needed to read the context document {path}")
    try:
        doc = json.loads(spark.read.text(path, wholetext=True).first()[0])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        doc = {}
    return {k: doc.get(k, {} if isinstance(DEFAULT_CONTEXT[k], dict) else []) for k in _SECTIONS}


def dimension(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A context section as a table; Spark knows its size and chooses the join by it."""
    return spark.createDataFrame([tuple(r.get(f.split()[0]) for f in schema.split(",")) for r in rows], schema)
