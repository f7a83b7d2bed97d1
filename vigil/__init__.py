"""vigil — a Spark-native engine for security-alert triage and IDOR detection.

Every operator is a DataFrame (or Structured Streaming) transformation:
``f(df, *dims, **params) -> DataFrame``. Nothing is computed on the driver.
"""

from vigil.session import get_spark

__all__ = ["get_spark"]
