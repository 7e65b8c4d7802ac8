"""feira — marketplace analytics as Spark DataFrame jobs.

Layers:
  sources    typed readers/writers and the bridge from the driver's parquet tables
  functions  column helpers whose semantics are pinned (rounding, day/month differences)
  operators  reusable distributed operators: ranking, profiling, preparation
  plans      the sixteen analytical views and the headline metrics
"""

from feira.sources.bridge import Tables, load_tables

__all__ = ["Tables", "load_tables"]
