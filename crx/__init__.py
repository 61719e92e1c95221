"""crx — code-review analytics as Spark DataFrame operators.

Subpackages:
  sources    table readers, schemas, derived fixtures
  functions  Column-level helpers (pure pyspark.sql.functions expressions)
  operators  DataFrame -> DataFrame operators, one per inventory key
  plans      session configuration, size-checked broadcast, lineage cuts
  streaming  Structured Streaming jobs built from the same operators
"""

__all__ = ["sources", "functions", "operators", "plans", "streaming"]
