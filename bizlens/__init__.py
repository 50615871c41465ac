"""bizlens: business-table analytics as lazy Spark DataFrame operators.

Subpackages:
    functions  column expressions (number/date coercion, formatting, statistics helpers)
    sources    readers, canonical views over the test tables, result records, run ledger
    operators  profiling, role detection, business modes, time series, chart data, ML
    plans      the registered query catalogue and its SQL oracles
    streaming  arriving-file ingest with Structured Streaming
"""

__all__ = ["functions", "sources", "operators", "plans", "streaming"]
