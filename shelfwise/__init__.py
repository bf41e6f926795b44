"""shelfwise: batch-tracked inventory analytics on Spark.

Subpackages: ``sources`` (schemas, loaders, stand-in tables, sinks), ``functions`` (as-of
clock, stock rules, labels), ``operators`` (per-product aggregate, skew-safe scans, FEFO,
bounded top-n), ``plans`` (reports, sales, jobs, checks) and ``streaming``.
"""

__version__ = "0.1.0"
