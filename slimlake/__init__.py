"""Inventory analytics and proven, reversible rewriting for large stores, on Spark.

Layout
------
functions   column expressions (paths, globs, byte tests, sizes, text)
sources     listings, probe and score JSON, the snapshot table
operators   DataFrame -> DataFrame building blocks
plans       whole commands (scan, plan, run, report, dedup, verify, ...)
streaming   Structured Streaming jobs
catalog     the registered queries with their SQL oracles
"""
