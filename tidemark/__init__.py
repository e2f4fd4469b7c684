"""Spark-native analytics for tables, text and event logs.

Every operator is a function from DataFrames to a DataFrame.  The packages:

* ``functions``  column expressions and the ordering/quantile building blocks
* ``sources``    readers, writers, contracts and the canonical-table adapters
* ``operators``  the analytics themselves
* ``plans``      registered queries, their SQL oracles and end-to-end flows
* ``streaming``  Structured Streaming forms of the stateful operators
"""
