"""paysift: pay-ledger analytics expressed as Spark DataFrame plans.

Sub-packages
------------
sources    readers/writers and the fixture views that turn the driver tables into a pay ledger
functions  Column builders (amount/date parsing, name and key normalisation)
operators  DataFrame -> DataFrame operators (KPI, quality, warehouse, profiling, search, vectors)
plans      the registry of named queries and their DuckDB oracle twins
streaming  Structured Streaming ingestion, dedup and windowed KPI
"""

__version__ = "0.1.0"
