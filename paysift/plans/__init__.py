"""Named queries: each is ``(spark, sf_dir) -> DataFrame`` plus, where SQL can say it,
a DuckDB twin over the same driver tables. See ``catalog``."""
