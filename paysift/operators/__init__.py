"""DataFrame -> DataFrame operators: KPI families, screen views, reports, cleaning, validation,
warehouse load, search, profiling, text and vectors."""
