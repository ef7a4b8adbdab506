"""Data-lake tables, reports, audits and sync as lazy PySpark jobs."""
